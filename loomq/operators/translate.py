"""Translation as a table operation: providers, unit outcomes, roll-ups and comparisons."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomq.functions.text import blank, protect_terms, restore_terms
from loomq.operators.answers import REFUSED, SEND, Book, Provider, Service, answers_to, answers_within, ledger, text_key
from loomq.operators.cost import PRICES, RUN_BUDGET
from loomq.session import store
from loomq.sources.sinks import append_log


class Echo:
    """A provider for tests: marks each text with the target language, and fails where a text says so."""

    def translate(self, texts: list[str], target: str, source: str | None) -> list[str | Exception]:
        return [ValueError("refused") if "[[fail]]" in t else f"[{target}] {t}" for t in texts]


class Short:
    """A provider for tests that takes no text over a limit, as services do; others come back in reverse."""

    limit = 120

    def translate(self, texts: list[str], target: str, source: str | None) -> list[str | Exception]:
        return [ValueError(f"over {self.limit} characters") if len(t) > self.limit else t[::-1] for t in texts]


class Upper:
    """A provider for tests that keeps markup: capitals outside of tags, character references and placeholders."""

    def translate(self, texts: list[str], target: str, source: str | None) -> list[str | Exception]:
        def capitals(m: re.Match) -> str:
            return m[0] if m[1] else m[0].upper()

        return [re.sub(r"(<[^>]+>|&[a-z#0-9]+;|§§\w+§§)|[^<&§]+", capitals, t) for t in texts]


_PROVIDERS: dict[str, Service] = {}


class UnknownProvider(KeyError):
    pass


def register(name: str, factory: Callable[[], Provider]) -> None:
    _PROVIDERS[name] = Service(name, uuid.uuid4().hex, factory)


for _name, _factory in (("echo", Echo), ("upper", Upper), ("short", Short)):
    register(_name, _factory)


def service_of(name: str) -> Service:
    if name not in _PROVIDERS:
        raise UnknownProvider(f"no provider {name!r}; known: {', '.join(sorted({*_PROVIDERS, *PRICES}))}")
    return _PROVIDERS[name]


@dataclass
class Run:
    """Translated units, and the answers that were paid for in the run."""

    units: DataFrame
    new: DataFrame


def run_units(
    units: DataFrame, provider: str, target: str, source: str | None = None, terms: Sequence[str] = (), text: str = "text", translatable: str = "translatable",
    run: Sequence[str] = (), order: str = "unit_index", budget: int | None = None, book: Book | None = None, log: str | None = None,
) -> Run:
    """The units with status, translated, chars_sent and error, and what was paid for.

    A unit that isn't translatable, or is blank, is skipped and nothing is sent. Terms in capitals are masked before
    and restored after. Texts that are equal then are sent once, however many units have them, and their answers are
    written before this returns: however often the result is used, nobody is asked again. chars_sent counts a unit's
    own characters where it was translated, the ledger those that went out. A failing unit doesn't stop the others. With
    a budget (of characters for each run) a unit that doesn't fit what the successes before it have left fails as too
    large; failures use nothing. A book keeps answers for later runs; a log is a folder to which the ledger's rows are
    added once all is done. Statuses: skipped, translated, failed.
    """
    service = service_of(provider)
    masked = protect_terms(F.col(text), terms)
    send = F.col(translatable) & ~blank(F.col(text))
    rows = units.withColumn("__masked", F.when(send, masked)).withColumn("__id", F.monotonically_increasing_id())
    rows = store(rows.withColumn("__key", text_key(F.col("__masked.text"))), "units")
    named = {"id": "__id", "key": "__key", "text": "__masked.text"}
    sent = rows.filter("__key is not null")
    if budget is None:
        answers = answers_to(sent.select(F.col("__key").alias("key"), F.col("__masked.text").alias("text")), service, target, source, book)
        joined = rows.withColumn("__state", F.when(F.col("__key").isNotNull(), SEND))
    else:
        runs = {f"__run{i}": k for i, k in enumerate(run)}
        own = sent.select(*[F.col(c).alias(n) for n, c in named.items()], *[F.col(c).alias(n) for n, c in runs.items()], F.col(order).alias("__order"), F.length("__masked.text").alias("size"))
        answers = answers_within(own, list(runs), ["__order"], budget, service, target, source, book)
        joined = rows.join(answers.decided.select(F.col("id").alias("__id"), F.col("state").alias("__state")), "__id", "left")
    found = answers.all.select(F.col("key").alias("__key"), F.struct("answer", "error").alias("__answer"))
    joined = joined.join(found, "__key", "left")
    error = F.when(F.col("__state") == REFUSED, F.lit("over budget")).otherwise(F.col("__answer.error"))
    status = F.when(F.col("__key").isNull(), "skipped").when(error.isNotNull(), "failed").otherwise("translated")
    done = joined.withColumn("status", status).withColumn("error", error)
    good = F.col("status") == "translated"
    done = done.withColumn("translated", F.when(good, restore_terms(F.col("__answer.answer"), F.col("__masked.placeholders"))))
    done = done.withColumn("chars_sent", F.when(good, F.length("__masked.text")).otherwise(0).cast("long"))
    if log is not None:
        append_log(ledger(answers.new, service), log)
    added = ["status", "error", "translated", "chars_sent"]
    return Run(done.select(*[c for c in units.columns if c not in added], *added), answers.new)


def translate_units(units: DataFrame, provider: str, target: str, source: str | None = None, terms: Sequence[str] = (), **more) -> DataFrame:
    """The units of run_units(), which says what more is understood."""
    return run_units(units, provider, target, source, terms, **more).units


def outcome_stats(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units, translated, skipped, failed and chars_sent by keys."""
    counted = [F.count_if(F.col("status") == s).alias(s) for s in ("translated", "skipped", "failed")]
    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), *counted, F.sum("chars_sent").alias("chars_sent"))


def group_outcomes(groups: DataFrame) -> DataFrame:
    """Outcomes of merged regions counted by their members."""
    return groups.withColumn("units", F.col("members")).withColumn("translated_units", F.when(F.col("status") == "translated", F.col("members")).otherwise(0))


def batch_stats(outcomes: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for a batch: documents planned, translated and failed, units by outcome and characters.

    A document with an error of its own failed; the others count by their units.
    """
    own = documents.agg(
        F.count(F.lit(1)).alias("documents_planned"), F.count_if(F.col("error").isNull()).alias("documents_translated"), F.count_if(F.col("error").isNotNull()).alias("documents_failed"),
    )
    good = outcomes.join(documents.filter("error is null").select("doc_id"), "doc_id", "left_semi")
    units = good.agg(
        *[F.count_if(F.col("status") == s).alias(f"units_{s}") for s in ("translated", "skipped", "failed")], F.coalesce(F.sum("chars_sent"), F.lit(0)).cast("long").alias("chars_sent"),
    )
    return own.withColumn("k", F.lit(1)).join(units.withColumn("k", F.lit(1)), "k").drop("k")


def chosen_term(headers: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The term a document protects: its header's title, else its file's name; used_fallback says which."""
    from loomq.functions.text import header_names, term_of_file

    title = header_names(F.col("headers"))["title"]
    return headers.select(doc_id, F.coalesce(title, term_of_file(F.col("path"))).alias("term"), title.isNull().alias("used_fallback"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Translatable blocks with words, in the order in which a comparison shows them: page, height, then place."""
    from loomq.functions.text import has_letters

    kept = blocks.filter(F.col("translatable") & has_letters(F.col("text")))
    return kept.orderBy("page_index", "y0", "place")


def compare_providers(blocks: DataFrame, providers: Sequence[str], target: str, key: str, text: str = "text") -> DataFrame:
    """Blocks with one column of translations for each provider; a failure shows its error in brackets.

    The providers are a short list in the plan, so the blocks are expanded by it rather than joined with it.
    """
    out = blocks
    for name in providers:
        done = translate_units(blocks.select(key, text).withColumn("translatable", F.lit(True)), name, target, text=text)
        shown = F.coalesce("translated", F.concat(F.lit("["), "error", F.lit("]")))
        out = out.join(done.select(key, shown.alias(name)), key, "left")
    return out


def side_by_side(original: DataFrame, translated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Original and translated texts in one row by keys; spanning marks originals without a counterpart."""
    other = translated.select(*keys, F.col("text").alias("translated"), F.lit(True).alias("__there"))
    joined = original.join(other, list(keys), "left")
    return joined.withColumn("spanning", F.col("__there").isNull()).drop("__there")


def analysis(spark: SparkSession, units: DataFrame, provider: str, used: int, live: tuple[bool, int | None, int | None] = (False, None, None), budget: int = RUN_BUDGET) -> DataFrame:
    """What a run would send and cost: units, characters, estimate, over_budget and a warning where nothing is found."""
    from loomq.operators.cost import live_cost

    price, free = PRICES[provider]
    sent = F.col("translatable") & ~blank(F.col("text"))
    counts = units.agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum(F.when(sent, F.length("text"))), F.lit(0)).cast("long").alias("characters"))
    available, live_used, live_limit = live
    value = live_cost(F.col("characters"), F.lit(available), F.lit(live_used).cast("long"), F.lit(live_limit).cast("long"), F.lit(used), F.lit(free), F.lit(price))
    warnings = F.array_compact(F.array(F.when(F.col("characters") == 0, "warning.scan_pdf"), F.when(F.lit(provider == "deepl" and not available), "warning.live_quota_unavailable")))
    return counts.select("units", "characters", value.alias("estimate"), (F.col("characters") > budget).alias("over_budget"), warnings.alias("warnings"))
