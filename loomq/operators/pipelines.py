"""Whole translations: Word paragraphs, slides, recognised images, and batches of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomq.functions.markup import paragraph_html, parse_paragraph, parse_spans, slide_html
from loomq.functions.text import escape, has_words
from loomq.operators.regions import LEAST_CONFIDENCE, MOST_HEIGHTS, eligibility, merged_regions, paragraph_chains
from loomq.operators.translate import translate_units
from loomq.session import expose_package

WORD_KEYS = ["path", "part", "para_index"]


def translate_word(paragraphs: DataFrame, provider: str, target: str, source: str | None = None, terms: Sequence[str] = ()) -> DataFrame:
    """Word paragraphs with status, chars_sent, new_runs, break_change and error ("part:index: …").

    Headers and footers aren't translatable and so are skipped. A paragraph whose images or links don't come back
    fails; its characters don't count.
    """
    units = paragraphs.withColumn("html", paragraph_html(F.col("runs")))
    done = translate_units(units, provider, target, source, terms, text="html")
    parsed = done.withColumn("__p", F.when(F.col("status") == "translated", parse_paragraph(F.col("translated"), F.col("html"))))
    broken = F.col("__p.error").isNotNull()
    place = F.concat_ws(":", "part", F.col("para_index").cast("string"))
    error = F.coalesce(F.col("__p.error"), F.col("error"))
    status = F.when(broken, "failed").otherwise(F.col("status"))
    out = parsed.withColumn("status", status).withColumn("chars_sent", F.when(broken, 0).otherwise(F.col("chars_sent")).cast("long"))
    out = out.withColumn("error", F.when(error.isNotNull(), F.concat_ws(": ", place, error)))
    return out.withColumn("new_runs", F.when(~broken, F.col("__p.runs"))).withColumn("break_change", F.coalesce("__p.break_change", F.lit(0))).drop("__p", "translated")


def word_stats(done: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """By document: units by part and outcome, characters, changed breaks and errors."""
    counts = [F.count_if((F.col("part") == p) & (F.col("status") == s)).alias(f"{p}_{s}") for p in ("body", "header", "footer") for s in ("translated", "skipped", "failed")]
    return done.groupBy(*keys).agg(*counts, F.sum("chars_sent").alias("chars_sent"), F.count_if(F.col("break_change") != 0).alias("new_break_anomalies"), F.array_sort(F.collect_list("error")).alias("errors"))


def translate_pages(blocks: DataFrame, provider: str, target: str, source: str | None = None, terms: Sequence[str] = ()) -> DataFrame:
    """Page blocks (doc_id, page_index, block_index, text, html, translatable) with status, chars_sent, translated_html,
    translated_text and error ("page<n>:block<n>: …").

    A block with html is sent as that, one without (null) as plain text; others than translatable ones are skipped. All
    blocks are there before any is sent, and one that fails doesn't stop the others.
    """
    done = translate_units(blocks.withColumn("__sent", F.coalesce("html", "text")), provider, target, source, terms, text="__sent")
    by_html = F.col("html").isNotNull()
    place = F.concat(F.lit("page"), F.col("page_index").cast("string"), F.lit(":block"), F.col("block_index").cast("string"))
    out = done.withColumn("translated_html", F.when(by_html, F.col("translated"))).withColumn("translated_text", F.when(~by_html, F.col("translated")))
    return out.withColumn("error", F.when(F.col("error").isNotNull(), F.concat_ws(": ", place, "error"))).drop("__sent", "translated")


def page_stats(done: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """By document: blocks by outcome, characters, blocks that overflow (fits is false) though translated, and errors."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("translated", "skipped", "failed")]
    overflow = F.count_if((F.col("status") == "translated") & ~F.col("fits")) if "fits" in done.columns else F.lit(0).cast("long")
    return done.groupBy(*keys).agg(*counts, F.sum("chars_sent").alias("chars_sent"), overflow.alias("overflow_blocks"), F.array_sort(F.collect_list("error")).alias("errors"))


def block_records(done: DataFrame) -> DataFrame:
    """What a later correction starts from: the blocks that were translated as html, with their original text."""
    kept = done.filter((F.col("status") == "translated") & F.col("translated_html").isNotNull())
    return kept.select("doc_id", "page_index", "block_index", F.col("text").alias("original_text"), F.col("translated_html").alias("html"))


def translate_slides(paragraphs: DataFrame, keys: Sequence[str], provider: str, target: str, source: str | None = None, terms: Sequence[str] = ()) -> DataFrame:
    """Slide paragraphs (keys, texts: array of run texts) with status, chars_sent, error and new_texts by run.

    A paragraph without words is skipped. If its marks don't come back, its runs are sent one by one; that costs extra
    characters, and a run that fails then fails the paragraph.
    """
    units = paragraphs.withColumn("html", slide_html(F.col("texts"))).withColumn("translatable", F.exists("texts", has_words))
    done = translate_units(units, provider, target, source, terms, text="html")
    checked = done.withColumn("__p", F.when(F.col("status") == "translated", parse_spans(F.col("translated"), F.col("html"))))
    whole = checked.filter(F.col("__p.error").isNull()).withColumn("new_texts", F.col("__p.texts")).drop("__p", "translated")
    lost = checked.filter(F.col("__p.error").isNotNull()).drop("__p", "translated", "status", "error")
    each = lost.select(*keys, F.posexplode("texts").alias("run", "text")).filter(has_words(F.col("text")))
    span = F.concat(F.lit('<span data-run="'), F.col("run").cast("string"), F.lit('">'), escape(F.col("text"), quotes=False), F.lit("</span>"))
    single = translate_units(each.select(*keys, "run", span.alias("html"), F.lit(True).alias("translatable")), provider, target, source, terms, text="html")
    single = single.withColumn("__p", F.when(F.col("status") == "translated", parse_spans(F.col("translated"), F.col("html"))))
    problem = F.coalesce(F.col("error"), F.col("__p.error"))
    again = single.groupBy(*keys).agg(
        F.sum("chars_sent").alias("__more"), F.min(problem).alias("error"), F.map_from_entries(F.collect_list(F.struct("run", F.element_at("__p.texts", F.col("run"))))).alias("new_texts"),
    )
    rest = lost.join(again, list(keys)).withColumn("chars_sent", (F.col("chars_sent") + F.col("__more")).cast("long")).drop("__more")
    rest = rest.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("translated")).withColumn("new_texts", F.when(F.col("error").isNull(), F.col("new_texts")))
    return whole.unionByName(rest)


def translate_images(
    regions: DataFrame, keys: Sequence[str], order: str, provider: str, target: str, source: str | None = None, terms: Sequence[str] = (), paragraphs: bool = False,
    least: float = LEAST_CONFIDENCE, ratio: float = MOST_HEIGHTS,
) -> tuple[DataFrame, DataFrame]:
    """(replacements, stats): eligible regions are merged to paragraphs, unless they are, and translated.

    stats by image counts regions: skipped ones aren't eligible, the members of a paragraph share its outcome.
    """
    judged = eligibility(regions, keys, least, ratio)
    usable = judged.filter(F.col("reason") == "ok")
    chained = usable.withColumn("chain", F.col(order)).withColumn("place", F.lit(0)) if paragraphs else paragraph_chains(usable, keys, order)
    units = merged_regions(chained, keys).withColumn("translatable", F.lit(True))
    done = translate_units(units, provider, target, source, terms)
    totals = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("regions"), F.count_if(F.col("reason") != "ok").alias("skipped"))
    by = [F.sum(F.when(F.col("status") == s, F.col("members")).otherwise(0)).alias(s) for s in ("translated", "failed")]
    sent = done.groupBy(*keys).agg(*by, F.sum("chars_sent").alias("chars_sent"))
    stats = totals.join(sent, list(keys), "left").fillna(0, ["translated", "failed", "chars_sent"])
    return done.filter(F.col("status") == "translated"), stats


def obstacle_regions(regions: DataFrame, chained: DataFrame, replacements: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The recognised regions whose pixels stay: those that no replacement stands for.

    chained: the regions that went into paragraphs, with their chain; replacements: the paragraphs that were translated.
    A region of a paragraph that failed, or that wasn't eligible, still takes room from its neighbours.
    """
    gone = chained.join(replacements.select(*keys, "chain"), [*keys, "chain"], "left_semi").select(*keys, order)
    return regions.join(gone, [*keys, order], "left_anti")


# --- recognition engines ------------------------------------------------------------------------------------------


class Engine(Protocol):
    """What finds text regions in an image's bytes; it is created once for a worker's batches."""

    returns_paragraphs: bool

    def recognise(self, image: bytes, language: str | None) -> list[dict]: ...


REGION = "text string, x int, y int, width int, height int, confidence double, line_height int, translatable boolean"
_ENGINES: dict[str, Callable[[], Engine]] = {}


def register_engine(name: str, factory: Callable[[], Engine]) -> None:
    _ENGINES[name] = factory


def recognise(images: DataFrame, engine: str, language: str | None = None) -> DataFrame:
    """The regions of images (path, content), numbered from 0; an image that fails is one row with its error."""
    if engine not in _ENGINES:
        raise KeyError(f"no engine {engine!r}; known: {', '.join(sorted(_ENGINES))}")
    expose_package(images.sparkSession)
    factory, fields = _ENGINES[engine], [f.split()[0] for f in REGION.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = factory()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found = worker.recognise(bytes(content), language)
                    rows += [{"path": path, "region_index": n, **{f: r.get(f) for f in fields}, "error": None} for n, r in enumerate(found)]
                except Exception as error:  # one image must not stop the others
                    rows.append({"path": path, "error": f"{type(error).__name__}: {error}"})
            whole = {c: "Int32" for c in ("region_index", "x", "y", "width", "height", "line_height")}
            yield pd.DataFrame(rows, columns=["path", "region_index", *fields, "error"], dtype=object).astype(whole | {"confidence": "float64"})

    return images.select("path", "content").mapInPandas(run, f"path string, region_index int, {REGION}, error string")
