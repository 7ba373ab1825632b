"""Paid answers: every distinct text goes out once, what comes back is kept in a keyed table, and only success is charged."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.operators.prefix import fold_rows
from loomq.session import expose_package, folder_exists, store


class Provider(Protocol):
    """What translates texts. A worker process makes one and keeps it for all its batches and tasks."""

    def translate(self, texts: list[str], target: str, source: str | None) -> list[str | Exception]: ...


@dataclass(frozen=True)
class Service:
    """A provider as a job names it: its name, a mark of this registration, and what makes one on a worker."""

    name: str
    mark: str
    factory: Callable[[], Provider]


_made: dict[str, Provider] = {}


def made(service: Service) -> Provider:
    """The worker's own provider; a later registration under the name is another one."""
    if service.mark not in _made:
        _made[service.mark] = service.factory()
    return _made[service.mark]


ANSWER = "key binary, answer string, error string, characters long, at timestamp"
_ANSWER = pa.schema([("key", pa.binary()), ("answer", pa.string()), ("error", pa.string()), ("characters", pa.int64()), ("at", pa.timestamp("us", "UTC"))])


def text_key(text: Column) -> Column:
    """The SHA-256 of a text, by which its answer is found; null for null."""
    return F.unhex(F.sha2(text, 256))


def answered(provider: Provider, texts: list[str], target: str, source: str | None) -> list[str | Exception]:
    """One answer or error for each text, whatever the provider does."""
    try:
        answers = provider.translate(texts, target, source)
    except Exception as error:  # noqa: BLE001 - a request that fails must not repeat those before it
        return [error] * len(texts)
    if len(answers) != len(texts):
        return [ValueError(f"{len(texts)} texts sent, {len(answers)} came back")] * len(texts)
    return answers


def ask(wanted: DataFrame, service: Service, target: str, source: str | None = None) -> DataFrame:
    """The answers to wanted texts (key, text; one row a key): key, answer or error, characters, at.

    They are written when this returns, so reading them again asks nobody. Only a task that is lost before it has written
    its part asks again for that part.
    """
    expose_package(wanted.sparkSession)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            answers = answered(made(service), texts, target, source)
            failed = [isinstance(a, Exception) for a in answers]
            columns = [
                batch.column("key").cast(pa.binary()), pa.array([None if bad else a for a, bad in zip(answers, failed)], pa.string()),
                pa.array([f"{type(a).__name__}: {a}" if bad else None for a, bad in zip(answers, failed)], pa.string()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([datetime.now(timezone.utc)] * len(texts), _ANSWER.field("at").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_ANSWER)

    return store(wanted.select("key", "text").mapInArrow(call, ANSWER), "answers")


class Book:
    """Answers of earlier runs in a folder, by provider, target and source; a run that is repeated sends nothing twice.

    Errors aren't kept, so a text that failed is sent again by the next run.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def known(self, like: DataFrame, service: Service, target: str, source: str | None) -> DataFrame | None:
        spark = like.sparkSession
        if not folder_exists(spark, self.folder):
            return None
        kept = spark.read.schema(f"{ANSWER}, source string, provider string, target string").parquet(self.folder)
        own = (F.col("provider") == service.name) & (F.col("target") == target) & F.col("source").eqNullSafe(source)
        return kept.filter(own).select(*[c.split()[0] for c in ANSWER.split(", ")])

    def add(self, answers: DataFrame, service: Service, target: str, source: str | None) -> None:
        good = answers.filter(F.col("error").isNull()).withColumn("source", F.lit(source).cast("string"))
        good.withColumn("provider", F.lit(service.name)).withColumn("target", F.lit(target)).write.mode("append").partitionBy("provider", "target").parquet(self.folder)


def ask_new(texts: DataFrame, before: Sequence[DataFrame], service: Service, target: str, source: str | None, book: Book | None) -> DataFrame:
    """The answers to the distinct texts (key, text) that no earlier table answers."""
    wanted = texts.dropDuplicates(["key"])
    for known in before:
        wanted = wanted.join(known.select("key"), "key", "left_anti")
    new = ask(wanted, service, target, source)
    if book is not None:
        book.add(new, service, target, source)
    return new


def ledger(new: DataFrame, service: Service | str) -> DataFrame:
    """What a provider charges for: a row (provider, ts, characters) for each text that it answered, none for failures."""
    name = service if isinstance(service, str) else service.name
    return new.filter(F.col("error").isNull()).select(F.lit(name).alias("provider"), F.col("at").alias("ts"), "characters")


# --- budgets ----------------------------------------------------------------------------------------------------------

SEND, WAIT, REFUSED = "send", "wait", "refused"


def _decide(budget: int) -> Callable[[], Callable[[int, bool | None], tuple[str, int]]]:
    def run() -> Callable[[int, bool | None], tuple[str, int]]:
        least, most, waiting = 0, 0, False  # characters used if all open texts fail, or all succeed

        def step(n: int, success: bool | None) -> tuple[str, int]:
            nonlocal least, most, waiting
            if waiting:
                return WAIT, least
            if most + n <= budget:
                most += 0 if success is False else n
                least += n if success else 0
                return SEND, least
            if least + n > budget:
                return REFUSED, least
            waiting = True
            return WAIT, least

        return step

    return run


def decisions(units: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, success: str, budget: int) -> DataFrame:
    """The units with state and used: in order, a unit is sent if it fits what successes before it have left.

    success is null for a text that nobody has answered yet. Such a unit may or may not use its characters; a unit whose
    admission depends on that waits, with all after it in its run, until the answers are there. A unit that failed leaves
    the budget as it was, and a later, smaller one may fit where an earlier did not.
    """
    amount = F.coalesce(F.col(size), F.lit(0)).cast("long")
    return fold_rows(units, keys, [*order, size], [amount, F.col(success)], _decide(budget), "state string, used bigint")


@dataclass
class Answers:
    """Answers of a run: all, in one table by key; those that were paid for now; and the decisions on units, if any."""

    all: DataFrame
    new: DataFrame
    decided: DataFrame | None = None


def _together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def answers_to(texts: DataFrame, service: Service, target: str, source: str | None = None, book: Book | None = None) -> Answers:
    """The answers to all texts (key, text; null keys are left out), each distinct one sent once."""
    known = book.known(texts, service, target, source) if book is not None else None
    known = [] if known is None else [store(known, "known")]
    new = ask_new(texts.filter("key is not null"), known, service, target, source, book)
    return Answers(_together([*known, new]), new)


def answers_within(
    units: DataFrame, keys: Sequence[str], order: Sequence[str], budget: int, service: Service, target: str, source: str | None = None, book: Book | None = None,
) -> Answers:
    """The same for stored units (id, keys, order, key, text, size) of which each run may use a budget of characters.

    Units go out in waves: first all that fit even if every text before them succeeds; then, with these answers, what was
    open. A wave answers at least one more text of every run that waits, and two are enough unless texts fail near the
    edge of a budget. decided holds id and state for every unit.
    """
    known = book.known(units, service, target, source) if book is not None else None
    tables: list[DataFrame] = [] if known is None else [store(known, "known")]
    asked: list[DataFrame] = []
    narrow = units.select("id", *keys, *order, "size", "key")
    while True:
        if tables:
            outcome = _together(tables).select("key", F.col("error").isNull().alias("success"))
            judged = narrow.join(outcome, "key", "left")
        else:
            judged = narrow.withColumn("success", F.lit(None).cast("boolean"))
        decided = store(decisions(judged, keys, order, "size", "success", budget).select("id", "key", "state", "success"), "decided")
        sent = decided.filter((F.col("state") == SEND) & F.col("success").isNull()).select("id")
        new = ask_new(units.join(sent, "id", "left_semi").select("key", "text"), tables, service, target, source, book)
        tables.append(new)
        asked.append(new)
        if decided.filter(F.col("state") == WAIT).isEmpty():
            return Answers(_together(tables), _together(asked), decided.select("id", "state"))
