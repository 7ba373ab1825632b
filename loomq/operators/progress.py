"""Long work over a table in parts: what is done is reported and kept, the rest can be cancelled and done later."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomq.session import folder_exists, remove_folder


@dataclass(frozen=True)
class Step:
    """A part that has been finished: its number, how many there are, and what was observed of its rows."""

    part: int
    parts: int
    observed: dict


@dataclass
class Report:
    """A run: parts finished now and before, what was observed now, and whether parts were left out."""

    parts: int
    done: list[int] = field(default_factory=list)
    skipped: list[int] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)
    cancelled: bool = False

    def total(self, name: str) -> int:
        return sum(s.observed.get(name) or 0 for s in self.steps)


def part_of_place(place: Column, total: Column | int, parts: int) -> Column:
    """The part, from 0, of a place from 0 in a list: contiguous parts of nearly equal length."""
    return F.least(F.floor(place * parts / F.greatest(F.lit(1), total if isinstance(total, Column) else F.lit(total))), F.lit(parts - 1)).cast("int")


def part_of_key(key: Column, parts: int) -> Column:
    """The part of a key where the order doesn't matter."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class Parts:
    """A folder of finished parts of one piece of work.

    A part is one Spark job over its rows, on all executors, and one Parquet folder that counts once the job has
    committed it. cancel() may be called from any thread: the part that runs is interrupted and leaves nothing behind,
    parts that were finished stay. A later run with the same parts does those that are missing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tag = spark, folder, f"parts-{uuid.uuid4().hex}"
        self._stop = threading.Event()

    def _place(self, part: int) -> str:
        return f"{self.folder}/part={part}"

    def is_finished(self, part: int) -> bool:
        return folder_exists(self.spark, f"{self._place(part)}/_SUCCESS")

    def finished(self, parts: int) -> list[int]:
        return [p for p in range(parts) if self.is_finished(p)]

    def read(self, parts: int) -> DataFrame | None:
        """The rows of all finished parts with their part, or None if there is none."""
        found = [self._place(p) for p in self.finished(parts)]
        return self.spark.read.option("basePath", self.folder).parquet(*found) if found else None

    def cancel(self) -> None:
        """Stop before the next part, and interrupt what runs."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def running_tasks(self) -> tuple[int, int]:
        """Tasks done and tasks known of the jobs that run now."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getActiveJobsIds() if (job := tracker.getJobInfo(j)) for s in job.stageIds]
        known = [s for s in stages if s is not None]
        return sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known)

    def run(
        self, rows: DataFrame, part: Column, parts: int, work: Callable[[DataFrame], DataFrame], observe: Sequence[Column] = (),
        progress: Callable[[Step], None] | None = None, should_cancel: Callable[[], bool] | None = None,
    ) -> Report:
        """Do the work on the rows of every part that isn't finished, in order.

        observe has named aggregates over the results, computed as they are written; rows is always among them.
        should_cancel is asked before each part. A part that fails raises its error; finished ones stay.
        """
        if parts < 1:
            raise ValueError("at least one part")
        self._stop.clear()
        context, report, numbered = self.spark.sparkContext, Report(parts), rows.withColumn("__part", part)
        for n in range(parts):
            if self._stop.is_set() or (should_cancel is not None and should_cancel()):
                report.cancelled = True
                break
            if self.is_finished(n):
                report.skipped.append(n)
                continue
            seen = Observation(f"{self.tag}-{n}")
            result = work(numbered.filter(F.col("__part") == n).drop("__part")).observe(seen, F.count(F.lit(1)).alias("rows"), *observe)
            context.addJobTag(self.tag)
            try:
                result.write.mode("overwrite").parquet(self._place(n))
            except Exception:
                remove_folder(self.spark, self._place(n))
                if not self._stop.is_set():
                    raise
                report.cancelled = True
                break
            finally:
                context.removeJobTag(self.tag)
            step = Step(n, parts, seen.get)
            report.done.append(n)
            report.steps.append(step)
            if progress is not None:
                progress(step)
        return report


def merged_in_parts(work: Parts, sources: DataFrame, pages: DataFrame, parts: int, **options) -> Report:
    """Merge the selected pages of sources (see merge.selected_pages()) in parts of whole sources, in their order.

    pages: path, source_page and what a page consists of. Output numbers are those of the whole merge, so what a
    cancelled run leaves is its beginning. Observed: rows (pages) and segments.
    """
    from loomq.operators.merge import selected_pages
    from loomq.session import store

    selected = selected_pages(sources)
    begins = selected.groupBy("seq").agg(F.min("output_page").alias("begins"))
    chosen = store(selected.join(begins, "seq"), "selected")
    total = sources.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).first()["n"]

    def fill(rows: DataFrame) -> DataFrame:
        return rows.join(pages, ["path", "source_page"])

    begun = F.count_if(F.col("output_page") == F.col("begins")).alias("segments")
    return work.run(chosen, part_of_place(F.col("seq"), int(total), parts), parts, fill, [begun], **options)


def watched(parts: Parts, every: float, tell: Callable[[int, int], None]) -> Iterator[None]:
    """A context in which the tasks of what runs are told every so many seconds: with contextmanager(watched)(…)."""
    stop = threading.Event()

    def look() -> None:
        while not stop.wait(every):
            tell(*parts.running_tasks())

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
