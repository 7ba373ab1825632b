import threading
import time
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from loomq.operators import progress


def test_cancelled_between_parts(spark, tmp_path):
    """Two parts are finished, read, and kept when the rest is done later."""
    work, steps = progress.Parts(spark, str(tmp_path / "out")), []
    rows = spark.range(1000).withColumnRenamed("id", "n")
    options = dict(part=progress.part_of_place(F.col("n"), 1000, 5), parts=5, work=lambda df: df.withColumn("square", F.col("n") * F.col("n")))
    report = work.run(rows, **options, observe=[F.sum("n").alias("sum")], progress=steps.append, should_cancel=lambda: len(steps) == 2)
    assert report.cancelled and report.done == [0, 1] and report.total("rows") == 400 and report.total("sum") == sum(range(400))
    assert [(s.part, s.parts, s.observed["rows"]) for s in steps] == [(0, 5, 200), (1, 5, 200)]
    assert work.finished(5) == [0, 1] and sorted(r["n"] for r in work.read(5).collect()) == list(range(400))
    again = work.run(rows, **options)
    assert not again.cancelled and (again.skipped, again.done) == ([0, 1], [2, 3, 4])
    assert work.read(5).filter("square = n * n").count() == 1000


def test_interrupted_within_a_part(spark, tmp_path):
    """A part that runs is stopped at once by another thread; it leaves nothing, the one before stays."""
    work, told = progress.Parts(spark, str(tmp_path / "out")), []

    @F.udf("long")
    def slow(n):
        import time as clock

        clock.sleep(1.0 if n >= 100 else 0.0)
        return n

    def stop_soon(step):
        threading.Timer(2.0, work.cancel).start()

    began = time.perf_counter()
    with contextmanager(progress.watched)(work, 0.2, lambda done, known: told.append(known)):
        report = work.run(spark.range(400).repartition(4), F.when(F.col("id") < 100, 0).otherwise(1), 2, lambda df: df.select(slow("id").alias("n")), progress=stop_soon)
    assert report.cancelled and report.done == [0] and time.perf_counter() - began < 40 and max(told) > 0
    assert work.finished(2) == [0] and work.read(2).count() == 100 and not (tmp_path / "out/part=1").exists()
    assert spark.range(10).count() == 10  # other jobs aren't touched


def test_a_failing_part(spark, tmp_path):
    work = progress.Parts(spark, str(tmp_path / "out"))
    broken = lambda df: df.select(F.when(F.col("id") == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="bad row"):
        work.run(spark.range(10), F.when(F.col("id") < 5, 0).otherwise(1), 2, broken)
    assert work.finished(2) == [0] and work.read(2).count() == 5
    assert work.run(spark.range(10), F.when(F.col("id") < 5, 0).otherwise(1), 2, lambda df: df.withColumnRenamed("id", "n")).done == [1]


def test_merge_that_is_cancelled(spark, tmp_path):
    """The beginning of the merge is there, with the page numbers of the whole."""
    sources = spark.createDataFrame([(i, f"f{i % 3}", "2-1" if i == 1 else "", 3) for i in range(8)], "seq int, path string, spec string, n_pages int")
    pages = spark.createDataFrame([(f"f{i}", p, f"text {i} {p}") for i in range(3) for p in range(3)], "path string, source_page int, text string")
    work, steps = progress.Parts(spark, str(tmp_path / "out")), []
    report = progress.merged_in_parts(work, sources, pages, 4, progress=steps.append, should_cancel=lambda: len(steps) >= 2)
    assert report.cancelled and report.total("segments") == 4 and report.total("rows") == 11
    got = work.read(4).orderBy("output_page").collect()
    assert [r["output_page"] for r in got] == list(range(11)) and [r["text"] for r in got[3:5]] == ["text 1 1", "text 1 0"]
    assert progress.merged_in_parts(work, sources, pages, 4).done == [2, 3] and work.read(4).count() == 23


def test_parts_of_keys_and_empty_tables(spark, tmp_path):
    work = progress.Parts(spark, str(tmp_path / "out"))
    assert work.read(3) is None
    report = work.run(spark.range(0), progress.part_of_key(F.col("id"), 3), 3, lambda df: df)
    assert report.done == [0, 1, 2] and report.total("rows") == 0 and work.read(3).count() == 0
    parts = {r["p"] for r in spark.range(100).select(progress.part_of_key(F.col("id"), 3).alias("p")).collect()}
    assert parts == {0, 1, 2}
    with pytest.raises(ValueError):
        work.run(spark.range(1), F.lit(0), 0, lambda df: df)
