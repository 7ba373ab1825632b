import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomq.llm import sharding as s

SF = "/root/testdata/sf0.001"


def brute(rows: list[tuple], count: int) -> list[tuple]:
    """doc_id, size, crc, shard, slot of all rows, added up one after the other."""
    sized = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, before, slots, out = sum(r[1] for r in sized), 0, [0] * count, []
    for i, size, crc in sized:
        shard = (2 * before + size) * count // (2 * total)
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard], before = slots[shard] + 1, before + size
    return out


def of(df, count: int = s.SHARDS) -> list[tuple]:
    got = s.shards(df, count).collect()
    assert {r["law"] for r in got} <= {"bytes"} and all(r["grown_shard"] is None for r in got)
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=lambda r: r[3:])


@pytest.mark.parametrize("count", [1, 3, 8])
def test_against_running_sum(docs, rows, count):
    assert of(docs.repartition(7), count) == brute(rows, count)


def test_balance(docs):
    got = of(docs)
    sizes = [sum(r[1] for r in got if r[3] == n) for n in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got) and sum(sizes) == sum(r[1] for r in got)


def test_against_sql(spark, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, s.shards(docs).collect())) == sorted(con.sql(s.ORACLE).fetchall())


def test_odd(odd, empty):
    """Null ids come first, repeated rows are rows, names that clash do no harm."""
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert of(odd) == brute(data, 8) and of(empty) == []


def test_one_key_over_all_ranges(spark):
    """Nine of ten rows alike are dealt over the ranges by their place, and over the shards by their bytes."""
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(77)).alias("doc_id"), F.lit("same text").alias("text"))
    got = of(df)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()], 8)
    ranges = s.prefix_sums(s.measured(df)).groupBy(F.floor(F.col("rows_before") / 1250)).count().collect()
    assert len(ranges) == 4 and {r["count"] for r in ranges} == {1250}


def test_long_row_and_few_rows(spark):
    df = spark.createDataFrame([(1, "a" * 90), (2, "b"), (3, None)], "doc_id long, text string")
    assert of(df) == brute([(1, "a" * 90), (2, "b"), (3, None)], 8)
    with pytest.raises(ValueError):
        s.shards(df, 0)


def test_written_shards(spark, odd, tmp_path):
    """The files hold all rows and columns, and slots are gapless in each shard."""
    s.write_shards(odd, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: repr(sorted(r.items()))
    assert sorted((key(r.asDict()) for r in back.select(odd.columns).collect())) == sorted(key(r.asDict()) for r in odd.collect())
    slots = back.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("slots")).collect()
    assert all(r["slots"] == list(range(len(r["slots"]))) for r in slots)
