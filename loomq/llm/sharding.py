"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are brought in one global order by ranges; a task adds up the bytes and the rows of its own range only. The totals of
the ranges, one row each, give what lies before every range, and so what lies before every row in the whole table. The
bytes are cut at equal targets: a row belongs to the shard in whose part of the bytes its middle lies, so a cut is off by
half a row at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomq.llm.common import documents_of
from loomq.session import expose_package, store

SHARDS = 8
#: The global order: ids, null first; rows of one id by checksum and size, and rows alike in these as they are stored.
ORDER = ("doc_id", "text_crc32", "size", "place")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and, as a struct named carried, further columns; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    if not carry:
        return documents_of(df, id_col, text_col).select("doc_id", *sizes)
    more = F.struct(*[F.col(f"`{c}`") for c in carry])
    return documents_of(df.withColumn("__carried", more), id_col, text_col, carried="__carried").select("doc_id", *sizes, "carried")


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows with the bytes and rows before them in their range; only two sums are kept."""
    before, rows = 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False)
        ends = before + np.cumsum(size)
        place = np.arange(rows, rows + len(size))
        columns = [*batch.columns, pa.array(ends - size, pa.int64()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "bytes_before", "rows_before"])
        if len(size):
            before, rows = int(ends[-1]), rows + len(size)


def shard_of(start: Column, size: Column, total: Column, count: int) -> Column:
    """The part of the whole bytes in which the middle of a row lies, in whole numbers."""
    wide = "decimal(38,0)"
    return F.floor(((2 * start + size).cast(wide) * F.lit(count).cast("decimal(10,0)")) / (2 * total).cast("decimal(20,0)")).cast("int")


def prefix_sums(rows: DataFrame) -> DataFrame:
    """The measured rows with bytes_before and rows_before over the whole table, in its global order, and total.

    The rows are numbered and stored with their numbers, so that rows alike can be split between ranges, however many there are,
    and a range that is computed again after a loss is the same.
    """
    spark = rows.sparkSession
    expose_package(spark)
    numbered = store(rows.withColumn("place", F.monotonically_increasing_id()), "sizes")
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("place").withColumn("range", F.spark_partition_id())
    schema = StructType([*dealt.schema.fields, StructField("bytes_before", LongType()), StructField("rows_before", LongType())])
    placed = store(dealt.mapInArrow(running, schema), "ranges")
    totals = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shuffle partition
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "range", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("range_bytes"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("range_rows"), F.sum("bytes").over(whole).alias("total")
    )
    joined = placed.join(F.broadcast(starts), "range")  # as many rows as shuffle partitions, by construction
    return joined.withColumn("bytes_before", F.col("bytes_before") + F.col("range_bytes")).withColumn("rows_before", F.col("rows_before") + F.col("range_rows")).drop("range", "range_bytes", "range_rows")


def dealt(df: DataFrame, count: int, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """The measured rows, with their carried columns as a struct, and shard and slot."""
    if count < 1:
        raise ValueError("at least one shard")
    summed = prefix_sums(measured(df, id_col, text_col, carry))
    cut = summed.withColumn("shard", shard_of(F.col("bytes_before"), F.col("size"), F.col("total"), count))
    first = cut.groupBy("shard").agg(F.min("rows_before").alias("first"))
    return cut.join(F.broadcast(first), "shard").withColumn("slot", F.col("rows_before") - F.col("first"))  # as many rows as shards


def shards(df: DataFrame, count: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard, from 0, and its slot in it, gapless from 0: doc_id, size, text_crc32, law, shard, slot,
    grown_shard.

    The law is bytes: a shard's sizes (UTF-8 bytes plus 1) sum to the equal share within one row's size. Shards are
    contiguous in the order of ids, null ids first; rows of one id follow each other by checksum and size, rows alike as
    they lie in the table. Null and empty texts have size 1; repeated rows are rows of their own; an empty table gives no
    rows. A row longer than a share leaves shards that hold nothing. Two passes move some twenty bytes a row and no
    text. No key can fill a range, as rows alike are ordered by their place.
    """
    kept = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return dealt(df, count, id_col, text_col, ()).select(*kept)


def write_shards(df: DataFrame, folder: str, count: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The table's shards as Parquet below folder/shard=N, each row with its slot, in as many files as ranges meet there.

    The columns of the table move with the sizes here. Columns named shard or slot are replaced.
    """
    named = [c for c in df.columns if c not in ("shard", "slot")]
    dealt(df, count, id_col, text_col, named).select("shard", "slot", "carried.*").write.partitionBy("shard").parquet(folder)


#: A crc32 by SQL: the table of the polynomial (a fixed value), then a fold over the bytes.
_TABLE = "(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) FROM range(256) t(b))"
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents),
polynomial AS (SELECT {_TABLE} AS entries),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c // 256, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM sized, polynomial),
placed AS (
  SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total, row_number() OVER o AS place
  FROM summed WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
dealt AS (SELECT *, ((2 * before + size) * {SHARDS} // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt"""
