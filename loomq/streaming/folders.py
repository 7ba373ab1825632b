"""Searching and counting as files or events arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomq.operators.search import search


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Documents from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def search_stream(docs: DataFrame, query: str, scopes: Sequence[str] = ("full_text",)) -> DataFrame:
    """The same search as over a table; it keeps no state."""
    return search(docs, query, scopes)


def usage_stream(events: DataFrame, at: str = "ts", provider: str = "provider", amount: str = "characters", late: str = "7 days") -> DataFrame:
    """Characters by provider and day, for events at most so late; state is dropped behind the watermark."""
    days = events.withWatermark(at, late).groupBy(F.window(at, "1 day"), F.col(provider).alias("provider"))
    return days.agg(F.sum(amount).alias("characters")).select(F.to_date("window.start").alias("day"), "provider", "characters")


def first_seen(docs: DataFrame, text: str = "text", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each text once as it first arrives, within the watermark."""
    return docs.withColumn("digest", F.md5(F.encode(F.col(text), "UTF-8"))).withWatermark(at, late).dropDuplicatesWithinWatermark(["digest"])


def to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """A writer that takes all there is and stops; started again it goes on where it was."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True)
