"""Corrections of translated pages: blocks and records stored by page, joined where they lie, and fitted anew."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomq.functions.text import plain_to_html, without_tags
from loomq.operators.fitting import fit_blocks
from loomq.operators.geometry import below_on_page
from loomq.session import shared_folder

PAGE = ("doc_id", "page_index")
BLOCK = (*PAGE, "block_index")


def store_pages(rows: DataFrame, name: str, buckets: int, folder: str | None = None) -> DataFrame:
    """Rows of pages as a table in so many buckets by (doc_id, page_index), sorted within, one file each.

    Tables with the same number of buckets are joined page by page without a shuffle, and a page's rows lie together.
    Rows without a document or page can't be found again and are left out. The table is an external one in a folder of
    its own, by default in the shared folder, which goes with the application. A page has to fit one task.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a table's name: {name!r}")
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    placed = rows.dropna(subset=list(PAGE)).repartition(buckets, *PAGE)
    placed.write.mode("overwrite").bucketBy(buckets, *PAGE).sortBy(*BLOCK).saveAsTable(name, path=folder or shared_folder(spark, name))
    return spark.table(name)


def corrected_pages(records: DataFrame, edits: DataFrame, blocks: DataFrame, limit: str = "limit") -> DataFrame:
    """Every record's block with edited, new_html, next_y0, final_y1, final_font and fits.

    blocks: all blocks of the pristine pages, x0..y1, font_size and the page's limit. records: html of the blocks that a
    translation replaced. edits: edited_text; one that is equal to the record's shown text keeps its HTML, and so its
    marks. A record is fitted against where all blocks of its page were, not where the first translation grew to. From
    tables of store_pages() a page is read once and only the edits are shuffled. A record without a block, and an edit
    without a record, has no effect; of several for one block the greatest text counts.
    """
    joined = blocks
    for rows, name in ((records, "html"), (edits, "edited_text")):  # by page, as the tables lie
        lists = rows.groupBy(*PAGE).agg(F.collect_list(F.struct("block_index", name)).alias(f"__{name}"))
        own = F.filter(f"__{name}", lambda r: r["block_index"] == F.col("block_index"))
        joined = joined.join(lists, list(PAGE), "left").withColumn(name, F.array_max(F.transform(own, lambda r: r[name]))).drop(f"__{name}")  # noqa: B023
    edited = F.col("html").isNotNull() & F.col("edited_text").isNotNull() & (F.col("edited_text") != without_tags(F.col("html")))
    named = joined.withColumn("edited", F.coalesce(edited, F.lit(False)))
    named = named.withColumn("new_html", F.when(F.col("edited"), plain_to_html(F.col("edited_text"))).otherwise(F.col("html")))
    near = below_on_page(named, list(PAGE), "block_index").filter("new_html is not null")
    shown = near.withColumn("__text", F.when(F.col("edited"), F.col("edited_text")).otherwise(without_tags(F.col("new_html"))))
    return fit_blocks(shown, list(PAGE), "block_index", "__text", limit).drop("__text", "html", "edited_text", "cap_y1")


def correction_stats(corrected: DataFrame) -> DataFrame:
    """By document: translated (records applied), edited, and overflow_blocks, those that don't fit."""
    return corrected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("translated"), F.count_if("edited").alias("edited"), F.count_if(~F.col("fits")).alias("overflow_blocks"))
