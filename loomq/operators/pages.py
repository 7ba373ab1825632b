"""From the lines of pages to text blocks and to the texts that a search looks into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomq.functions.text import blank, stripped
from loomq.operators.geometry import met_by, on_both, under_bands
from loomq.operators.layout import column_groups, in_zone, metadata_lines, status_runs

PAGE = ["doc_id", "page_index"]
BLOCK = [*PAGE, "block_index"]
#: A page's keys as one, in which null equals null: rows dealt by it once serve all joins and windows of pages and blocks.
DEALT = "__page"


def _joined(order: Sequence[str], text: str = "text", keep: Column | None = None, separator: str = "\n") -> Column:
    entry = F.struct(*order, F.col(text).alias("__t"))
    entries = F.sort_array(F.collect_list(entry if keep is None else F.when(keep, entry)))
    return F.array_join(F.transform(entries, lambda e: e["__t"]), separator)


def split_lines(lines: DataFrame, bands: DataFrame, links: DataFrame, anchors: Sequence[str] = ()) -> DataFrame:
    """The lines (doc_id, page_index, block_index, line_index, x0..y1, text) with the parts they fall into.

    column_group, part (0 is the first page's metadata), highlighted with its run, is_link with its run. bands and
    links: doc_id, page_index, x0..y1.
    """
    return _split_lines(lines, bands, links, anchors).drop(DEALT)


def _split_lines(lines: DataFrame, bands: DataFrame, links: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """split_lines() with the column by which the rows are dealt."""
    lines, bands, links = (x.withColumn(DEALT, F.struct(*PAGE)) for x in (lines, bands, links))
    flagged = met_by(under_bands(lines, bands, [DEALT]), links, [DEALT], on_both, "is_link")
    grouped = column_groups(flagged, BLOCK, "line_index", dealt_by=[DEALT]).repartition(DEALT)
    keys = [DEALT, *BLOCK, "column_group"]
    if anchors:
        marked = metadata_lines(grouped, keys, "line_index", anchors)
        is_metadata = F.col("is_metadata") & (F.col("page_index") == 0)
        grouped = marked.withColumn("part", F.when(is_metadata, 0).otherwise(1)).drop("is_metadata")
    else:
        grouped = grouped.withColumn("part", F.lit(1))
    keys += ["part"]
    lit = status_runs(grouped, keys, "line_index", "highlighted").withColumnRenamed("run", "band_run")
    return status_runs(lit, [*keys, "band_run"], "line_index", "is_link").withColumnRenamed("run", "link_run")


def page_blocks(lines: DataFrame, bands: DataFrame, links: DataFrame, anchors: Sequence[str] = (), zones: DataFrame | None = None) -> DataFrame:
    """Text blocks: runs of lines of one column, part, highlight and link state that have a text.

    Links, metadata and what lies in a zone (doc_id, x0..y1) aren't translatable. insert_y0 is where a block whose first
    line is blank starts. place numbers a page's blocks in reading order.
    """
    keys = [DEALT, *BLOCK, "column_group", "part", "band_run", "link_run"]
    first = F.min(F.struct("line_index", "y0"))
    shown = F.min(F.when(~blank(F.col("text")), F.struct("line_index", "y0")))
    made = _split_lines(lines, bands, links, anchors).groupBy(*keys, "highlighted", "is_link").agg(
        stripped(_joined(["line_index"])).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        first.alias("f"), shown.alias("s"),
    )
    made = made.filter(F.col("text") != "").withColumn("insert_y0", F.when(F.col("s.line_index") != F.col("f.line_index"), F.col("s.y0"))).drop("f", "s")
    free = ~F.col("is_link") & (F.col("part") == 1)
    w = Window.partitionBy(DEALT).orderBy("block_index", "column_group", "part", "band_run", "link_run")
    out = made.withColumn("place", F.row_number().over(w)).drop(DEALT)
    if zones is None:
        return out.withColumn("translatable", free)
    return met_by(out, zones, ["doc_id"], in_zone, "__inside").withColumn("translatable", free & ~F.col("__inside")).drop("__inside")


def page_scopes(lines: DataFrame, bands: DataFrame, links: DataFrame, zones: DataFrame, anchors: Sequence[str]) -> DataFrame:
    """doc_id with ico_format, header and full_text; null where a document has none.

    ico_format is the first page's metadata after what stands in the blocks before the first one with metadata. header
    is what lies in the header zone of the first page where anything does. full_text is all blocks in reading order.
    """
    blocks = page_blocks(lines, bands, links)
    full = blocks.groupBy("doc_id").agg(F.nullif(_joined(["page_index", "place"]), F.lit("")).alias("full_text"))

    head = zones.filter("zone = 'header'").select("doc_id", *[F.col(c).alias(f"z{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = blocks.join(head, "doc_id").filter("x0 < zx1 and x1 > zx0 and y0 < zy1 and y1 > zy0")
    first_page = inside.withColumn("__p", F.min("page_index").over(Window.partitionBy("doc_id"))).filter("page_index = __p")
    header = first_page.groupBy("doc_id").agg(_joined(["place"]).alias("header"))

    parts = split_lines(lines.filter("page_index = 0"), bands, links, anchors)
    anchored = parts.filter("part = 0").groupBy("doc_id").agg(F.min("block_index").alias("first_block"))
    groups = parts.join(anchored, "doc_id").groupBy("doc_id", "first_block", "block_index", "column_group", "part").agg(_joined(["line_index"]).alias("chunk"))
    kept = groups.filter((F.col("part") == 0) | ((F.col("block_index") < F.col("first_block")) & ~blank(F.col("chunk"))))
    kept = kept.withColumn("side", F.col("part") == 0).withColumn("chunk", F.when(F.col("part") == 0, F.col("chunk")).otherwise(stripped(F.col("chunk"))))
    metadata = kept.groupBy("doc_id").agg(_joined(["side", "block_index", "column_group"], "chunk").alias("ico_format"))
    return full.join(header, "doc_id", "left").join(metadata, "doc_id", "left").select("doc_id", "ico_format", "header", "full_text")


def corrections(records: DataFrame, edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a correction run writes: the records (page_index, block_index, html) whose text was edited, with their
    block's box; an edit equal to the shown text keeps the record's own HTML."""
    from loomq.functions.text import plain_to_html, without_tags

    keys = ["doc_id", "page_index", "block_index"]
    joined = records.join(blocks.select(*keys, "x0", "y0", "x1", "y1"), keys).join(edits.select(*keys, "edited_text"), keys, "left")
    changed = F.col("edited_text").isNotNull() & (F.col("edited_text") != without_tags(F.col("html")))
    return joined.withColumn("new_html", F.when(changed, plain_to_html(F.col("edited_text"))).otherwise(F.col("html")))
