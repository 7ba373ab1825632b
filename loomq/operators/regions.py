"""Recognised text on images: words to lines, layout blocks to regions, lines to paragraphs, and what may be translated."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomq.functions.text import blank, is_decoration
from loomq.operators.geometry import GAP_SHARE, HEIGHT_SHARE, centre_inside, nearest_below, runs

#: A gap between words of more than so many heights starts a new line.
GAP_HEIGHTS = 2.5
#: Layout labels whose text is translated, and the one whose lines also stand alone.
TRANSLATED_LABELS, SCATTERED_LABELS = ("text", "paragraph_title", "doc_title", "footer"), ("image",)
#: Lines of so few characters need such a score.
STRAY_CHARS, STRAY_SCORE = 2, 0.9
#: A region is eligible from this confidence and up to so many median heights.
LEAST_CONFIDENCE, MOST_HEIGHTS = 40.0, 4.0


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def ordered_text(order: Sequence[str], text: str = "text", separator: str = " ") -> Column:
    """The texts of a group in an order, joined."""
    entries = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return F.array_join(F.transform(entries, lambda e: e["__text"]), separator)


def word_lines(words: DataFrame) -> DataFrame:
    """Regions from words (doc_id, word_index, block_num, par_num, line_num, left, top, width, height, conf, text).

    Blank and decorative words are left out; a line is cut at wide gaps; the confidence is the mean of those not
    negative, 0 without any. line_order is the first word's index of the line, run the number of the part.
    """
    line = ["doc_id", "block_num", "par_num", "line_num"]
    kept = words.filter(~blank(F.col("text")) & ~is_decoration(F.col("text")))
    w = Window.partitionBy(*line).orderBy("left", "word_index")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(w)
    height = F.greatest(F.col("height"), F.lag("height").over(w), F.lit(1))
    cut = runs(kept, line, ["left", "word_index"], gap > GAP_HEIGHTS * height)
    cut = cut.withColumn("line_order", F.min("word_index").over(Window.partitionBy(*line)))
    return cut.groupBy(*line, "line_order", "run").agg(
        ordered_text(["left", "word_index"]).alias("text"), F.min("left").alias("x"), F.min("top").alias("y"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
        F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("confidence"),
    )


def paragraph_links(regions: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """keys, order, next_order: which region continues which. A region is claimed by the first one that proposes it."""
    near = nearest_below(regions, keys, order).join(regions.select(*keys, order, "height"), [*keys, order])
    proposed = near.filter(F.col("gap") < GAP_SHARE * F.col("height"))
    return proposed.groupBy(*keys, "next_order").agg(F.min(order).alias(order)).select(*keys, order, "next_order")


def _chains(pdf: pd.DataFrame, order: str) -> pd.DataFrame:
    follows = dict(zip(pdf["next_order"], pdf[order]))
    chain: dict[int, tuple[int, int]] = {}
    for start in sorted(pdf["__own"]):
        path = [start]
        while path[-1] in follows and path[-1] not in chain:
            path.append(follows[path[-1]])
        head, depth = chain.get(path[-1], (path[-1], 0))
        chain[path[-1]] = (head, depth)
        for k, node in enumerate(reversed(path[:-1]), 1):
            chain[node] = (head, depth + k)
    out = pdf.drop(columns=[order, "next_order"]).rename(columns={"__own": order})
    out["chain"] = [chain[i][0] for i in out[order]]
    out["place"] = [chain[i][1] for i in out[order]]
    return out


def paragraph_chains(regions: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The regions with chain (the order of its first region) and place. One group is one image's regions."""
    links = paragraph_links(regions, keys, order)
    pairs = regions.select(*keys, F.col(order).alias("__own")).join(links.withColumn("__own", F.col("next_order")), [*keys, "__own"], "left")
    types = {f.name: f.dataType.simpleString() for f in regions.schema}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{order} {types[order]}", "chain long", "place long"])
    placed = pairs.groupBy(*keys).applyInPandas(lambda pdf: _chains(pdf.astype({order: "Int64", "next_order": "Int64"}), order)[[*keys, order, "chain", "place"]], schema)
    return regions.join(placed, [*keys, order])


def merged_regions(chained: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One region for each chain: joined text, union box, mean confidence and rounded mean height."""
    return chained.groupBy(*keys, "chain").agg(
        ordered_text(["place"]).alias("text"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
        F.avg("confidence").alias("confidence"), half_even(F.avg("height")).alias("line_height"), F.count(F.lit(1)).alias("members"),
    )


def eligibility(regions: DataFrame, keys: Sequence[str], least: float = LEAST_CONFIDENCE, ratio: float = MOST_HEIGHTS) -> DataFrame:
    """The regions with reason: layout, low_confidence, outlier_height or ok, the first that holds.

    The median height is that of confident translatable regions; without any there is no limit.
    """
    height = F.coalesce(F.col("line_height"), F.col("height"))
    sure = F.col("translatable") & (F.col("confidence") >= least)
    medians = regions.filter(sure).groupBy(*keys).agg(F.median(height).alias("median_height"))
    reason = (
        F.when(~F.col("translatable"), "layout")
        .when(F.col("confidence") < least, "low_confidence")
        .when(F.col("median_height").isNotNull() & (height > ratio * F.col("median_height")), "outlier_height")
        .otherwise("ok")
    )
    return regions.join(medians, list(keys), "left").withColumn("reason", reason)


def usable_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_index, x0..y1, text, score) without stray glyphs."""
    return lines.filter((F.length(F.trim("text")) > STRAY_CHARS) | (F.col("score") >= STRAY_SCORE))


def block_regions(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regions of layout blocks (doc_id, block_index, label, x0..y1) from the lines whose centre they hold.

    A block's lines are cut where heights differ much. A block in one run keeps its own box, otherwise each run has the
    box around its lines. Other labels than the translated ones give regions that aren't translatable.
    """
    met = centre_inside(lines, blocks, ["doc_id"]).select("b.doc_id", "b.block_index", "b.label", F.struct("b.x0", "b.y0", "b.x1", "b.y1").alias("block"), "a.line_index", "a.x0", "a.y0", "a.x1", "a.y1", "a.text", "a.score")
    keys = ["doc_id", "block_index"]
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "line_index")
    height = F.col("y1") - F.col("y0")
    before = F.lag(height).over(w)
    larger, smaller = F.greatest(height, before), F.least(height, before)
    cut = runs(met, keys, ["y0", "x0", "line_index"], before.isNotNull() & ((larger <= 0) | (smaller < HEIGHT_SHARE * larger)))
    cut = cut.withColumn("n_runs", F.max("run").over(Window.partitionBy(*keys)) + 1)
    box = F.when(F.col("n_runs") == 1, F.first("block")).otherwise(F.struct(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")))
    filled = F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "line_index", "text"))), lambda e: e["text"]), lambda t: t != ""), " ")
    grouped = cut.groupBy(*keys, "label", "run", "n_runs").agg(
        filled.alias("text"), F.first("block").alias("own"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
        (F.avg("score") * 100).alias("confidence"), half_even(F.avg(height)).alias("line_height"),
    )
    single = F.col("n_runs") == 1
    sides = {c: F.when(single, F.col(f"own.{c}")).otherwise(F.col(c)) for c in ("x0", "y0", "x1", "y1")}
    shown = grouped.filter(~blank(F.col("text")))
    return shown.select(
        *keys, "label", "run", "text", half_even(sides["x0"]).alias("x"), half_even(sides["y0"]).alias("y"), half_even(sides["x1"] - sides["x0"]).alias("width"),
        half_even(sides["y1"] - sides["y0"]).alias("height"), "confidence", "line_height", F.col("label").isin(*TRANSLATED_LABELS).alias("translatable"),
    )


def _line_region(lines: DataFrame) -> DataFrame:
    return lines.select(
        "doc_id", "line_index", "text", half_even(F.col("x0")).alias("x"), half_even(F.col("y0")).alias("y"), half_even(F.col("x1") - F.col("x0")).alias("width"),
        half_even(F.col("y1") - F.col("y0")).alias("height"), (F.col("score") * 100).alias("confidence"),
    )


def orphan_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines with a text that no block holds, as regions."""
    met = centre_inside(lines, blocks, ["doc_id"]).select("a.doc_id", "a.line_index").distinct()
    return _line_region(lines.filter(~blank(F.col("text"))).join(met, ["doc_id", "line_index"], "left_anti"))


def scattered_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines in a block of scattered text that no translated block claims, as regions of their own."""
    claimed = centre_inside(lines, blocks.filter(F.col("label").isin(*TRANSLATED_LABELS)), ["doc_id"]).select("a.doc_id", "a.line_index").distinct()
    inside = centre_inside(lines, blocks.filter(F.col("label").isin(*SCATTERED_LABELS)), ["doc_id"]).select("a.doc_id", "a.line_index").distinct()
    own = inside.join(claimed, ["doc_id", "line_index"], "left_anti")
    return _line_region(lines.filter(~blank(F.col("text"))).join(own, ["doc_id", "line_index"], "left_semi"))


def layout_regions(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """All regions of a recognised page: blocks, scattered lines, and orphan lines merged to paragraphs."""
    kept = usable_lines(lines)
    columns = ["doc_id", "text", "x", "y", "width", "height", "confidence", "line_height", "translatable", "origin"]
    from_blocks = block_regions(kept, blocks).withColumn("origin", F.lit("block"))
    yes, own_height = F.lit(True).alias("translatable"), F.col("height").alias("line_height")
    scattered = scattered_lines(kept, blocks).select("*", own_height, yes, F.lit("line").alias("origin"))
    orphans = merged_regions(paragraph_chains(orphan_lines(kept, blocks), ["doc_id"], "line_index"), ["doc_id"]).select("*", yes, F.lit("orphan").alias("origin"))
    return from_blocks.select(*columns).unionByName(scattered.select(*columns)).unionByName(orphans.select(*columns))


def annotated_paragraph(paragraph: Column) -> Column:
    """A region from a recognised paragraph: struct(box: array of points, confidence, words: array<struct<box, symbols>>).

    Decorative words are left out; without any other word the region is null. The line height is the rounded mean of
    the words' heights.
    """
    words = F.filter(paragraph["words"], lambda w: (F.array_join(w["symbols"], "") != "") & ~is_decoration(F.array_join(w["symbols"], "")))

    def side(points: Column, name: str, f) -> Column:
        return f(F.transform(points, lambda p: F.coalesce(p[name], F.lit(0))))

    heights = F.transform(F.filter(words, lambda w: F.size(w["box"]) > 0), lambda w: side(w["box"], "y", F.array_max) - side(w["box"], "y", F.array_min))
    x0, y0 = side(paragraph["box"], "x", F.array_min), side(paragraph["box"], "y", F.array_min)
    mean = F.when(F.size(heights) > 0, F.aggregate(heights, F.lit(0.0), lambda a, h: a + h) / F.size(heights))
    region = F.struct(
        F.array_join(F.transform(words, lambda w: F.array_join(w["symbols"], "")), " ").alias("text"), x0.alias("x"), y0.alias("y"),
        (side(paragraph["box"], "x", F.array_max) - x0).alias("width"), (side(paragraph["box"], "y", F.array_max) - y0).alias("height"),
        (F.coalesce(paragraph["confidence"], F.lit(0.0)) * 100).alias("confidence"), half_even(mean).alias("line_height"),
    )
    return F.when((F.size(words) > 0) & (F.size(paragraph["box"]) > 0), region)


def dry_run_characters(regions: DataFrame, keys: Sequence[str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Characters that a run would send at most: of confident regions, whatever their height or layout."""
    return regions.filter(F.col("confidence") >= least).groupBy(*keys).agg(F.sum(F.length("text")).alias("characters"))


def initial_font_size(line_height: Column) -> Column:
    return F.least(F.greatest(F.floor(line_height * 0.8), F.lit(9)), F.lit(48)).cast("int")
