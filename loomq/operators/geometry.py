"""Joins and windows over boxes: containment, overlap, nearest neighbours, free room and runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates that give the smallest box around many."""
    low = [F.min(f"{prefix}{c}").alias(c) for c in ("x0", "y0")]
    return low + [F.max(f"{prefix}{c}").alias(c) for c in ("x1", "y1")]


def overlaps(a: str, b: str, x: float = 0.0, y: float = 0.0) -> Column:
    """Whether two boxes overlap by more than x and y on the two axes; columns are a.x0 and so on."""
    width = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    height = F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")
    return (width > x) & (height > y)


def _same(keys: Sequence[str], a: str = "a", b: str = "b") -> Column:
    equal = [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    out = equal[0]
    for e in equal[1:]:
        out &= e
    return out


def centre_inside(lines: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines with the blocks whose box holds their centre, bounds included: all columns of both, as a and b structs.

    An equi-join on the page's keys; a pair is made only where the box holds the centre.
    """
    x, y = ((F.col(f"a.{c}0") + F.col(f"a.{c}1")) / 2 for c in "xy")
    inside = x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    return lines.alias("a").join(blocks.alias("b"), _same(keys) & inside).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))


def touching(rows: DataFrame, marks: DataFrame, keys: Sequence[str], x: float = 1.0, y: float = 1.0) -> DataFrame:
    """Rows that some mark overlaps by more than x and y, as links lie on lines: a left semi join."""
    return rows.alias("a").join(marks.alias("b"), _same(keys) & overlaps("a", "b", x, y), "left_semi")


def met_by(rows: DataFrame, marks: DataFrame, keys: Sequence[str], met: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], name: str) -> DataFrame:
    """Rows with a column that says whether some mark of equal keys meets them; met gets the columns of a row and a mark.

    One existence join: what the rows come from is computed and moved once, however many marks meet a row.
    """

    def own(column: str) -> Column:
        return F.col(f"a.{column}").outer()

    def other(column: str) -> Column:
        return F.col(f"b.{column}")

    found = met(own, other)
    for k in keys:
        never_null = not (rows.schema[k].nullable or marks.schema[k].nullable)
        found &= own(k) == other(k) if never_null else own(k).eqNullSafe(other(k))
    return rows.alias("a").select("a.*", marks.alias("b").where(found).exists().alias(name))


def on_height(own: Callable[[str], Column], other: Callable[[str], Column], y: float = 1.5) -> Column:
    return F.least(own("y1"), other("y1")) - F.greatest(own("y0"), other("y0")) > y


def on_both(own: Callable[[str], Column], other: Callable[[str], Column], x: float = 1.0, y: float = 1.0) -> Column:
    return (F.least(own("x1"), other("x1")) - F.greatest(own("x0"), other("x0")) > x) & on_height(own, other, y)


def under_bands(rows: DataFrame, bands: DataFrame, keys: Sequence[str], y: float = 1.5) -> DataFrame:
    """Rows with a column highlighted: some band overlaps them by more than y in height, wherever it is in width."""
    return met_by(rows, bands, keys, lambda a, b: on_height(a, b, y), "highlighted")


def band_extent(blocks: DataFrame, bands: DataFrame, keys: Sequence[str], block_id: str, y: float = 1.5) -> DataFrame:
    """For each block the box around the bands that overlap it in height; nulls where none does."""
    height = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    met = blocks.alias("a").join(bands.alias("b"), _same(keys) & (height > y), "left")
    by = [F.col(f"a.{k}") for k in (*keys, block_id)]
    return met.groupBy(*by).agg(*[f(f"b.{c}").alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def next_below(blocks: DataFrame, keys: Sequence[str], block_id: str, wide: tuple[str, str] | None = None) -> DataFrame:
    """For each block the top of the nearest one below that shares some width with it; null if there is none.

    wide names columns with the width that counts for a block instead of its own, where they aren't null.
    """
    x0, x1 = (F.coalesce(F.col(f"a.{w}"), F.col(f"a.{c}")) if w else F.col(f"a.{c}") for w, c in zip(wide or (None, None), ("x0", "x1")))
    below = (F.col("b.y0") >= F.col("a.y1")) & (F.col("b.x0") < x1) & (F.col("b.x1") > x0)
    other = F.col(f"a.{block_id}") != F.col(f"b.{block_id}")
    met = blocks.alias("a").join(blocks.alias("b"), _same(keys) & other & below, "left")
    return met.groupBy(*[F.col(f"a.{k}") for k in (*keys, block_id)]).agg(F.min("b.y0").alias("next_y0"))


def below_on_page(blocks: DataFrame, keys: Sequence[str], block_id: str) -> DataFrame:
    """The blocks with next_y0 as in next_below(), from a window over the page: blocks that lie together aren't moved.

    Each row sees its page's boxes, so a page has to be of a size that a task can hold.
    """
    boxes = F.collect_list(F.struct("x0", "x1", "y0", F.col(block_id).alias("id"))).over(Window.partitionBy(*keys))
    seen = blocks.withColumn("__boxes", boxes)
    below = F.filter("__boxes", lambda b: (b["id"] != F.col(block_id)) & (b["y0"] >= F.col("y1")) & (b["x0"] < F.col("x1")) & (b["x1"] > F.col("x0")))
    return seen.withColumn("next_y0", F.array_min(F.transform(below, lambda b: b["y0"]))).drop("__boxes")


#: Regions belong to a paragraph if the gap is below this share of the height and heights differ by no more than that.
GAP_SHARE, HEIGHT_SHARE = 0.6, 0.6


def nearest_below(regions: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """For each region the nearest one below in the same column with a like height: order, next_order and gap.

    Regions have x, y, width and height. The first in order wins among equally near ones.
    """
    a, b = ({c: F.col(f"{t}.{c}") for c in ("x", "y", "width", "height")} for t in "ab")
    column = (b["x"] < a["x"] + a["width"]) & (b["x"] + b["width"] > a["x"])
    below = b["y"] >= a["y"] + a["height"]
    alike = F.least(a["height"], b["height"]) >= HEIGHT_SHARE * F.greatest(a["height"], b["height"])
    tall = F.greatest(a["height"], b["height"]) > 0
    pairs = regions.alias("a").join(regions.alias("b"), _same(keys) & (F.col(f"a.{order}") != F.col(f"b.{order}")) & column & below & alike & tall)
    found = pairs.select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{order}").alias(order), F.col(f"b.{order}").alias("next_order"), (b["y"] - a["y"] - a["height"]).alias("gap"))
    best = F.min(F.struct("gap", "next_order")).alias("best")
    return found.groupBy(*keys, order).agg(best).select(*keys, order, "best.next_order", "best.gap")


#: Room that is left free at a neighbour (but 1 below it), and how often its height a region without a neighbour below may grow by.
MARGIN, FREE_HEIGHTS = 3, 4.0


def rooms(regions: DataFrame, keys: Sequence[str], order: str, image_width: str, image_height: str, obstacles: DataFrame | None = None) -> DataFrame:
    """How far each region may grow: room_below, room_above, room_left and room_right, never negative.

    Neighbours, which are the other regions and the obstacles (keys, x, y, width, height), count on the two sides where
    they share some width or height. Without one there are four heights below and above, up to the image's edge, and the
    way to the edge at the sides.
    """
    sides = ("x", "y", "width", "height")
    near = regions.select(*keys, order, *sides)
    if obstacles is not None:
        near = near.unionByName(obstacles.select(*keys, *sides), allowMissingColumns=True)
    other = ~F.col(f"a.{order}").eqNullSafe(F.col(f"b.{order}"))
    a, b = ({c: F.col(f"{t}.{c}") for c in ("x", "y", "width", "height")} for t in "ab")
    right, bottom = a["x"] + a["width"], a["y"] + a["height"]
    b_right, b_bottom = b["x"] + b["width"], b["y"] + b["height"]
    column = (b["x"] < right) & (b_right > a["x"])
    row = (b["y"] < bottom) & (b_bottom > a["y"])
    met = regions.alias("a").join(near.alias("b"), _same(keys) & other & (column | row), "left")
    kept = [F.col(f"a.{k}") for k in (*keys, order, "x", "y", "width", "height", image_width, image_height)]
    near = met.groupBy(*kept).agg(
        F.min(F.when(column & (b["y"] >= bottom), b["y"] - bottom)).alias("below"),
        F.min(F.when(column & (b_bottom <= a["y"]), a["y"] - b_bottom)).alias("above"),
        F.min(F.when(row & (b_right <= a["x"]), a["x"] - b_right)).alias("left"),
        F.min(F.when(row & (b["x"] >= right), b["x"] - right)).alias("right"),
    )
    free = FREE_HEIGHTS * F.col("height")
    edge_right, edge_bottom = F.col(image_width) - F.col("x") - F.col("width"), F.col(image_height) - F.col("y") - F.col("height")
    # greatest() skips nulls, so a missing neighbour has to be asked for.
    below = F.least(F.when(F.col("below").isNull(), free).otherwise(F.greatest(F.col("below") - MARGIN, F.lit(1.0))), edge_bottom)
    above = F.when(F.col("above").isNull(), F.least(free, F.col("y"))).otherwise(F.greatest(F.col("above") - MARGIN, F.lit(0.0)))
    sides = [F.least(F.coalesce(c, e), e) - MARGIN for c, e in ((F.col("left"), F.col("x")), (F.col("right"), edge_right))]
    zero = F.lit(0.0)
    values = (("room_below", below), ("room_above", above), ("room_left", sides[0]), ("room_right", sides[1]))
    return near.select(*keys, order, *[F.greatest(v, zero).cast("double").alias(n) for n, v in values])


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Column, name: str = "run") -> DataFrame:
    """Number the runs of ordered rows; breaks says, by lag() over the same window, that a row starts a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(breaks.cast("int"), F.lit(0)))
    marked = df.withColumn("__starts", starts)
    return marked.withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__starts")


def window_of(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)
