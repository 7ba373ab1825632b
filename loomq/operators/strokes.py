"""Statistics of the strokes in image regions, and the font style that they speak for.

A region is given by its scan lines: one row holds one line's values, so that an image of any size is dealt by rows. A
value is ink where it differs from the background by more than a threshold. All statistics are aggregates by region that
are combined before the shuffle; no task needs a whole region.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.session import store

#: What makes a value ink, the share of the strongest row or column that a row or column at the edge needs,
#: the bands in which a slant is measured, the least heights for an edge and for a slant, and what keeps a ratio finite.
INK_THRESHOLD, EDGE_SHARE, BANDS, LEAST_EDGE_HEIGHT, LEAST_SLANT_HEIGHT, TINY = 40.0, 0.08, 4, 6, 8, 1e-6


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """The luminance of a colour, by fixed weights."""
    return 0.299 * red + 0.587 * green + 0.114 * blue


def ink_places(values: Column, background: Column, threshold: float = INK_THRESHOLD) -> Column:
    """The places, from 0, of the values of a line that are ink, ascending."""
    marked = F.transform(values, lambda v, i: F.when(F.abs(v - background) > threshold, i))
    return F.array_compact(marked)


def _floor(most: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(most * EDGE_SHARE)).cast("int")


def trimmed(inked: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """For each region with ink its first and last row and column (top, bottom, left, right).

    A row counts from a share of the region's strongest row on, a column, within those rows, likewise.
    """
    strongest = inked.groupBy(*keys).agg(_floor(F.max(F.size("places"))).alias("floor")).join(inked.filter(F.size("places") > 0).select(*keys).distinct(), list(keys), "left_semi")
    rows = inked.join(strongest, list(keys)).filter(F.size("places") >= F.col("floor")).groupBy(*keys).agg(F.min(line).alias("top"), F.max(line).alias("bottom"))
    within = inked.join(rows, list(keys)).filter(F.col(line).between(F.col("top"), F.col("bottom")))
    columns = within.select(*keys, F.explode("places").alias("column")).groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n"))
    strong = columns.groupBy(*keys).agg(_floor(F.max("n")).alias("floor"))
    sides = columns.join(strong, list(keys)).filter(F.col("n") >= F.col("floor")).groupBy(*keys).agg(F.min("column").alias("left"), F.max("column").alias("right"))
    return rows.join(sides, list(keys))


def stroke_statistics(lines: DataFrame, keys: Sequence[str], line: str = "line", values: str = "values", background: str = "background") -> DataFrame:
    """keys, ink, serif and slant of every region.

    ink: the share of its values that are ink, 0 without values. serif: the variance of the rows' ink in the upper and
    lower third against that in the middle; serifs make the edges uneven. slant: the slope of the mean place of ink over
    four bands of rows, against the width. Both are measured within the trimmed region and are 0 where it is too low or
    has no ink. A line that is null or empty has no values; keys that are null are a region.
    """
    named = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    own = [f"__key{i}" for i in range(len(keys))]
    region = F.to_json(F.struct(*own))  # tells null from empty
    picked = lines.select(*named, F.col(line).cast("long").alias("line"), ink_places(F.col(values), F.col(background)).alias("places"), F.coalesce(F.size(values), F.lit(0)).alias("width"))
    picked = store(picked.withColumn("region", region).withColumn("places", F.coalesce("places", F.expr("array()").cast("array<int>"))), "ink")
    shares = picked.groupBy("region").agg(
        *[F.first(k).alias(k) for k in own], (F.sum(F.size("places")) / F.nullif(F.sum(F.greatest("width", F.lit(0))), F.lit(0))).alias("ink"),
    )
    boxes = trimmed(picked.select("region", "line", "places"), ["region"], "line")
    sized = boxes.withColumn("height", F.col("bottom") - F.col("top") + 1).withColumn("box_width", F.col("right") - F.col("left") + 1)
    inside = picked.select("region", "line", "places").join(sized, "region").filter(F.col("line").between(F.col("top"), F.col("bottom")))
    inside = inside.withColumn("places", F.filter("places", lambda p: p.between(F.col("left"), F.col("right")))).withColumn("at", F.col("line") - F.col("top"))

    third = F.greatest(F.lit(1), F.floor(F.col("height") / 3))
    edge = (F.col("at") < third) | (F.col("at") >= F.col("height") - third)
    count = F.size("places").cast("double")
    ratio = F.var_pop(F.when(edge, count)) / (F.var_pop(F.when(~edge, count)) + TINY)
    band = F.least(F.floor(F.col("at") / F.greatest(F.lit(1), F.floor(F.col("height") / BANDS))), F.lit(BANDS - 1))
    places = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + p)
    centres = inside.groupBy("region", band.alias("band")).agg(
        (F.sum(places) / F.nullif(F.sum(F.size("places")), F.lit(0)) - F.min("left")).alias("centre"), F.min("box_width").alias("box_width"), F.min("height").alias("height"),
    )
    slopes = centres.groupBy("region").agg((F.regr_slope("centre", "band") / F.greatest(F.lit(1), F.min("box_width"))).alias("slant"), F.min("height").alias("height"))
    slants = slopes.select("region", F.when(F.col("height") >= LEAST_SLANT_HEIGHT, F.col("slant")).alias("slant"))
    serifs = inside.groupBy("region").agg(F.when(F.min("height") >= LEAST_EDGE_HEIGHT, ratio).alias("serif"))
    out = reduce(lambda a, b: a.join(b, "region", "left"), [serifs, slants], shares)
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("ink", "serif", "slant")])


# --- styles -----------------------------------------------------------------------------------------------------------


def nearer(observed: Column, plain: Column, marked: Column) -> Column:
    """struct(is_marked, margin): whether what is observed is strictly nearer to the marked reference than to the plain one.

    The margin is by how much nearer the chosen one is, against the gap between both: 1 at a reference, 0 in the middle.
    Equal, missing or NaN references, or nothing observed, decide nothing: not marked, and a null margin.
    """
    far, near = F.abs(observed - plain), F.abs(observed - marked)
    usable = observed.isNotNull() & plain.isNotNull() & marked.isNotNull() & ~F.isnan(observed) & ~F.isnan(plain) & ~F.isnan(marked) & (plain != marked)
    margin = F.least(F.abs(far - near) / F.abs(plain - marked), F.lit(1.0))
    return F.struct(F.coalesce(usable & (near < far), F.lit(False)).alias("is_marked"), F.when(usable, margin).alias("margin"))


STYLES = ("family", "bold", "italic")
#: What a reference measures for each decision, and which earlier decisions it depends on.
_MEASURE = {"family": "serif", "bold": "ink", "italic": "slant"}


def font_styles(observed: DataFrame, references: DataFrame, sample: str = "sample", undecided: float = 0.0) -> DataFrame:
    """The observed regions with family, bold, italic, their margins, and decided.

    observed: ink, serif and slant of a region and the sample it was rendered for (null: nothing to compare with).
    references: sample, family ("serif", "sans_serif"), bold, italic, and the same three statistics of that sample as
    rendered in each style; a sample has one row for a style. The family is told first, among the upright and regular
    ones; then the weight within that family; then the slant within both. What can't be told is sans_serif, regular and
    upright. decided says that every margin is there and over undecided. Each decision joins one row a sample.
    """
    rows = references.select(F.col(sample).alias("__sample"), "family", "bold", "italic", "ink", "serif", "slant")

    def pair(decision: str, given: Sequence[str], marked: Column, fixed: Column) -> DataFrame:
        value = F.col(_MEASURE[decision])
        return rows.filter(fixed).groupBy("__sample", *given).agg(F.max(F.when(~marked, value)).alias("__plain"), F.max(F.when(marked, value)).alias("__marked"))

    pairs = {
        "family": pair("family", [], F.col("family") == "serif", ~F.col("bold") & ~F.col("italic")),
        "bold": pair("bold", ["family"], F.col("bold"), ~F.col("italic")),
        "italic": pair("italic", ["family", "bold"], F.col("italic"), F.lit(True)),
    }
    out = observed.drop(*STYLES)
    for n, decision in enumerate(STYLES):
        own = pairs[decision].select(F.col("__sample").alias(sample), *STYLES[:n], "__plain", "__marked")
        joined = out.join(own, [sample, *STYLES[:n]], "left").withColumn("__near", nearer(F.col(_MEASURE[decision]), F.col("__plain"), F.col("__marked")))
        told = F.when(F.col("__near.is_marked"), "serif").otherwise("sans_serif") if decision == "family" else F.col("__near.is_marked")
        out = joined.withColumn(decision, told).withColumn(f"{decision}_margin", F.col("__near.margin")).drop("__plain", "__marked", "__near")
    sure = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{d}_margin") > undecided, F.lit(False)) for d in STYLES])
    return out.withColumn("decided", sure)
