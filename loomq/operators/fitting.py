"""Fitting texts into boxes: wrapping by character widths, growth of regions and blocks, and what went wrong.

Growth estimates widths: a character is a fixed share of the font's size wide. Fitting takes each character's advance
from a table. Everything is columns. The words of a text are measured once; a text is wrapped by folding their widths,
and as fewer lines are needed the smaller the font or the wider the box, the first that fits is found by halving.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.functions.text import bound
from loomq.operators.geometry import MARGIN, next_below, rooms
from loomq.operators.layout import CHAR_WIDTH, LINE_HEIGHT
from loomq.operators.regions import initial_font_size

#: A line of an image's text in font sizes, and steps in which a region is widened.
LINE_SPACING, STEPS = 1.15, 8
#: A font that is too small, a growth in height that is too much, and what counts as grown or as touching.
SMALL_FONT, MOST_GROWTH, NEAR = 8.0, 2.0, 0.5
#: The least font size a block is shrunk to and the step.
LEAST_FONT, FONT_STEP = 4.0, 0.5


def measured(text: Column, width: Callable[[Column], Column] = F.length) -> Column:
    """The widths of a text's words, line by line: an array of arrays of whole numbers, by characters if not told else."""

    def line(segment: Column) -> Column:
        return F.transform(F.filter(F.split(segment, r"\s+"), lambda w: w != ""), lambda w: width(w).cast("long"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def folded(widths: Column, most: Column, space: int = 1) -> Column:
    """struct(lines, widest) of measured words that are wrapped at a width, word by word; a wider word has its own line."""
    zero = F.lit(0).cast("long")

    def line(words: Column) -> Column:
        start = F.struct(zero.alias("lines"), zero.alias("at"), zero.alias("widest"))

        def step(s: Column, w: Column) -> Column:
            further = s["at"] + space + w
            goes_on = (s["lines"] > 0) & (further <= most)
            at = F.when(goes_on, further).otherwise(w)
            return F.struct((s["lines"] + F.when(goes_on, 0).otherwise(1)).cast("long").alias("lines"), at.alias("at"), F.greatest(s["widest"], at).alias("widest"))

        return F.aggregate(words, start, step, lambda s: F.struct(F.greatest(s["lines"], F.lit(1).cast("long")).alias("lines"), s["widest"].alias("widest")))

    start = F.struct(zero.alias("lines"), zero.alias("widest"))
    return F.aggregate(F.transform(widths, line), start, lambda s, p: F.struct((s["lines"] + p["lines"]).alias("lines"), F.greatest(s["widest"], p["widest"]).alias("widest")))


def wrapped(text: Column, per_line: Column) -> Column:
    """struct(lines, widest) of a text that is wrapped at so many characters, word by word; a longer word has its own line."""
    return folded(measured(text), per_line)


def line_count(widths: Column, most: Column, space: int = 1) -> Column:
    """The lines of measured words that are wrapped at a width; one number holds the lines so far and the last one's width."""
    line, zero = 1 << 40, F.lit(0).cast("long")

    def count(limit: Column) -> Column:
        def step(s: Column, w: Column) -> Column:
            goes_on = (s >= line) & (s % line + space + w <= limit)
            return F.when(goes_on, s + space + w).otherwise(s - s % line + line + w)

        def of(words: Column) -> Column:
            return F.aggregate(words, zero, step, lambda s: F.greatest(F.floor(s / line), F.lit(1).cast("long")))

        return F.aggregate(F.transform(widths, of), zero, lambda s, n: s + n)

    return bound(most, count)


def longest(widths: Column) -> Column:
    """The widest measured word, 0 without any; a wrapped text is no wider than the width unless a word is."""
    return F.coalesce(F.array_max(F.transform(widths, lambda words: F.coalesce(F.array_max(words), F.lit(0).cast("long")))), F.lit(0).cast("long"))


def first_fit(candidates: Column, fits: Callable[[Column], Column]) -> Column:
    """The least k from 0 on, below a number of candidates, that fits, or that number; all after one that fits fit too.

    The first is tried alone, since most texts fit as they are; the rest is halved until one is left.
    """
    start = F.when(fits(F.lit(0)), F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))).otherwise(F.struct(F.lit(1).alias("low"), F.greatest(candidates.cast("int"), F.lit(1)).alias("high")))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        open_ = s["low"] < s["high"]
        good = F.when(open_, fits(middle))
        return bound(F.struct(middle.alias("m"), good.alias("g")), lambda x: F.struct(F.when(open_ & ~x["g"], x["m"] + 1).otherwise(s["low"]).alias("low"), F.when(open_ & x["g"], x["m"]).otherwise(s["high"]).alias("high")))

    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(candidates.cast("double") + 1)).cast("int"), F.lit(1)))
    return F.aggregate(rounds, start, halve, lambda s: s["high"])


def grow_regions(regions: DataFrame, keys: Sequence[str], order: str, text: str, image_width: str, image_height: str, obstacles: DataFrame | None = None) -> DataFrame:
    """The regions with render_box: where a text fits at its first font size, null where it doesn't even in all the room.

    regions: x, y, width, height, line_height (null: the height), and render_box if some have one already, which stays.
    Room is measured once, against every region and obstacle as it is, so no order of growing matters. A region is widened in a few
    steps, to the right first; the narrowest that fits in height counts, and that grows downwards first.
    """
    has_box = "render_box" in regions.columns
    given = F.col("render_box") if has_box else F.lit(None).cast("struct<x:int,y:int,width:int,height:int>")
    placed = regions.withColumn("__given", given).drop("render_box")
    sides = ("x", "y", "width", "height")
    drawn = placed.select(*keys, order, image_width, image_height, *[F.coalesce(F.col(f"__given.{c}"), F.col(c)).alias(c) for c in sides])
    sized = placed.join(rooms(drawn, keys, order, image_width, image_height, obstacles), [*keys, order])
    size = initial_font_size(F.coalesce(F.col("line_height"), F.col("height")))
    high = F.greatest(F.lit(1), F.floor(size * LINE_SPACING))
    more = F.col("room_left") + F.col("room_right")
    step = F.greatest(more / STEPS, F.lit(1.0))

    room = F.col("height") + F.col("room_above") + F.col("room_below")

    def candidate(words: Column, k: Column) -> Column:
        extra = F.least(k * step, more)
        width = F.greatest(F.col("width") + extra, F.lit(1.0))
        lines = line_count(words, F.floor(width / (size * CHAR_WIDTH)))
        return F.struct(extra.alias("extra"), width.alias("width"), (lines * high).alias("height"))

    def narrowest(words: Column) -> Column:
        wide = longest(words) * size * CHAR_WIDTH

        def fits(k: Column) -> Column:
            return bound(candidate(words, k), lambda c: (wide <= c["width"]) & (c["height"] <= room))

        return bound(first_fit(F.lit(STEPS + 1), fits), lambda k: F.when(k <= STEPS, candidate(words, k)))

    best = sized.withColumn("__fit", bound(measured(F.col(text)), narrowest))
    right = F.least(F.col("__fit.extra"), F.col("room_right"))
    left = F.col("__fit.extra") - right
    taller = F.greatest(F.col("__fit.height") - F.col("height"), F.lit(0.0))
    below = F.least(taller, F.col("room_below"))
    above = taller - below
    box = {"x": F.col("x") - left, "y": F.col("y") - above, "width": F.col("width") + left + right, "height": F.col("height") + above + below}
    grown = F.when(F.col("__fit").isNotNull(), F.struct(*[c.cast("int").alias(n) for n, c in box.items()]))
    out = best.withColumn("render_box", F.coalesce(F.col("__given"), grown))
    return out.drop("__fit", "__given", "room_left", "room_right", "room_above", "room_below")


def fit_blocks(blocks: DataFrame, keys: Sequence[str], block_id: str, text: str, limit: str, wide: tuple[str, str] | None = None) -> DataFrame:
    """The blocks with cap_y1, next_y0, final_y1, final_font and fits: how far a text makes its block grow.

    blocks: x0..y1, font_size and the page's limit. A block grows down to the limit or to shortly above the nearest
    block below, which next_y0 tells if the blocks have it; only then its font shrinks. wide names columns with the width that counts for blocks below, such as
    that of a highlight; nulls mean the block's own.
    """
    near = blocks if "next_y0" in blocks.columns else blocks.join(next_below(blocks, keys, block_id, wide), [*keys, block_id])
    cap = F.when(F.col("next_y0").isNull(), F.col(limit)).otherwise(F.least(F.col(limit), F.col("next_y0") - MARGIN))
    sized = near.withColumn("cap_y1", cap.cast("double"))
    room = F.greatest(F.col("cap_y1") - F.col("y0"), F.col("y1") - F.col("y0"))
    n_sizes = F.greatest(F.floor((F.col("font_size") - LEAST_FONT) / FONT_STEP), F.lit(0)).cast("int")

    def at(words: Column, k: Column) -> Column:
        size = F.greatest(F.col("font_size") - k * FONT_STEP, F.least(F.lit(LEAST_FONT), F.col("font_size")))
        per_line = F.floor((F.col("x1") - F.col("x0")) / (size * CHAR_WIDTH))
        return F.struct(size.alias("size"), (line_count(words, per_line) * size * LINE_HEIGHT).alias("height"))

    def largest(words: Column) -> Column:
        return bound(first_fit(n_sizes + 1, lambda k: at(words, k)["height"] <= room), lambda k: F.when(k <= n_sizes, at(words, k)))

    best = sized.withColumn("__fit", bound(measured(F.col(text)), largest))
    final = F.when(F.col("__fit").isNull(), F.greatest("cap_y1", "y1")).otherwise(F.greatest(F.col("y1"), F.col("y0") + F.col("__fit.height")))
    least = F.least(F.lit(LEAST_FONT), F.col("font_size").cast("double"))
    out = best.withColumn("final_y1", final.cast("double")).withColumn("final_font", F.coalesce(F.col("__fit.size").cast("double"), least))
    return out.withColumn("fits", F.col("__fit").isNotNull()).drop("__fit")


# --- true widths ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Advances:
    """How wide characters are, in thousandths of the font's size; others have the default."""

    widths: dict[int, str]
    default: int
    space: int

    def of(self, text: Column) -> Column:
        """A text's width: the default for all, and the difference for those of each other width."""
        out = F.length(text) * self.default
        for width, characters in self.widths.items():
            found = F.length(text) - F.length(F.translate(text, characters, ""))
            out = out + found * (width - self.default)
        return out

    def each(self) -> dict[str, int]:
        return {c: width for width, characters in self.widths.items() for c in characters}


def latin(widths: dict[int, str], default: int, space: int) -> Advances:
    """Advances where an accented letter is as wide as the letter below its accents."""
    known = {c: width for width, characters in widths.items() for c in characters}
    accented: dict[int, str] = {}
    for c in map(chr, range(0xC0, 0x250)):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base in known:
            accented[known[base]] = accented.get(known[base], "") + c
    return Advances({w: c + accented.get(w, "") for w, c in widths.items() if w != default}, default, space)


#: The advances of a common sans-serif font, by width.
SANS = latin({
    191: "'", 222: "ijl", 260: "|", 278: "!,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jckvsxyz",
    556: "#$0123456789?L_abdeghnopqu", 584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}, 556, 278)
#: The least font size of a fitted text, and by how much a size is made smaller.
LEAST_SIZE, SIZE_STEP = 9, 2


def wrapped_text(text: Column, most: Column, advances: Advances) -> Column:
    """A text with line breaks where it is wrapped at a width in thousandths of the font's size."""

    def line(segment: Column) -> Column:
        words = F.filter(F.split(segment, r"\s+"), lambda w: w != "")
        start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

        def step(s: Column, w: Column) -> Column:
            width = advances.of(w).cast("long")
            further = s["at"] + advances.space + width
            goes_on = (s["at"] > 0) & (further <= most)
            mark = F.when(s["at"] == 0, "").when(goes_on, " ").otherwise("\n")
            return F.struct(F.concat(s["text"], mark, w).alias("text"), F.when(goes_on, further).otherwise(width).alias("at"))

        return F.aggregate(words, start, step, lambda s: s["text"])

    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line), "\n")


def fit_texts(
    regions: DataFrame, text: str, max_height: str = "height", left_room: str | None = None, right_room: str | None = None, start_size: str | None = None, advances: Advances = SANS,
) -> DataFrame:
    """The regions with size, line_height, n_lines, wrapped, x_offset and fits.

    regions: width, height, line_height if there is one (null: the height), and the room on both sides. The size goes
    down in steps from the first one, which the region's height gives unless a column does, to the least one; the first
    counts at which the wrapped text is neither higher nor wider than it may be. If even the least is too large, the
    box is widened in a few steps, to the right first, at that size; x_offset is how far it begins further left. If the
    whole room isn't enough the widest box counts, and fits is false. A null text is empty.
    """
    given = F.col("line_height") if "line_height" in regions.columns else F.lit(None)
    start = F.col(start_size) if start_size else initial_font_size(F.coalesce(given, F.col("height")))
    left, right = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c else F.lit(0.0) for c in (left_room, right_room))
    sized = regions.withColumns({"__start": start.cast("int"), "__left": left, "__right": right, "__most": F.greatest(F.col("width"), F.lit(1)).cast("double"), "__high": F.col(max_height).cast("double")})
    most, high = F.col("__most"), F.col("__high")
    smaller = F.greatest(F.ceil((F.col("__start") - LEAST_SIZE) / SIZE_STEP), F.lit(0)).cast("int")
    more = F.col("__left") + F.col("__right")
    step = F.greatest(more / STEPS, F.lit(1.0))

    def size_at(k: Column) -> Column:
        return F.greatest(F.col("__start") - k * SIZE_STEP, F.least(F.lit(LEAST_SIZE), F.col("__start")))

    def line_height(size: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(size * LINE_SPACING).cast("int"))

    def fits(words: Column, size: Column, width: Column) -> Column:
        lines = line_count(words, width * 1000 / size, advances.space)
        return (longest(words) * size <= width * 1000) & (lines * line_height(size) <= high)

    def chosen(words: Column) -> Column:
        def widened(k: Column) -> Column:
            least = size_at(smaller)
            wider = F.when((k <= smaller) | (more <= 0), F.lit(-1)).otherwise(first_fit(F.ceil(more / step).cast("int"), lambda n: fits(words, least, most + F.least((n + 1) * step, more))))
            return F.struct(size_at(F.least(k, smaller)).cast("int").alias("size"), F.when(wider < 0, 0.0).otherwise(F.least((wider + 1) * step, more)).alias("extra"))

        return bound(first_fit(smaller + 1, lambda k: fits(words, size_at(k), most)), widened)

    def told(words: Column) -> Column:
        def result(c: Column) -> Column:
            width, size = most + c["extra"], c["size"]
            return F.struct(
                size.alias("size"), line_height(size).alias("line_height"), line_count(words, width * 1000 / size, advances.space).alias("n_lines"), c["extra"].alias("extra"), fits(words, size, width).alias("fits"),
            )

        return bound(chosen(words), result)

    best = sized.withColumn("__fit", bound(measured(F.col(text), advances.of), told))
    wide = (most + F.col("__fit.extra")) * 1000 / F.col("__fit.size")
    offset = -(F.col("__fit.extra") - F.least(F.col("__fit.extra"), F.col("__right")))
    kept = [c for c in regions.columns if c not in ("size", "line_height", "n_lines", "wrapped", "x_offset", "fits")]
    return best.select(*kept, "__fit.size", "__fit.line_height", "__fit.n_lines", wrapped_text(F.col(text), wide, advances).alias("wrapped"), (offset + 0.0).alias("x_offset"), "__fit.fits")


def growth_anomalies(fitted: DataFrame) -> DataFrame:
    """One row for each finding: the fitted block's columns with kind.

    growth_capped_by_collision: it grew, and up to a block below. small_final_font: its font was shrunk to a small one.
    excessive_height_growth: it is more than twice as high.
    """
    grew = F.col("final_y1") > F.col("y1") + NEAR
    capped = grew & F.col("next_y0").isNotNull() & (F.col("final_y1") >= F.col("cap_y1") - NEAR)
    small = (F.col("final_font") <= SMALL_FONT) & (F.col("final_font") < F.col("font_size"))
    height = F.col("y1") - F.col("y0")
    tall = (height > 0) & (F.col("final_y1") - F.col("y0") > MOST_GROWTH * height)
    kinds = F.array(F.when(capped, "growth_capped_by_collision"), F.when(small, "small_final_font"), F.when(tall, "excessive_height_growth"))
    return fitted.withColumn("kind", F.explode(F.array_compact(kinds)))


def missing_links(original: DataFrame, current: DataFrame, page: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """The original links (x0..y1, kind, uri, target_page, target) of a page that aren't there any more.

    A link is told by its box to two decimals, its kind and where it leads; nulls equal nulls.
    """
    box, rest = ("x0", "y0", "x1", "y1"), ("kind", "uri", "target_page", "target")
    a, b = original.alias("a"), current.alias("b")
    on = F.lit(True)
    for c in (*page, *rest):
        on &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    for c in box:
        on &= F.round(F.col(f"a.{c}"), 2).eqNullSafe(F.round(F.col(f"b.{c}"), 2))
    return a.join(b, on, "left_anti")
