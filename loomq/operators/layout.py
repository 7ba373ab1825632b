"""Page layout: repeated zones, column groups, metadata parts, highlighted runs, text spans and overflow."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomq.functions.text import blank, repetition_key, stripped
from loomq.operators.geometry import runs, window_of
from loomq.operators.prefix import fold_rows

#: The share of a page's height that is a zone, and the share of pages a key has to be on.
ZONE_SHARE, PAGE_SHARE = 0.15, 0.6
#: Left edges of one column of lines differ by at most so much.
COLUMN_SPREAD = 50.0


def repeated_keys(blocks: DataFrame, pages: DataFrame, zone: float = ZONE_SHARE, share: float | Column = PAGE_SHARE, hashed: bool = False) -> DataFrame:
    """doc_id, zone (header or footer), key and bbox columns of the texts and places that repeat near the pages' edges.

    blocks: doc_id, page_index, x0..y1, text. A block near the top is no footer candidate. Its keys are its text without
    numbers and case, and its box in steps of two points. share is of a document's pages (n_pages). With hashed the keys are their 64-bit hashes, which move less.
    """
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    least = F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("n_pages")))
    shown = blocks.filter(~blank(F.col("text"))).join(pages.select("doc_id", "page_index", "height"), ["doc_id", "page_index"])
    side = F.when(F.col("y0") <= F.col("height") * zone, "header").when(F.col("y1") >= F.col("height") * (1 - zone), "footer")
    place = F.concat_ws(":", F.lit("pos"), *[(F.bround(F.col(c) / 2) * 2).cast("long").cast("string") for c in ("x0", "y0", "x1", "y1")])
    both = [F.concat(F.lit("text:"), repetition_key(F.col("text"))), place]
    keys = F.explode(F.array(*[F.xxhash64(k) if hashed else k for k in both]))
    keyed = shown.withColumn("zone", side).filter("zone is not null").withColumn("key", keys)

    def box() -> list[Column]:
        return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]

    by_page = keyed.groupBy("doc_id", "zone", "key", "page_index").agg(*box())
    found = by_page.groupBy("doc_id", "zone", "key").agg(F.count(F.lit(1)).alias("on_pages"), *box())
    return found.join(counts, "doc_id").filter(F.col("on_pages") >= least).drop("n_pages")


def zones(blocks: DataFrame, pages: DataFrame, zone: float = ZONE_SHARE, share: float = PAGE_SHARE) -> DataFrame:
    """One box for each document and zone that has repeated keys: the union of their blocks' boxes."""
    keys = repeated_keys(blocks, pages, zone, share, hashed=True)
    return keys.groupBy("doc_id", "zone").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_keys"))


def in_zone(block: Callable[[str], Column], zone: Callable[[str], Column]) -> Column:
    """Whether a block overlaps a zone, from functions that give the columns of both."""
    return (block("x0") < zone("x1")) & (block("x1") > zone("x0")) & (block("y0") < zone("y1")) & (block("y1") > zone("y0"))


def outside_zones(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks that overlap no zone of their document."""
    a, b = blocks.alias("a"), found.alias("b")
    met = in_zone(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & met, "left_anti")


def column_groups(lines: DataFrame, keys: Sequence[str], order: str, spread: float = COLUMN_SPREAD, dealt_by: Sequence[str] | None = None) -> DataFrame:
    """The lines with column_group: a new group starts where the left edges would differ by more than the spread.

    Blank lines belong to the open group and don't count. The range starts anew with each group, which no window frame
    can say, so a block's lines are folded one after the other.
    """

    def block() -> Callable[[float | None], tuple[int]]:
        group, low, high = 0, None, None

        def step(x: float | None) -> tuple[int]:
            nonlocal group, low, high
            if x is not None:
                if low is not None and max(high, x) - min(low, x) > spread:
                    group, low, high = group + 1, x, x
                else:
                    low, high = (x, x) if low is None else (min(low, x), max(high, x))
            return (group,)

        return step

    edge = F.when(~blank(F.col("text")), F.col("x0").cast("double"))
    return fold_rows(lines, keys, [order], [edge], block, "column_group bigint", dealt_by)


def metadata_lines(lines: DataFrame, keys: Sequence[str], order: str, anchors: Sequence[str]) -> DataFrame:
    """The lines with is_metadata: from a group's start to the end of the chunk with its first anchor.

    Chunks are runs of lines between blank ones. The next chunk belongs to it too if it begins with an anchor line. A
    group without an anchor, or that would be metadata altogether, has none.
    """
    text = F.lower(stripped(F.coalesce(F.col("text"), F.lit(""))))
    anchored = F.exists(F.array(*[F.lit(a.lower()) for a in anchors]), lambda a: text.contains(a))
    w = window_of(keys, [order])
    marked = lines.withColumn("__blank", text == "").withColumn("__anchor", anchored)
    marked = marked.withColumn("__first", F.min(F.when(F.col("__anchor"), F.col(order))).over(Window.partitionBy(*keys)))
    before_blank = F.coalesce(F.lag("__blank").over(w), F.lit(False))
    # After the first anchor, a line that follows blank ones without being an anchor ends the metadata.
    ends = (F.col(order) > F.col("__first")) & ~F.col("__blank") & before_blank & ~F.col("__anchor")
    marked = marked.withColumn("__ends", ends)
    marked = marked.withColumn("__end", F.min(F.when(F.col("__ends"), F.col(order))).over(Window.partitionBy(*keys)))
    last_shown = F.max(F.when((F.col(order) < F.col("__end")) & ~F.col("__blank"), F.col(order))).over(Window.partitionBy(*keys))
    marked = marked.withColumn("__last", last_shown)
    is_metadata = F.col("__first").isNotNull() & F.col("__end").isNotNull() & (F.col(order) <= F.col("__last"))
    return marked.withColumn("is_metadata", F.coalesce(is_metadata, F.lit(False))).drop("__blank", "__anchor", "__first", "__ends", "__end", "__last")


def status_runs(lines: DataFrame, keys: Sequence[str], order: str, status: str) -> DataFrame:
    """The lines with status evened out and run: a lone blank line between lines of equal status takes theirs."""
    w = window_of(keys, [order])
    is_blank = blank(F.col("text"))
    near_blank = F.coalesce(F.lag(is_blank).over(w), F.lit(True)) | F.coalesce(F.lead(is_blank).over(w), F.lit(True))
    before, after = F.lag(status).over(w), F.lead(status).over(w)
    evened = F.when(is_blank & ~near_blank & (before == after), before).otherwise(F.col(status))
    smooth = lines.withColumn(status, evened)
    return runs(smooth, keys, [order], F.lag(status).over(w) != F.col(status))


def text_spans(lines: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row of spans for each group of lines (spans: array<struct<text,bold,italic,underline>>).

    Blank lines become one paragraph mark, none at the ends. Between lines a line mark stands where boldness changes,
    or a sentence ends and the next line starts with a capital.
    """
    line_text = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    shown = F.filter("spans", lambda s: stripped(s["text"]) != "")
    bold = (F.size(shown) > 0) & F.forall(shown, lambda s: s["bold"])
    w = window_of(keys, [order])
    rows = lines.withColumn("__text", stripped(line_text)).withColumn("__bold", bold)
    follows = F.lead("__text").over(w)
    ends, starts = F.col("__text").rlike(r"[.!?:]$"), follows.rlike(r"^\p{Lu}")
    breaks = F.coalesce((follows != "") & ((F.lead("__bold").over(w) != F.col("__bold")) | (ends & starts)), F.lit(False))
    no = F.lit(False)

    def mark(kind: str) -> Column:
        return F.struct(F.lit("").alias("text"), no.alias("bold"), no.alias("italic"), no.alias("underline"), F.lit(kind).alias("kind"))

    own = F.transform("spans", lambda s: F.struct(s["text"].alias("text"), s["bold"].alias("bold"), s["italic"].alias("italic"), s["underline"].alias("underline"), F.lit("text").alias("kind")))
    parts = F.when(F.col("__text") == "", F.array(mark("paragraph"))).when(breaks, F.concat(own, F.array(mark("line")))).otherwise(own)
    listed = rows.withColumn("__parts", parts).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "__parts"))).alias("__l"))
    flat = F.flatten(F.transform("__l", lambda e: e["__parts"]))
    once = F.filter(F.transform(flat, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda e: (e["s"]["kind"] != "paragraph") | ((e["i"] > 0) & (F.get(flat, e["i"] - 1)["kind"] != "paragraph")))
    spans = F.transform(once, lambda e: e["s"])
    trailing = F.element_at(spans, -1)["kind"] != "text"
    return listed.withColumn("spans", spans).withColumn("spans", F.when((F.size("spans") > 0) & trailing, F.slice("spans", F.lit(1), F.size("spans") - 1)).otherwise(F.col("spans"))).drop("__l")


def insert_top(lines: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Where text is put back: the top of the first line that isn't blank; null if that is the first line anyway."""
    first = F.min(F.struct(order, "y0"))
    shown = F.min(F.when(~blank(F.col("text")), F.struct(order, "y0")))
    found = lines.groupBy(*keys).agg(first.alias("f"), shown.alias("s"))
    return found.select(*keys, F.when(F.col(f"s.{order}") != F.col(f"f.{order}"), F.col("s.y0")).alias("insert_y0"))


#: Units of a drawing in a point, a character's width and a line's height in font sizes, and the size without one.
UNITS, CHAR_WIDTH, LINE_HEIGHT, FONT_POINTS = 12700, 0.52, 1.2, 18.0


def text_overflow(containers: DataFrame) -> DataFrame:
    """Containers whose text is estimated to need more lines than fit, with estimated_lines, available_lines and reason.

    containers: width and height in drawing units, font_points, paragraphs array<string>, and if known autofit, which
    the reason then names. Containers without a text, a width or a height are left out.
    """
    size = F.coalesce(F.col("font_points"), F.lit(FONT_POINTS))
    filled = (F.array_join("paragraphs", "").rlike(r"\S")) & (F.col("width") > 0) & (F.col("height") > 0) & (size > 0)
    per_line = F.greatest(F.floor(F.col("width") / UNITS / (size * CHAR_WIDTH)), F.lit(1))
    lines = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda n, p: n + F.greatest(F.ceil(F.length(p) / per_line), F.lit(1)))
    room = F.greatest(F.floor(F.col("height") / UNITS / (size * LINE_HEIGHT)), F.lit(1))
    sized = containers.filter(filled).withColumn("estimated_lines", lines).withColumn("available_lines", room)
    fit = F.col("autofit") if "autofit" in containers.columns else F.lit(None).cast("string")
    named = F.concat(F.lit("static_estimate_exceeds_text_body_with_"), fit)
    sized = sized.withColumn("reason", F.when(fit.isin("normAutofit", "spAutoFit"), named).otherwise("static_estimate_exceeds_fixed_text_body"))
    return sized.filter(F.col("estimated_lines") > F.col("available_lines"))


def overflow_regressions(after: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings that are new or larger than before, with risk saying which; a null part of the key equals null."""
    a, b = after.alias("a"), before.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on &= s
    joined = a.join(b, on, "left")
    return joined.filter(F.col("b.estimated_lines").isNull() | (F.col("a.estimated_lines") > F.col("b.estimated_lines"))).select(
        "a.*", F.when(F.col("b.estimated_lines").isNull(), "new_fit_risk").otherwise("increased_fit_risk").alias("risk")
    )


def section_ranges(paragraphs: DataFrame, keys: Sequence[str], order: str, is_break: str) -> DataFrame:
    """The paragraphs with section: a new one starts after each paragraph that carries a section break."""
    w = window_of(keys, [order])
    return runs(paragraphs, keys, [order], F.lag(F.col(is_break)).over(w), "section")

