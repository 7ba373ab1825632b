"""Queries over strokes, styles, fitting, and regions of recognised lines.

Embeddings serve as scan lines: 64 values around a background of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomq.functions import text
from loomq.operators import fitting, geometry, layout, pipelines, regions, strokes, translate
from loomq.plans.catalogue import _BOXES, _ROOMS, boxes_of_parts
from loomq.plans.registry import query
from loomq.session import table


def _lines(spark, sf_dir, region, line, **more) -> DataFrame:
    """Embeddings as lines of regions, stretched so that about half of their values are ink."""
    values = F.transform("embedding", lambda v: v.cast("double") * 400)
    return table(spark, sf_dir, "embeddings").select(region, line.alias("line"), values.alias("values"), F.lit(0.0).alias("background"), *[c.alias(n) for n, c in more.items()])


def _statistics_sql(name: str, source: str) -> str:
    """CTEs that end in one of the name: region, ink, serif, slant of a source with region, line and vals."""
    n = name
    return f"""
{n}_p AS MATERIALIZED (SELECT region, line, len(vals) AS width, list_filter(range(len(vals)), lambda i: abs(vals[i + 1]::DOUBLE * 400) > 40) AS places FROM ({source})),
{n}_f AS (SELECT region, greatest(1, floor(max(len(places)) * 0.08)) AS least FROM {n}_p GROUP BY region HAVING max(len(places)) > 0),
{n}_r AS (SELECT region, min(line) AS top, max(line) AS bottom FROM {n}_p JOIN {n}_f USING (region) WHERE len(places) >= least GROUP BY region),
{n}_c AS (SELECT region, x, count(*) AS n FROM (SELECT region, unnest(places) AS x FROM {n}_p JOIN {n}_r USING (region) WHERE line BETWEEN top AND bottom) GROUP BY ALL),
{n}_s AS (SELECT region, min(x) AS lft, max(x) AS rgt FROM {n}_c JOIN (SELECT region, greatest(1, floor(max(n) * 0.08)) AS least FROM {n}_c GROUP BY region) USING (region) WHERE n >= least GROUP BY region),
{n}_i AS (SELECT region, line - top AS y, bottom - top + 1 AS h, rgt - lft + 1 AS w, lft, list_filter(places, lambda x: x BETWEEN lft AND rgt) AS places
  FROM {n}_p JOIN {n}_r USING (region) JOIN {n}_s USING (region) WHERE line BETWEEN top AND bottom),
{n}_e AS (SELECT region, CASE WHEN any_value(h) >= 6 THEN var_pop(len(places)) FILTER (WHERE y < greatest(1, h // 3) OR y >= h - greatest(1, h // 3))
  / (var_pop(len(places)) FILTER (WHERE y >= greatest(1, h // 3) AND y < h - greatest(1, h // 3)) + 1e-6) END AS serif FROM {n}_i GROUP BY region),
{n}_b AS (SELECT region, least(y // greatest(1, h // 4), 3) AS band, any_value(h) AS h, any_value(w) AS w, sum(list_sum(places)) / sum(len(places)) - any_value(lft) AS centre FROM {n}_i GROUP BY 1, 2),
{n}_l AS (SELECT region, CASE WHEN any_value(h) >= 8 THEN regr_slope(centre, band) / greatest(1, any_value(w)) END AS slant FROM {n}_b GROUP BY region),
{n} AS (SELECT region, sum(len(places)) / sum(width) AS ink, coalesce(any_value(serif), 0) AS serif, coalesce(any_value(slant), 0) AS slant
  FROM {n}_p LEFT JOIN {n}_e USING (region) LEFT JOIN {n}_l USING (region) GROUP BY region)"""


_OBSERVED = "SELECT vec_id // 32 AS region, vec_id % 32 AS line, embedding AS vals FROM embeddings"
_RENDERED = "SELECT {'sample': label % 5, 'style': vec_id % 8} AS region, vec_id // 8 AS line, embedding AS vals FROM embeddings"


@query(f"WITH {_statistics_sql('t', _OBSERVED)} SELECT region, round(ink, 6) AS ink, round(serif, 6) AS serif, round(slant, 6) AS slant FROM t")
def stroke_statistics(spark, sf_dir):
    lines = _lines(spark, sf_dir, F.floor(F.col("vec_id") / 32).alias("region"), F.col("vec_id") % 32)
    found = strokes.stroke_statistics(lines, ["region"])
    return found.select("region", *[F.round(c, 6).alias(c) for c in ("ink", "serif", "slant")])


# Every eighth line of a label's remainder is a sample in one of the eight styles; regions are compared with one sample each.
@query(f"""
WITH {_statistics_sql('o', _OBSERVED)}, {_statistics_sql('s', _RENDERED)},
k AS (SELECT region.sample AS sample, region.style & 1 = 1 AS serif_face, region.style & 2 = 2 AS bold, region.style & 4 = 4 AS italic, ink, serif, slant FROM s),
f AS (SELECT o.*, region % 5 AS sample, coalesce(abs(o.serif - m.serif) < abs(o.serif - p.serif) AND m.serif <> p.serif, false) AS serif_face,
    CASE WHEN m.serif <> p.serif THEN least(abs(abs(o.serif - p.serif) - abs(o.serif - m.serif)) / abs(p.serif - m.serif), 1) END AS family_margin
  FROM o LEFT JOIN k p ON p.sample = region % 5 AND NOT p.serif_face AND NOT p.bold AND NOT p.italic LEFT JOIN k m ON m.sample = region % 5 AND m.serif_face AND NOT m.bold AND NOT m.italic),
b AS (SELECT f.*, coalesce(abs(f.ink - m.ink) < abs(f.ink - p.ink) AND m.ink <> p.ink, false) AS bold, CASE WHEN m.ink <> p.ink THEN least(abs(abs(f.ink - p.ink) - abs(f.ink - m.ink)) / abs(p.ink - m.ink), 1) END AS bold_margin
  FROM f LEFT JOIN k p ON p.sample = f.sample AND p.serif_face = f.serif_face AND NOT p.bold AND NOT p.italic LEFT JOIN k m ON m.sample = f.sample AND m.serif_face = f.serif_face AND m.bold AND NOT m.italic),
i AS (SELECT b.*, coalesce(abs(b.slant - m.slant) < abs(b.slant - p.slant) AND m.slant <> p.slant, false) AS italic, CASE WHEN m.slant <> p.slant THEN least(abs(abs(b.slant - p.slant) - abs(b.slant - m.slant)) / abs(p.slant - m.slant), 1) END AS italic_margin
  FROM b LEFT JOIN k p ON p.sample = b.sample AND p.serif_face = b.serif_face AND p.bold = b.bold AND NOT p.italic LEFT JOIN k m ON m.sample = b.sample AND m.serif_face = b.serif_face AND m.bold = b.bold AND m.italic)
SELECT region, CASE WHEN serif_face THEN 'serif' ELSE 'sans_serif' END AS family, bold, italic, round(family_margin, 6) AS family_margin, round(bold_margin, 6) AS bold_margin,
  round(italic_margin, 6) AS italic_margin, coalesce(family_margin > 0.1 AND bold_margin > 0.1 AND italic_margin > 0.1, false) AS decided FROM i
""")
def font_styles(spark, sf_dir):
    seen = strokes.stroke_statistics(_lines(spark, sf_dir, F.floor(F.col("vec_id") / 32).alias("region"), F.col("vec_id") % 32), ["region"])
    lines = _lines(spark, sf_dir, (F.col("label") % 5).alias("sample"), F.floor(F.col("vec_id") / 8), style=F.col("vec_id") % 8)
    style = F.col("style")
    faces = [F.when(style.bitwiseAND(1) == 1, "serif").otherwise("sans_serif").alias("family"), (style.bitwiseAND(2) == 2).alias("bold"), (style.bitwiseAND(4) == 4).alias("italic")]
    references = strokes.stroke_statistics(lines, ["sample", "style"]).select("sample", *faces, "ink", "serif", "slant")
    told = strokes.font_styles(seen.withColumn("sample", F.col("region") % 5), references, undecided=0.1)
    return told.select("region", "family", "bold", "italic", *[F.round(f"{d}_margin", 6).alias(f"{d}_margin") for d in strokes.STYLES], "decided")


def _advances_sql() -> str:
    each = fitting.SANS.each()
    return "MAP {" + ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}': {w}" for c, w in each.items()) + "}"


# Every size of every turn, then every width at the least size; a line's words are folded one after the other.
_LINES = """CAST(list_sum(list_transform(seg, lambda ws: greatest(list_reduce(list_prepend({{'n': CAST(0 AS BIGINT), 'at': CAST(0 AS BIGINT)}},
  list_transform(ws, lambda w: {{'n': CAST(0 AS BIGINT), 'at': w}})), lambda s, w: CASE WHEN s.n > 0 AND s.at + 278 + w.at <= {most} THEN {{'n': s.n, 'at': s.at + 278 + w.at}} ELSE {{'n': s.n + 1, 'at': w.at}} END).n, 1))) AS BIGINT)"""


@query(f"""
WITH a AS (SELECT {_advances_sql()} AS widths),
b AS (SELECT conv_id, turn, text, CAST(90 + conv_id % 7 * 60 AS DOUBLE) AS width, 20 + turn * 9 AS height, CAST(60 + turn * 55 AS DOUBLE) AS high, CAST(conv_id % 3 * 40 AS DOUBLE) AS lft, CAST(turn % 2 * 70 AS DOUBLE) AS rgt,
  least(greatest(floor((20 + turn * 9) * 0.8), 9), 48) AS first FROM conversations),
m AS (SELECT b.* EXCLUDE text, list_transform(string_split(text, chr(10)), lambda s: list_transform(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> ''),
  lambda w: CAST(list_sum(list_transform(string_split(w, ''), lambda c: coalesce(widths[c], 556))) AS BIGINT))) AS seg FROM b, a),
l AS (SELECT *, coalesce(list_max(list_transform(seg, lambda s: coalesce(list_max(s), 0))), 0) AS longest, CAST(greatest(ceil((first - 9) / 2), 0) AS INTEGER) AS last, greatest((lft + rgt) / 8, 1.0) AS step FROM m),
k AS (SELECT *, unnest(range(last + 1)) AS k FROM l),
z AS (SELECT *, greatest(first - k * 2, least(9, first)) AS size FROM k),
n AS (SELECT *, {_LINES.format(most="width * 1000 / size")} AS n_lines FROM z),
f AS (SELECT *, n_lines * greatest(1, floor(size * 1.15)) <= high AND longest * size <= width * 1000 AS good FROM n),
s AS (SELECT conv_id, turn, bool_or(good) AS shrunk, min(k) FILTER (WHERE good) AS k FROM f GROUP BY ALL),
e AS (SELECT l.*, least(9, first) AS size, unnest(range(9)) AS i FROM l JOIN s USING (conv_id, turn) WHERE NOT shrunk),
u AS (SELECT *, least(i * step, lft + rgt) AS extra FROM e),
x AS (SELECT *, {_LINES.format(most="(width + extra) * 1000 / size")} AS n_lines FROM u),
y AS (SELECT *, n_lines * greatest(1, floor(size * 1.15)) <= high AND longest * size <= (width + extra) * 1000 AS good FROM x),
v AS (SELECT conv_id, turn, coalesce(arg_min({{'e': extra, 'n': n_lines, 'z': size, 'r': rgt}}, i) FILTER (WHERE good), arg_max({{'e': extra, 'n': n_lines, 'z': size, 'r': rgt}}, i)) AS c, bool_or(good) AS fits FROM y GROUP BY ALL)
SELECT conv_id, turn, CAST(size AS INTEGER) AS size, n_lines, CAST(0 AS DOUBLE) AS x_offset, true AS fits FROM f JOIN s USING (conv_id, turn, k)
UNION ALL SELECT conv_id, turn, CAST(c.z AS INTEGER), c.n, 0.0 - (c.e - least(c.e, c.r)), fits FROM v
""")
def text_fits(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id")
    boxes = table(spark, sf_dir, "conversations").withColumns({
        "width": (90 + conv % 7 * 60).cast("double"), "height": 20 + turn * 9, "high": (60 + turn * 55).cast("double"), "left": (conv % 3 * 40).cast("double"), "right": (turn % 2 * 70).cast("double"),
    })
    fitted = fitting.fit_texts(boxes, "text", "high", "left", "right")
    return fitted.select("conv_id", "turn", "size", "n_lines", "x_offset", "fits")


# Boxes are recognised lines; twelve layout blocks an image hold them by their centres, and are cut where heights differ much.
@query(f"""
WITH {_BOXES},
z AS (SELECT p_partkey // 40 AS image, j, ['text', 'image', 'footer', 'table'][j % 4 + 1] AS label, j % 3 * 200 AS x0, j // 3 * 250 AS y0, j % 3 * 200 + 200 AS x1, j // 3 * 250 + 250 AS y1 FROM (SELECT p_partkey, p_partkey % 40 AS j FROM part) WHERE j < 12),
m AS (SELECT z.*, b.idx, b.text, b.x AS lx, b.y AS ly, b.x + b.width AS rx, b.y + b.height AS ry, b.height AS h, b.confidence AS score FROM box b JOIN z ON z.image = b.image
  AND b.x + b.width / 2.0 BETWEEN z.x0 AND z.x1 AND b.y + b.height / 2.0 BETWEEN z.y0 AND z.y1),
f AS (SELECT *, lag(h) OVER (PARTITION BY image, j ORDER BY ly, lx, idx) AS before FROM m),
r AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND least(h, before) < 0.6 * greatest(h, before) THEN 1 ELSE 0 END) OVER (PARTITION BY image, j ORDER BY ly, lx, idx) AS run FROM f),
n AS (SELECT *, max(run) OVER (PARTITION BY image, j) = 0 AS whole FROM r)
SELECT image, j AS block_index, label, CAST(run AS BIGINT) AS run, string_agg(text, ' ' ORDER BY ly, lx, idx) AS text, CASE WHEN whole THEN any_value(x0) ELSE min(lx) END AS x, CASE WHEN whole THEN any_value(y0) ELSE min(ly) END AS y,
  CASE WHEN whole THEN 200 ELSE max(rx) - min(lx) END AS width, CASE WHEN whole THEN 250 ELSE max(ry) - min(ly) END AS height, round(avg(score), 6) AS confidence, CAST(round_even(avg(h), 0) AS BIGINT) AS line_height,
  label IN ('text', 'footer') AS translatable FROM n GROUP BY image, j, label, run, whole
""")
def block_regions(spark, sf_dir):
    boxes = boxes_of_parts(spark, sf_dir)
    lines = boxes.select(F.col("image").alias("doc_id"), F.col("idx").alias("line_index"), "text", (F.col("confidence") / 100).alias("score"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    j = F.col("idx")
    label = F.get(F.array(*map(F.lit, ("text", "image", "footer", "table"))), (j % 4).cast("int"))
    corner = {"x0": j % 3 * 200, "y0": F.floor(j / 3) * 250}
    blocks = boxes.filter(j < 12).select(F.col("image").alias("doc_id"), j.alias("block_index"), label.alias("label"), *[c.alias(n) for n, c in corner.items()], (corner["x0"] + 200).alias("x1"), (corner["y0"] + 250).alias("y1"))
    found = regions.block_regions(lines, blocks).withColumnRenamed("doc_id", "image")
    return found.select("image", "block_index", "label", "run", "text", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "width", "height")], F.round("confidence", 6).alias("confidence"), "line_height", "translatable")


# Every fourth line of a text is bold; blank lines part paragraphs, sentences and changes of boldness part lines.
@query(r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT doc_id, i, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(13)) AS s, i % 4 = 2 AS bold FROM l),
n AS (SELECT *, s <> '' AND bold AS is_bold, lead(s) OVER w AS follows, lead(s <> '' AND bold) OVER w AS next_bold FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, CASE WHEN s = '' THEN chr(30) ELSE CASE WHEN bold THEN '<b>' ELSE '' END || replace(replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || CASE WHEN bold THEN '</b>' ELSE '' END ||
  CASE WHEN coalesce(follows, '') <> '' AND (next_bold <> is_bold OR (regexp_matches(s, '[.!?:]$') AND regexp_matches(follows, '^\p{Lu}'))) THEN '<br/>' ELSE '' END END AS part FROM n),
d AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS whole FROM p GROUP BY doc_id)
SELECT doc_id, CAST(len(list_filter(string_split(whole, chr(30)), lambda x: trim(x) <> '')) AS INTEGER) AS paragraphs,
  md5(array_to_string(list_transform(list_filter(string_split(whole, chr(30)), lambda x: trim(x) <> ''), lambda x: '<p>' || x || '</p>'), '')) AS digest FROM d
""")
def spans_of_lines(spark, sf_dir):
    no = F.lit(False)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    spans = F.array(F.struct(F.col("line").alias("text"), (F.col("line_index") % 4 == 1).alias("bold"), no.alias("italic"), no.alias("underline")))
    joined = layout.text_spans(lines.select("doc_id", "line_index", spans.alias("spans")), ["doc_id"], "line_index")
    html = text.spans_to_html(F.col("spans"))
    return joined.select("doc_id", (F.size(F.split(html, "<p>")) - 1).alias("paragraphs"), F.md5(html.cast("binary")).alias("digest"))


# Long texts of every third box fail, so their pixels stay and take room from the boxes that are drawn anew.
@query(f"""
WITH {_BOXES}, {_ROOMS}, t AS (SELECT image, idx FROM box WHERE confidence >= 40 AND translatable AND idx % 3 <> 0)
SELECT room.* FROM room JOIN t USING (image, idx)
""")
def rooms_beside_obstacles(spark, sf_dir):
    boxes = boxes_of_parts(spark, sf_dir).withColumn("line_height", F.lit(None).cast("long"))
    long = F.when(F.col("idx") % 3 == 0, F.repeat(F.lit("too long "), 20)).otherwise(F.col("text"))
    chained = boxes.withColumn("text", long).filter((F.col("confidence") >= 40) & F.col("translatable")).withColumns({"chain": F.col("idx"), "place": F.lit(0)})
    units = regions.merged_regions(chained, ["image"]).withColumn("translatable", F.lit(True))
    drawn = translate.translate_units(units, "short", "DE").filter("status = 'translated'")
    obstacles = pipelines.obstacle_regions(boxes, chained, drawn, ["image"], "idx")
    sized = drawn.withColumnRenamed("chain", "idx").withColumns({"w": F.lit(600), "h": F.lit(1000)})
    return geometry.rooms(sized, ["image"], "idx", "w", "h", obstacles)
