"""Queries over groups of candidates for the same document, and over corrected pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomq.functions import text
from loomq.operators import corrections, dedupe, similar
from loomq.plans.catalogue import candidates_of_turns, page_blocks_of_turns
from loomq.plans.registry import query


# No SQL: the least similarity is that of matching blocks; the tests hold the classes against every pair's alignment.
@query()
def bounded_classes(spark, sf_dir):
    candidates = candidates_of_turns(spark, sf_dir)
    found = similar.bounded_similarities(candidates)
    classes = dedupe.classify_groups(candidates, found)
    return classes.join(found.select("group_id", "decided_by", "pairs", "aligned"), "group_id", "left").select("group_id", "n", "class", "decided_by", "pairs", "aligned")


# Conversations in one language share their letters; the bound is that of every pair, the least one of a conversation.
@query("""
WITH t AS (SELECT DISTINCT conv_id, text, length(text) AS n FROM conversations WHERE turn % 7 <> 6),
c AS (SELECT conv_id, text, ord(x) % 128 AS k, count(*) AS m FROM (SELECT conv_id, text, unnest(string_split(text, '')) AS x FROM t WHERE n > 0) GROUP BY ALL),
p AS (SELECT a.conv_id, a.text AS l, b.text AS r, a.n + b.n AS total FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.text < b.text),
s AS (SELECT p.conv_id, l, r, any_value(total) AS total, coalesce(sum(CASE WHEN y.m > 0 THEN least(x.m, y.m) END), 0) AS shared
  FROM p LEFT JOIN c x ON x.conv_id = p.conv_id AND x.text = l LEFT JOIN c y ON y.conv_id = p.conv_id AND y.text = r AND y.k = x.k GROUP BY 1, 2, 3)
SELECT conv_id AS group_id, round(min(2.0 * shared / total), 9) AS bound, count(*) AS pairs FROM s GROUP BY conv_id
""")
def similarity_bounds(spark, sf_dir):
    return similar.least_bounds(candidates_of_turns(spark, sf_dir)).select("group_id", F.round("bound", 9).alias("bound"), "pairs")


# Turns are blocks as in the catalogue's pages; every third has a record, of these every second an edit, some as shown.
@query("""
WITH b AS (SELECT conv_id AS doc_id, turn // 4 AS page_index, turn AS block_index, text, 50.0 AS x0, 20.0 + (turn % 4) * 190 AS y0, 350.0 AS x1,
  20.0 + (turn % 4) * 190 + 40 + (conv_id % 5) * 30 AS y1, 9.0 + conv_id % 4 AS font_size FROM conversations),
e AS (SELECT doc_id, page_index, block_index, CASE WHEN doc_id % 4 = 0 THEN text ELSE substr(text, 1, 60) || ' corrected' END AS edited_text FROM b WHERE (doc_id + block_index) % 2 = 0),
r AS (SELECT b.*, edited_text IS NOT NULL AND edited_text <> text AS edited, coalesce(edited_text, text) AS shown FROM b LEFT JOIN e USING (doc_id, page_index, block_index) WHERE block_index % 3 = 0),
k AS (SELECT r.*, unnest(range(CAST(greatest(floor((font_size - 4) / 0.5), 0) AS INTEGER) + 1)) AS k FROM r),
z AS (SELECT *, font_size - k * 0.5 AS size, CAST(floor(300.0 / ((font_size - k * 0.5) * 0.52)) AS BIGINT) AS per_line,
  list_transform(string_split(shown, chr(10)), lambda s: list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) AS segments FROM k),
l AS (SELECT * EXCLUDE segments, CAST(list_sum(list_transform(segments, lambda ws: greatest(list_reduce(list_prepend({'n': CAST(0 AS BIGINT), 'at': CAST(0 AS BIGINT)},
  list_transform(ws, lambda w: {'n': CAST(0 AS BIGINT), 'at': CAST(length(w) AS BIGINT)})),
  lambda s, w: CASE WHEN s.n > 0 AND s.at + 1 + w.at <= per_line THEN {'n': s.n, 'at': s.at + 1 + w.at} ELSE {'n': s.n + 1, 'at': w.at} END).n, 1))) AS BIGINT) AS lines FROM z),
c AS (SELECT a.doc_id, a.block_index, min(o.y0) AS next_y0 FROM b a LEFT JOIN b o ON o.doc_id = a.doc_id AND o.page_index = a.page_index AND o.block_index <> a.block_index AND o.y0 >= a.y1 GROUP BY 1, 2),
p AS (SELECT l.*, next_y0, CASE WHEN next_y0 IS NULL THEN 800.0 ELSE least(800.0, next_y0 - 3) END AS cap FROM l JOIN c USING (doc_id, block_index)),
g AS (SELECT doc_id, page_index, block_index, any_value(edited) AS edited, any_value(next_y0) AS next_y0, any_value(cap) AS cap, any_value(y0) AS y0, any_value(y1) AS y1,
  arg_min({'s': size, 'h': lines * size * 1.2}, k) FILTER (WHERE lines * size * 1.2 <= greatest(cap - y0, y1 - y0)) AS f FROM p GROUP BY 1, 2, 3)
SELECT doc_id, page_index, block_index, edited, CAST(next_y0 AS DOUBLE) AS next_y0, f IS NOT NULL AS fits, CAST(coalesce(f.s, 4.0) AS DOUBLE) AS final_font,
  CAST(round(CASE WHEN f IS NULL THEN greatest(cap, y1) ELSE greatest(y1, y0 + f.h) END, 6) AS DOUBLE) AS final_y1 FROM g
""")
def page_corrections(spark, sf_dir):
    blocks = page_blocks_of_turns(spark, sf_dir).drop("html", "translatable")
    doc, block = F.col("doc_id"), F.col("block_index")
    stored = corrections.store_pages(blocks, "corrected_blocks", 8)
    marked = F.concat(F.lit("<p><b>"), F.replace(text.escape(F.col("text")), F.lit("\n"), F.lit("<br>")), F.lit("</b></p>"))
    records = corrections.store_pages(blocks.filter(block % 3 == 0).select(*corrections.BLOCK, marked.alias("html")), "correction_records", 8)
    changed = F.when(doc % 4 == 0, F.col("text")).otherwise(F.concat(F.substring("text", 1, 60), F.lit(" corrected")))
    edits = blocks.filter((doc + block) % 2 == 0).select(*corrections.BLOCK, changed.alias("edited_text"))
    done = corrections.corrected_pages(records, edits, stored)
    return done.select(*corrections.BLOCK, "edited", "next_y0", "fits", "final_font", F.round("final_y1", 6).alias("final_y1"))
