"""Queries over paid answers: every distinct text is sent once, and only what was answered is charged."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomq.operators import answers, translate
from loomq.plans.registry import query
from loomq.session import table


# Lines of all documents, of which copies and repeated lines have the same: what units count, and what goes out.
@query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents),
u AS (SELECT line, length(line) AS n FROM l WHERE line <> ''),
units AS (SELECT n, count(*) AS units, CAST(sum(CASE WHEN n <= 120 THEN n ELSE 0 END) AS BIGINT) AS chars_sent FROM u GROUP BY n),
paid AS (SELECT n, count(*) FILTER (WHERE n <= 120) AS charged, CAST(coalesce(sum(n) FILTER (WHERE n <= 120), 0) AS BIGINT) AS characters FROM (SELECT DISTINCT line, n FROM u) GROUP BY n)
SELECT n AS length, units, chars_sent, charged, characters FROM units JOIN paid USING (n)
""")
def translation_ledger(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit_index", "line"))
    units = lines.select("doc_id", "unit_index", F.trim("line", F.lit(" \t\r")).alias("text"), F.lit(True).alias("translatable")).filter("text <> ''")
    run = translate.run_units(units, "short", "DE")
    counted = run.units.groupBy(F.length("text").alias("length")).agg(F.count(F.lit(1)).alias("units"), F.sum("chars_sent").alias("chars_sent"))
    charged = answers.ledger(run.new, "short").groupBy(F.col("characters").cast("int").alias("length")).agg(F.count(F.lit(1)).alias("charged"), F.sum("characters").alias("characters"))
    return counted.join(charged, "length", "left").fillna(0, ["charged", "characters"])


# Long turns are refused by the provider: they leave a conversation's budget as it was, and later turns fit.
@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE trim(text) <> ''),
f(conv_id, i, used, status) AS (
  SELECT conv_id, i, CASE WHEN n <= 120 THEN n ELSE 0 END, CASE WHEN n > 300 THEN 'over budget' WHEN n > 120 THEN 'failed' ELSE 'translated' END FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.i, f.used + CASE WHEN f.used + t.n <= 300 AND t.n <= 120 THEN t.n ELSE 0 END,
    CASE WHEN f.used + t.n > 300 THEN 'over budget' WHEN t.n > 120 THEN 'failed' ELSE 'translated' END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT t.conv_id, t.turn, f.status, CASE WHEN f.status = 'translated' THEN reverse(c.text) END AS translated
FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn
""")
def budget_outcomes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("unit_index"), "text", F.lit(True).alias("translatable")).filter(F.trim("text") != "")
    done = translate.translate_units(turns, "short", "DE", run=["conv_id"], budget=300)
    status = F.when(F.col("error") == "over budget", F.col("error")).otherwise(F.col("status"))
    return done.select("conv_id", F.col("unit_index").alias("turn"), status.alias("status"), "translated")
