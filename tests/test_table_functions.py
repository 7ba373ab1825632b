import random

import pytest
from pyspark.sql import functions as F

from loomq.operators import search
from loomq.plans import table_functions as t
from loomq.plans.query_lang import matches, parse

QUERIES = ["the", "a AND (b OR c)", "x || y && z", "O'Brien \\ 50%", "(broken", "ä UND ö", "  ", None, "(((a)))", "a OR b AND (c OR d)"]


@pytest.fixture()
def docs(spark):
    r = random.Random(3)
    words = ["a", "b", "c", "d", "the", "x", "y", "z", "O'Brien \\ 50%", "(broken", "Ä", "ö"]
    rows = [(i, f"g{i % 4}", " ".join(r.choices(words, k=r.randrange(6))), None if i % 7 == 0 else r.choice(words)) for i in range(200)] + [(900, None, None, None)]
    df = spark.createDataFrame(rows, "id int, grp string, body string, head string")
    df.createOrReplaceTempView("searched_docs")
    return df


@pytest.mark.parametrize("query", QUERIES)
def test_function_is_the_predicate(spark, docs, query):
    """The function gives the rows of the column, and the plan of the statement has its terms instead of a call."""
    t.register_query(spark, "wanted", query)
    found = spark.sql("SELECT id FROM searched_docs WHERE wanted(body)")
    column = docs.filter(matches(F.col("body"), query)).select("id")
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in column.collect())

    def condition(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return [line.strip(" +-:").split("#")[0] for line in plan.splitlines() if "Filter" in line and "wanted" not in line], "wanted" in plan

    assert condition(found) == condition(column) and not condition(found)[1]
    lowered = [(r["id"], (r["body"] or "").lower()) for r in docs.collect() if r["body"] is not None]
    assert query is not None and not query.strip() or {i for i, body in lowered if t.holds(parse(query), body)} == {r["id"] for r in column.collect()} - {900} | ({900} & set())


def test_pushed_to_the_scan(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    t.register_query(spark, "wanted", "a AND b")
    found = spark.read.parquet(str(tmp_path / "docs"))
    plan = spark.sql("SELECT id FROM {d} WHERE wanted(body)", d=found)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int,body:string>" in plan and "Contains" in plan or "contains" in plan.lower()


@pytest.mark.parametrize("query", QUERIES)
def test_table_function(spark, docs, query):
    """The rows, their place within a group in order, and the snippets of the search over columns."""
    t.register_search_table(spark)
    given = "NULL" if query is None else t._quoted(query)
    got = spark.sql(f"SELECT * FROM search_table(TABLE(searched_docs) PARTITION BY (grp) ORDER BY (id DESC), {given}, 'head, body')").collect()
    text = F.concat_ws("\n", F.nullif("head", F.lit("")), F.nullif("body", F.lit("")))
    blank = not (query or "").strip()
    expected = docs.filter(F.lit(blank) | matches(F.nullif(text, F.lit("")), query)).select("id", "grp", F.lit("").alias("s") if blank else search.first_line(text).alias("s")).collect()
    assert sorted((r["id"], r["snippet"]) for r in got) == sorted((r["id"], r["s"]) for r in expected)
    for grp in {r["grp"] for r in expected}:
        own = sorted((r for r in got if r["grp"] == grp), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and [r["id"] for r in own] == sorted((r["id"] for r in own), reverse=True)


def test_most_of_a_group(spark, docs):
    t.register_search_table(spark)
    got = spark.sql("SELECT grp, place FROM search_table(TABLE(searched_docs) PARTITION BY (grp) ORDER BY (id), '', '', 3)").collect()
    assert sorted((r["grp"] or "", r["place"]) for r in got) == sorted([("", 1)] + [(f"g{g}", p) for g in range(4) for p in (1, 2, 3)])


@pytest.mark.parametrize("arguments, message", [
    ("TABLE(searched_docs), 'a', 'nothing'", "no text column"), ("TABLE(searched_docs), 'a', 'id'", "no text column"), ("TABLE(searched_docs), 5, 'body'", "constant texts"),
    ("TABLE(searched_docs), 'a', 'body', 0", "positive"), ("'x', 'a', 'body'", "has to be a table"), ("TABLE(SELECT *, 1 AS place FROM searched_docs), 'a', 'body'", "of its own named place"),
])
def test_wrong_arguments_at_planning(spark, docs, arguments, message):
    t.register_search_table(spark)
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM search_table({arguments})")


def test_names(spark):
    with pytest.raises(ValueError):
        t.register_query(spark, "x(y)", "a")
