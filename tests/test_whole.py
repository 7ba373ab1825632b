"""Queries that give every row of their tables."""

import pytest
from pyspark.sql import functions as F

from loomq.operators import merge, prefix
from loomq.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "table"), [("sorted_results", "part"), ("natural_sort_all", "part"), ("slide_order", "customer")])
def test_every_row_has_a_place(spark, name, table):
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    places = sorted(r["place"] for r in catalogue.QUERIES[name](spark, SF).collect())
    assert len(places) == n and places[0] == 1 and (places == list(range(1, n + 1)) or name == "natural_sort_all")


def test_places_over_ranges(spark):
    df = spark.range(5_000).select((F.col("id") * 7 % 5_000).alias("k")).repartition(8)
    assert all(r["place"] == 5_000 - r["k"] for r in prefix.places(df, [F.col("k").desc()]).collect())


def test_every_order_is_scanned(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    out = catalogue.QUERIES["dates_custom"](spark, SF)
    assert out.count() == orders.count() and out.agg(F.max(F.year("found"))).first()[0] >= 2090


def test_first_spellings_of_all_terms(spark):
    texts = {2: "Éclair ÉCLAIR Straße x", 1: "éCLAIR Straße STRASSE Öl \u2003öl", 3: "ÖL X"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = {}
    for doc_id in sorted(texts):
        for term in filter(None, (t.strip() for t in texts[doc_id].split(" "))):
            first.setdefault(term.casefold(), term)
    got = merge.first_spellings(catalogue._terms(docs), "term", "o").collect()
    assert {r["key"]: r["term"] for r in got} == first and len(got) == len(first)


def test_terms_are_not_filtered(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    keys = {r["key"] for r in catalogue.QUERIES["dedupe_casefold_first"](spark, SF).collect()}
    assert any(not k.isascii() for k in keys)
    assert {t.strip().casefold() for r in docs for t in r["text"].split(" ") if t.strip()} == keys


def test_order_of_a_text_of_over_a_million_pieces(spark):
    docs = spark.createDataFrame([(1, "x " * 1_000_000 + "LATE"), (2, "late")], "doc_id long, text string")
    got = merge.first_spellings(catalogue._terms(docs), "term", "o").filter("key = 'late'").first()
    assert got["term"] == "LATE"


def test_batch_is_chosen_from_all_orders(spark):
    got = catalogue.QUERIES["batch_selection"](spark, SF).collect()
    assert len(got) == 250 and any(int(r["number"]) % 2 for r in got)
