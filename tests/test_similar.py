import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomq.operators import dedupe, similar

CANDIDATE = "group_id int, idx int, body string, error string, domain string, developer string, date string, paragraph_count int"


def made_groups(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for g in range(60):
        base = "".join(r.choice("abcdefgh \n") for _ in range(r.choice([0, 5, 40, 90, 300])))
        same, kinds = r.random() < 0.5, r.choice(["copies", "edited", "shuffled", "foreign", "mixed"])
        for i in range(r.randint(1, 5)):
            how = r.choice(["copies", "edited", "shuffled", "foreign"]) if kinds == "mixed" else kinds
            body = list(base)
            if how == "edited":
                for _ in range(len(body) // r.choice([4, 12, 40])):
                    body[r.randrange(len(body))] = "x"
            elif how == "shuffled":
                r.shuffle(body)
            elif how == "foreign":
                body = list("".join(r.choice("stuvwxyz") for _ in range(80)))
            one = 0 if same else i
            rows.append((g, i, "".join(body) if r.random() < 0.97 else None, "broken" if r.random() < 0.05 else None, r.choice(["", f"d{one}"]), r.choice([None, f"v{one}"]), r.choice(["", f"2026-0{one + 1}"]), r.choice([3, 3 + one])))
    return rows


@pytest.mark.parametrize("block", [similar.BLOCK, 2])
@pytest.mark.parametrize("seed", range(2))
def test_classes_of_all_pairs(spark, monkeypatch, seed, block):
    """The same classes as by aligning every pair, with a part of the alignments."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = made_groups(seed)
    df = spark.createDataFrame(rows, CANDIDATE)
    every = [(r[0], r[1], r[2] or "") for r in rows if r[3] is None]
    pairs = [(g, SequenceMatcher(None, a, b).ratio()) for g, i, a in every for h, j, b in every if g == h and i < j]
    truth = {r["group_id"]: r["class"] for r in dedupe.classify_groups(df, spark.createDataFrame(pairs, "group_id int, similarity double")).collect()}
    found = similar.bounded_similarities(df)
    got = {r["group_id"]: r["class"] for r in dedupe.classify_groups(df, found).collect()}
    assert got == truth and len(set(truth.values())) == 4
    told = {r["group_id"]: r for r in found.collect()}
    assert set(told) == {g for g, _ in pairs}
    least = {g: min(v for h, v in pairs if h == g) for g in told}
    for g, r in told.items():
        assert r["similarity"] is None or r["similarity"] >= least[g] - 1e-12
        assert r["decided_by"] != "all" or r["similarity"] == pytest.approx(least[g]) or r["similarity"] < 0.9
    assert sum(r["aligned"] for r in told.values()) < 0.7 * len(pairs) and {"copies", "bound", "witness"} <= {r["decided_by"] for r in told.values()}


def test_bounds_hold():
    r = random.Random(4)
    texts = ["".join(r.choice("abcdé中\U0001f600 ") for _ in range(r.randrange(60))) for _ in range(40)] + ["", "", "a" * 500]
    counted = np.array([np.bincount([ord(c) % similar.CLASSES for c in t], minlength=similar.CLASSES) if t else np.zeros(similar.CLASSES, int) for t in texts])
    found = similar.bounds(counted, counted)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert SequenceMatcher(None, a, b).ratio() <= found[i, j] + 1e-12


def test_a_large_group_is_spread(spark, monkeypatch):
    """20,000 candidates of one group: no task compares more than two blocks, and a bound decides without an alignment."""
    df = spark.range(20_000).select(
        F.lit(1).alias("group_id"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("common words and "), F.when(F.col("id") == 777, F.repeat(F.lit("Q"), 90)).otherwise((F.col("id") % 3000).cast("string"))).alias("body"),
        F.lit(None).cast("string").alias("error"), F.lit("d").alias("domain"), F.lit("v").alias("developer"), F.lit("").alias("date"), F.lit(3).alias("paragraph_count"),
    )
    seen = spark.sparkContext.accumulator(0)
    original = similar._least_bound

    def counting(key, table):
        if table.num_rows > 3 * similar.BLOCK:
            seen.add(1)
        return original(key, table)

    monkeypatch.setattr(similar, "_least_bound", counting)
    r = similar.bounded_similarities(df).collect()
    assert [(x["decided_by"], x["pairs"], x["aligned"]) for x in r] == [("bound", 3001 * 3000 // 2, 0)] and seen.value == 0
    assert dedupe.classify_groups(df, spark.createDataFrame(r)).first()["class"] == dedupe.UNCLEAR


def test_every_pair_where_needed(spark):
    """Versions that are alike but not equal: no pair is below the threshold, so all are aligned, in the order they come in."""
    texts = [f"{'same words over and over ' * 3}{'abc' * k}" for k in range(5)]
    df = spark.createDataFrame([(1, i, t, None, "d", "v", f"2026-0{i + 1}", 3) for i, t in enumerate([*texts, texts[0]])], CANDIDATE)
    r = similar.bounded_similarities(df).first()
    pairs = [SequenceMatcher(None, a, b).ratio() for i, a in enumerate([*texts, texts[0]]) for b in [*texts, texts[0]][i + 1 :]]
    assert (r["decided_by"], r["similarity"], r["pairs"]) == ("all", pytest.approx(min(pairs)), 10) and r["aligned"] >= 14
    assert dedupe.classify_groups(df, similar.bounded_similarities(df)).first()["class"] == dedupe.VERSIONS


def test_odd_candidates(spark):
    rows = [(1, 0, None, None, "", "", "", 1), (1, 1, "", None, "", "", "", 1), (2, 0, "a", "broken", "", "", "", 1), (2, 1, "a", None, "", "", "", 1), (3, 0, "a", None, "", "", "", 1)]
    df = spark.createDataFrame(rows, CANDIDATE)
    assert [tuple(r) for r in similar.bounded_similarities(df).collect()] == [(1, 1.0, "copies", 0, 0)]
    assert similar.bounded_similarities(df.filter("false")).count() == 0
