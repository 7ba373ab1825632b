import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomq.llm import jaccard_join as j


def brute(rows, threshold=0.8):
    sets = [(i, frozenset(j.shingles((t or "").encode()).tolist())) for i, t in rows]
    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(k)
    forest, links = j.Forest(len(sets)), [0] * len(sets)
    for k, (_, s) in enumerate(sets):
        for other, n in Counter(o for x in s for o in index[x] if o != k).items():
            if n >= threshold * (len(s) + len(sets[other][1]) - n) - 1e-9:
                links[k] += 1
                forest.join(k, other)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[forest.find(k)] = min(least.get(forest.find(k), i), i)
    return {i: (least[forest.find(k)], links[k]) for k, (i, _) in enumerate(sets)}


def made():
    """Groups of near copies, one of them large, a passage that many texts share, and exact copies."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage, rows = [word() for _ in range(14)], []
    for _ in range(60):
        base = [word() for _ in range(r.choice([3, 5, 8, 40, 120]))]
        for _ in range(r.choice([1, 2, 5])):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own + (passage if r.random() < 0.5 else [])))
    base = [word() for _ in range(100)]
    for _ in range(70):
        own = list(base)
        own[r.randrange(len(own))] = word()
        rows.append(" ".join(own))
    rows += [rows[-1]] * 30
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("limits", [{}, {"large": 8, "block": 16}, {"large": 3, "block": 2}])
def test_classes_and_links(spark, limits):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.jaccard_classes(df, **limits).collect()}
    assert got == brute(rows)


def test_keep_one(spark, tmp_path):
    rows = made()
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    classes = brute(rows)
    kept = j.keep_one(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and sorted(classes[i][0] for i in ids) == sorted({c for c, _ in classes.values()})


def test_odd(odd, empty):
    out = j.jaccard_classes(odd).collect()
    assert len(out) == odd.count()
    copies = [r for r in out if r["n_copies"] == 3]
    assert len(copies) == 3 and {r["n_links"] for r in copies} == {2} and {r["class_id"] for r in copies} == {None}
    assert {(r["class_id"], r["n_links"]) for r in out if r["doc_id"] in (1, 2, 5)} == {(1, 0), (2, 0), (5, 0)}
    assert j.jaccard_classes(empty).count() == 0
    assert j.keep_one(odd).count() == odd.count() - 2
    assert j.keep_one(empty).count() == 0 and j.keep_one(odd).columns == odd.columns


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    forest = j.Forest(400)
    for a, b in edges:
        forest.join(a, b)
    got = {x["node"]: x["component"] for x in j.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: forest.find(n) for e in edges if e[0] != e[1] for n in e}
    assert j.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_of_runs():
    runs = j.runs_for(j.RECALL, j.THRESHOLD)
    assert j.lost(runs, j.THRESHOLD) <= 1 - j.RECALL < j.lost(runs - 1, j.THRESHOLD)
    assert j.least_shared(0.8) < 0.8 * j.TOKENS
    for level in range(1, j.LEVELS + 1):
        for path in (-5, 0, 7, 1 << 62):
            places = j.split_places(runs * j.CHOICE, level, path)
            assert len(set(places)) == j.CHOICE and all(runs * j.CHOICE <= p < j.TOKENS for p in places)
    with pytest.raises(ValueError, match="recall"):
        j.runs_for(0.99999, 0.1)


def _tokens_of_pairs(pairs, values, similarity, seed):
    """Sampled tokens of pairs that share each with a similarity, the runs' first ones drawn from few values, so that
    every bucket is split, those of the fewest values by the cluster."""
    r = np.random.default_rng(seed)
    first = j.runs_for(j.RECALL, j.THRESHOLD) * j.CHOICE
    a = r.integers(1 << 20, 1 << 32, (pairs, j.TOKENS), np.uint64).astype(np.uint32)
    b = r.integers(1 << 20, 1 << 32, (pairs, j.TOKENS), np.uint64).astype(np.uint32)
    for c in range(first):
        n = values[c % len(values)]
        a[:, c] = r.integers(0, n, pairs)
        b[:, c] = (a[:, c] + r.integers(1, n, pairs)) % n
    shared = r.random((pairs, j.TOKENS)) < similarity
    return a, np.where(shared, a, b)


def test_recall_with_splits(spark):
    """At the default limits, with all buckets over SMALL and some over LARGE: pairs at the threshold are linked."""
    pairs = 4_000
    a, b = _tokens_of_pairs(pairs, (4, 6, 14, 20), 0.8, 3)
    rows = [(b"%06d%s" % (i, side), x[i].tobytes()) for side, x in ((b"a", a), (b"b", b)) for i in range(pairs)]
    sets = spark.createDataFrame(rows, "set_key binary, tokens binary").repartition(8)
    found = j.components(j.candidate_edges(sets, j.THRESHOLD, j.RECALL))
    component = {bytes(r["node"]): bytes(r["component"]) for r in found.collect()}
    possible = [i for i in range(pairs) if (a[i] == b[i]).sum() >= j.least_shared(j.THRESHOLD)]
    met = sum((c := component.get(b"%06da" % i)) is not None and c == component.get(b"%06db" % i) for i in possible)
    print(f"recall at 0.8 with splits: {met} of {pairs}")
    assert met >= 0.999 * pairs
    assert len(set(component.values())) > 0.95 * pairs  # and the buckets themselves weren't linked


def test_recall_of_a_split_bucket():
    """In one bucket of 600 a pair is found with the probability that its path's tokens give; over all its buckets nearly
    always, even if one level's tokens part it in one of them."""
    pairs, first, least = 300, j.runs_for(j.RECALL, j.THRESHOLD) * j.CHOICE, j.least_shared(0.8)
    missed = 0
    for seed in range(5):
        a, b = _tokens_of_pairs(pairs, (2,), 0.8, seed)
        tokens, forest = np.vstack([a, b]), j.Forest(2 * pairs)
        for c in range(first):
            for v in (0, 1):
                j.link_bucket(tokens, np.flatnonzero(tokens[:, c] == v), forest, 0, 31 * c + v, first, least)
        missed += sum(forest.find(i) != forest.find(pairs + i) for i in range(pairs) if (a[i] == b[i]).sum() >= least)
    assert missed == 0


def test_keep_one_whatever_the_splits(spark, tmp_path):
    """The size of a split changes between scans, as it does with the number of executors; the same rows stay."""
    rows = made()
    spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartitionByRange(1, "doc_id").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    classes, setting, found = brute(rows), "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(setting)
    try:
        for at_start, at_end in (("128m", "2k"), ("2k", "128m")):
            spark.conf.set(setting, at_start)
            kept = j.keep_one(spark.read.parquet(str(tmp_path / "d")))
            spark.conf.set(setting, at_end)
            found.append(sorted(r["doc_id"] for r in kept.collect()))
    finally:
        spark.conf.set(setting, before)
    assert found[0] == found[1] and sorted(classes[i][0] for i in found[0]) == sorted({c for c, _ in classes.values()})


def test_alike_buckets_are_not_split(spark, monkeypatch):
    """A group of near copies is linked where it is met first: only buckets whose sets differ go to further levels."""
    r, n = np.random.default_rng(5), 300
    base = r.integers(0, 1 << 32, j.TOKENS, np.uint64).astype(np.uint32)
    own = r.integers(0, 1 << 32, (n, j.TOKENS), np.uint64).astype(np.uint32)
    near = np.where(r.random((n, j.TOKENS)) < 0.95, base, own)
    apart = r.integers(0, 1 << 32, (n, j.TOKENS), np.uint64).astype(np.uint32)
    apart[:, 0] = 7  # one common shingle
    rows = [(b"%s%03d" % (kind, i), x[i].tobytes()) for kind, x in ((b"n", near), (b"x", apart)) for i in range(n)]
    split, paths = [], j._paths

    def counted(rows, path, places):
        if "path" in rows.columns:
            split.append(sorted({bytes(k["set_key"]) for k in rows.select("set_key").collect()}))
        return paths(rows, path, places)

    monkeypatch.setattr(j, "_paths", counted)
    sets = spark.createDataFrame(rows, "set_key binary, tokens binary")
    found = {bytes(k["node"]): bytes(k["component"]) for k in j.components(j.candidate_edges(sets, j.THRESHOLD, j.RECALL, large=64)).collect()}
    assert split == [[b"x%03d" % i for i in range(n)]]
    assert len({found[b"n%03d" % i] for i in range(n)}) == 1 and not any(k.startswith(b"x") for k in found)
