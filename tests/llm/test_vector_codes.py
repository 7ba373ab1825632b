import hashlib
import random

import duckdb
import numpy as np
import pytest

from loomq.llm import vector_codes as v

SF = "/root/testdata/sf0.001"
NAMES = "row x entry upper lower kind changed key code error at value".split()


def plain(vectors: np.ndarray, parts: int, entries: int, rounds: int):
    """Lloyd's rounds with every distance: codes, errors and codebooks."""
    whole = np.floor(v.SCALE * vectors.astype(float)).astype(np.int64)
    cut = whole.reshape(len(whole), parts, -1)
    books = cut[:entries].copy()

    def nearest():
        gaps = ((cut[:, None] - books[None]) ** 2).sum(-1)  # vector, entry, part
        return gaps.argmin(1), gaps.min(1)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(parts):
            for e in range(len(books)):
                own = cut[at[:, p] == e, p]
                if len(own):
                    books[e, p] = own.sum(0) // len(own)
    at, far = nearest()
    flat = ",".join(map(str, books.swapaxes(0, 1).reshape(-1).tolist()))
    return ["".join(f"{e:02x}" for e in row) for row in at.tolist()], far.sum(1).tolist(), hashlib.sha256(flat.encode()).hexdigest()


def frame(spark, vectors, labels=None):
    rows = [(i, [float(x) for x in vec], None if labels is None else labels[i]) for i, vec in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_rounds(spark, seed):
    """Coarse numbers, so that ties between entries and equal entries are common."""
    r = np.random.default_rng(seed)
    vectors = r.integers(-4, 5, (300, 8)) * (1 if seed % 2 else 0.001)
    got = v.vector_codes(frame(spark, vectors), parts=4, entries=(16, 7, 3, 1)[seed]).toPandas().sort_values("vec_id")
    codes, errors, digest = plain(vectors, 4, (16, 7, 3, 1)[seed], v.ROUNDS)
    assert got["code"].tolist() == codes and got["error"].tolist() == errors and set(got["codebooks_sha256"]) == {digest}
    assert set(got["label_error"]) == {sum(errors)}


def test_against_sql(spark):
    got = sorted(map(tuple, v.vector_codes(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.sql(v.ORACLE).fetchall())


def test_bounds_save_distances_and_hold():
    """Bounds never exceed the distances they stand for, and later rounds look at fewer entries."""
    r = np.random.default_rng(1)
    x = (r.normal(0, 1, (4000, 4)) * 2000 + r.integers(0, 6, (4000, 1)) * 9000).astype(np.int64)
    part, entries = np.zeros(4000, np.int64), x[None, :16].copy()
    groups = v.grouped(entries[0])[None]
    books = v.Codebooks(entries, groups, np.zeros((1, 16), np.int64), np.zeros((1, groups.max() + 1), np.int64))
    known, looked = None, []
    for _ in range(6):
        known, seen = v.assign(books, x, part, known)
        looked.append(seen)
        far = ((x[:, None] - books.entries[0][None]) ** 2).sum(-1)
        assert (known.entry == far.argmin(1)).all()
        assert (known.upper.astype(float) >= np.sqrt(far.min(1)) - 1e-6).all()
        for g in range(groups.max() + 1):
            rest = np.where((groups[0] == g)[None] & (np.arange(16)[None] != known.entry[:, None]), far, 1 << 60).min(1)
            assert (known.lower[:, g] <= np.sqrt(rest.astype(float)) + 1e-6).all()
        sums, counts = np.zeros((1, 16, 4), np.int64), np.zeros((1, 16), np.int64)
        np.add.at(sums[0], known.entry, x)
        np.add.at(counts[0], known.entry, 1)
        books = books.moved(sums, counts)
    assert looked[-1] < looked[0] / 2


def test_roots():
    values = np.array([0, 1, 2, 3, 4, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 30) ** 2 + 1], np.int64)
    assert v.root_down(values).tolist() == [0, 1, 1, 1, 2, (1 << 30) - 1, 1 << 30, 1 << 30]
    assert v.root_up(values).tolist() == [0, 1, 2, 2, 2, 1 << 30, 1 << 30, (1 << 30) + 1]


def test_odd_vectors(spark):
    r = random.Random(2)
    own = [[r.uniform(-1, 1) for _ in range(16)] for _ in range(50)]
    bad = [None, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16]
    data = [(i, x, i % 3 or None) for i, x in enumerate(own)] + [(7, own[7], 1)] * 200 + [(None, own[3], None)] + [(-9 - k, x, 5) for k, x in enumerate(bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    df = df.select("*", *[df["label"].alias(n) for n in NAMES])
    got = v.vector_codes(df).toPandas()
    assert len(got) == 251 and got["vec_id"].isna().sum() == 1 and got["code"].str.len().eq(16).all()
    labels = {i: i % 3 or None for i in range(50)}
    by = got.assign(label=[labels[i] if i == i else None for i in got["vec_id"]]).assign(label=lambda d: d["label"].fillna(-1))
    by.loc[by["vec_id"] == 7, "label"] = 1
    assert (by.groupby("label")["error"].transform("sum") == by["label_error"]).all()


def test_few_vectors_and_errors(spark):
    def of(rows):
        return v.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()

    assert of([]).empty and of([(1, None, 2)]).empty
    one = of([(1, [0.5] * 8, None), (1, [0.5] * 8, None)])
    assert one["code"].tolist() == ["00" * 8] * 2 and one["error"].tolist() == [0, 0] and one["label_error"].tolist() == [0, 0]
    for bad in ([0.5] * 7, []):
        with pytest.raises(ValueError):
            of([(1, bad, 0)])
    with pytest.raises(Exception, match="components have to lie below"):
        of([(1, [1e6] * 8, 0)])
