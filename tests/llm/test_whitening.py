import random

import numpy as np
import pytest

from loomq.llm import whitening as w

SF = "/root/testdata/sf0.001"
NAMES = "part n sums values vectors x component".split()


def brute(vectors: np.ndarray, count: int = w.COMPONENTS):
    """Whole numbers, fit size, sums, eigenvalues and eigenvectors by one decomposition of the covariance."""
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(0)
    gaps = (once - 1_000_000) - (sums - n * 1_000_000) / n
    values, columns = np.linalg.eigh(gaps.T @ gaps / n)
    order = np.argsort(values)[::-1][:count]
    projected = ((x - 1_000_000) - (sums - n * 1_000_000) / n) @ columns[:, order] / np.sqrt(values[order])
    return x, n, sums, values[order] / values.sum(), projected


def test_against_one_decomposition(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = w.whitening(df).toPandas().sort_values(["vec_id", "component"])
    source = df.toPandas().sort_values("vec_id")
    x, n, sums, explained, projected = brute(np.stack(source["embedding"]))
    assert got["vec_id"].tolist() == np.repeat(source["vec_id"], 16).tolist() and set(got["n"]) == {n}
    assert got["deviation"].tolist() == np.repeat(((n * x - sums) ** 2).sum(1), 16).tolist()
    own = got["whitened"].to_numpy().reshape(-1, 16)
    signs = np.sign((own * projected).sum(0))
    assert np.abs(own - projected * signs).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:16] - explained).max() < 1e-12 and got["identity_error"].max() < 1e-10


@pytest.mark.parametrize("seed", range(5))
def test_merges_lose_nothing(seed):
    """States of any parts, one vector or many, of low rank or far apart, merge to the state of all."""
    r = np.random.default_rng(seed)
    dims = int(r.integers(1, 12))
    x = r.integers(-50, 50, (200, dims)) + 1_000_000 + r.integers(0, 3, (200, 1)) * 10_000
    x[:, -1] = x[:, 0]
    cuts = sorted({0, 200, *r.integers(1, 200, 6).tolist()})
    states = [w.state_of(x[a:b]) for a, b in zip(cuts, cuts[1:])]
    whole, tree = w.state_of(x), w.merged([w.merged(states[:2]), *states[2:]])
    assert (tree.n, tree.sums) == (whole.n, whole.sums) and len(tree.values) == dims
    assert np.allclose(tree.values, whole.values, rtol=1e-10, atol=1e-7 * whole.values[0])
    scatter = [s.rows().T @ s.rows() for s in (tree, whole)]
    assert np.allclose(*scatter, rtol=1e-9, atol=1e-9 * scatter[1].max())


def test_levels_of_the_tree(spark, monkeypatch):
    """With two states a merge and many tasks there are several levels."""
    monkeypatch.setattr(w, "FAN_IN", 2)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(13)
    scaled = df.select(w.scaled(df["embedding"]).alias("x"))
    model = w.fit(scaled)
    x = np.stack(scaled.toPandas()["x"])
    values = np.linalg.eigvalsh(np.cov((x - 1_000_000).astype(float).T, bias=True))[::-1]
    assert model.n == len(x) and model.sums == x.sum(0).tolist() and np.allclose(model.variances, values, rtol=1e-9)


def test_odd_vectors(spark):
    """Null, incomplete, repeated and null-id rows; clashing names; copies count once in the fit."""
    r = random.Random(3)
    own = [[r.uniform(-1, 1) for _ in range(3)] for _ in range(40)]
    data = [(i, v, "clash") for i, v in enumerate(own)] + [(0, own[0], None)] * 300 + [(None, own[1], None), (90, None, None), (91, [1.0, None, 2.0], None), (92, [float("nan"), 1.0, 2.0], None), (93, [float("-inf"), 1.0, 2.0], None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label string")
    df = df.select("*", *[df["label"].alias(n) for n in NAMES])
    got = w.whitening(df).toPandas()
    assert len(got) == 3 * 341 and set(got["n"]) == {40} and got["vec_id"].isna().sum() == 3 and got["identity_error"].max() < 1e-10
    zero = got[got["vec_id"] == 0]
    assert len(zero) == 3 * 301 and zero.groupby("component")["whitened"].nunique().tolist() == [1, 1, 1]


def test_few_or_like_vectors(spark):
    def of(rows):
        return w.whitening(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()

    assert of([]).empty and of([(1, None)]).empty and of([(1, [])]).empty
    assert of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).empty  # nothing varies
    line = of([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])
    assert set(line["component"]) == {1} and abs(line["explained"].iloc[0] - 1) < 1e-9 and abs((line["whitened"] ** 2).mean() - 1) < 1e-9
    with pytest.raises(ValueError):
        of([(1, [1.0]), (2, [1.0, 2.0])])


def test_exact_deviations():
    """Beyond 64 bits on the way, whole numbers of any size are used; a result beyond them is an error."""
    model = w.Whitening(1 << 30, [(1 << 30) * 5, (1 << 30) * 7], np.eye(2), np.ones(2), 2.0)
    x = np.array([[5, 8], [6, 9]])
    assert model.deviations(x).tolist() == [1 << 60, (1 << 60) * 5]
    with pytest.raises(OverflowError):
        model.deviations(np.array([[500, 8]]))
