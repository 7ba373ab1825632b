"""Whitening of embeddings by merging singular value decompositions.

The distinct vectors are dealt over tasks. A task keeps of all vectors it has seen their number, exact sums and the full
decomposition (all singular values and right vectors) of their deviations from the mean. Two such states merge without
loss: the rows singular value * vector of both, and one row for the gap between the means, weighted by the square root of
n1 n2 / (n1 + n2), have the same scatter as all vectors around the common mean, and are decomposed again. Tasks merge batches
into their state, and the states of the tasks are merged in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.session import expose_package, store

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: States that one task merges.
FAN_IN = 8
#: Vectors that are decomposed together.
TOGETHER = 4096
#: Of a variance, against the largest, that rounding alone can leave; a component below has none and is left out.
LEAST_VARIANCE = 1e-20


def scaled(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The whole numbers floor(scale * c) + shift; null for a vector that is null, or holds null, NaN or infinite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector.cast("array<double>"), lambda c: F.floor(c * scale) + shift))


@dataclass
class State:
    """Vectors seen: how many, their exact sums, and values (falling) and vectors of their deviations' decomposition."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def rows(self) -> np.ndarray:
        return self.values[:, None] * self.vectors


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors; missing rows count as zeros, so that no dimension goes."""
    dims = rows.shape[1]
    if len(rows) < dims:
        rows = np.vstack([rows, np.zeros((dims - len(rows), dims))])
    elif len(rows) > 2 * dims:
        rows = np.linalg.qr(rows, mode="r")
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def state_of(x: np.ndarray) -> State:
    """The state of whole-number vectors (rows); only small whole numbers are turned into floating ones."""
    sums = [int(s) for s in x.sum(0)]
    near = np.array([s // len(x) for s in sums], np.int64)
    gaps = (x - near).astype(np.float64)
    return State(len(x), sums, *decomposed(gaps - gaps.mean(0)))


def mean_gap(a: State, b: State) -> np.ndarray:
    """Mean of a less mean of b, from exact whole numbers."""
    return np.array([(p * b.n - q * a.n) / (a.n * b.n) for p, q in zip(a.sums, b.sums)])


def merged(states: list[State]) -> State:
    """One state of all: the rows of each, a mean-correction row for each further one, decomposed again."""
    whole, rows = State(states[0].n, states[0].sums, states[0].values, states[0].vectors), [states[0].rows()]
    for other in states[1:]:
        weight = math.sqrt(whole.n * other.n / (whole.n + other.n))
        rows += [other.rows(), (weight * mean_gap(whole, other))[None]]
        whole.n, whole.sums = whole.n + other.n, [p + q for p, q in zip(whole.sums, other.sums)]
    if len(states) > 1:
        whole.values, whole.vectors = decomposed(np.vstack(rows))
    return whole


_STATE = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
STATE = "part long, n long, sums array<long>, values array<double>, vectors array<double>"


def _record(part: int, state: State) -> dict:
    return {"part": part, "n": state.n, "sums": state.sums, "values": state.values.tolist(), "vectors": state.vectors.reshape(-1).tolist()}


def _states(table: pa.Table | pa.RecordBatch) -> list[State]:
    return [State(r["n"], r["sums"], np.array(r["values"]), np.array(r["vectors"]).reshape(len(r["values"]), -1)) for r in table.to_pylist()]


def _matrix(column, rows: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def task_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of a task's vectors, or nothing if it has none; batches are merged as they come."""
    state = None
    held: list[np.ndarray] = []

    def taken(state: State | None) -> State:
        own = state_of(np.vstack(held))
        held.clear()
        return own if state is None else merged([state, own])

    for batch in batches:
        if batch.num_rows:
            held.append(_matrix(batch.column("x"), batch.num_rows))
        if sum(map(len, held)) >= TOGETHER:
            state = taken(state)
    if held:
        state = taken(state)
    if state is not None:
        yield pa.RecordBatch.from_pylist([_record(0, state)], _STATE)


def merge_group(key: tuple, states: pa.Table) -> pa.Table:
    """One state of a group's, in the order of their parts."""
    ordered = states.sort_by("part")
    return pa.Table.from_pylist([_record(key[0].as_py(), merged(_states(ordered)))], _STATE)


def tree_merged(vectors: DataFrame) -> State | None:
    """The state of all vectors (x); the driver gets the last one only, of dims by dims numbers.

    Every level is written, so that the merges above a lost task don't begin again.
    """
    level = store(vectors.select("x").mapInArrow(task_state, STATE).withColumn("part", F.spark_partition_id().cast("long")), "states")
    left = level.agg(F.max("part")).first()[0]
    if left is None:
        return None
    while left > 0:
        left //= FAN_IN
        level = store(level.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(merge_group, STATE), "states")
    return _states(level.toArrow())[0]


@dataclass
class Whitening:
    """The fit: vectors counted, their sums, unit components (rows) with their variances, falling, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray, count: int) -> np.ndarray:
        """Deviations from the mean on the first components over their standard deviations."""
        near = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, near)])
        return ((x - near).astype(np.float64) - rest) @ self.components[:count].T / np.sqrt(self.variances[:count])

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums over dimensions of (n * x - sums)^2, exact; an error where they don't fit 64 bits."""
        gaps = x * self.n - np.array(self.sums, dtype=object) if self._wide(x) else x * self.n - np.array(self.sums, np.int64)
        squares = (gaps * gaps).sum(1)
        if squares.dtype == object and len(squares) and max(squares) >= 1 << 63:
            raise OverflowError("a deviation doesn't fit 64 bits")
        return squares.astype(np.int64)

    def _wide(self, x: np.ndarray) -> bool:
        most = max([abs(int(x.max(initial=0)) * self.n - min(self.sums)), abs(int(x.min(initial=0)) * self.n - max(self.sums)), max(map(abs, self.sums))])
        return most * most * x.shape[1] >= 1 << 62


def fit(vectors: DataFrame) -> Whitening | None:
    """Components of all dimensions with a variance, by the merged decompositions; a component's largest entry is positive."""
    state = tree_merged(vectors)
    if state is None:
        return None
    variances = state.values**2 / state.n
    kept = variances > LEAST_VARIANCE * max(1.0, variances.max(initial=0.0))
    components = state.vectors[kept]
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)]) if len(components) else np.ones(0)
    return Whitening(state.n, state.sums, components * signs[:, None], variances[kept], float(variances.sum()))


def identity_error(vectors: DataFrame, model: Whitening, count: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity; tasks send sums of products only."""
    k = min(count, len(model.components))
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_matrix(batch.column("x"), batch.num_rows), k)
                total, sums = total + w.T @ w, sums + w.sum(0)
        flat = [*total.reshape(-1).tolist(), *sums.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.float64())], names=["at", "value"])

    summed = vectors.select("x").mapInArrow(products, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # k * k + k rows
    flat = np.array([r["value"] for r in sorted(summed, key=lambda r: r["at"])])
    mean = flat[k * k :] / model.n
    return float(np.abs(flat[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Every kept vector on the first components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, or hold null, NaN or infinite entries, go; entries become floor(scale * c) + shift. The fit is
    over each distinct vector once, of which n is the number. Components are numbered from 1 by falling variance; those
    without variance are left out, so fewer than count are there where the vectors span less, and none where all are
    alike. Repeated rows are rows of their own, null ids are kept, an empty table gives no rows. Vectors of several
    lengths are an error, and so is a deviation beyond 64 bits. Among equal variances the components are any that fit.
    """
    spark = df.sparkSession
    expose_package(spark)
    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), scaled(F.col(f"`{vector_col}`"), scale, shift).alias("x")).filter(F.col("x").isNotNull())
    distinct = store(kept.select("x").distinct(), "distinct")
    lengths = distinct.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if lengths["least"] != lengths["most"]:
        raise ValueError(f"vectors need one length, not {lengths['least']} to {lengths['most']}")
    model = fit(distinct) if lengths["most"] else None
    if model is None:
        return spark.createDataFrame([], RESULT)
    k, error = min(count, len(model.components)), identity_error(distinct, model, count)
    explained = model.variances[:k] / model.trace if k else np.zeros(0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column("x"), m) if m else np.zeros((0, len(model.sums)), np.int64)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            columns = [
                ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), pa.array(np.repeat(model.deviations(x), k), pa.int64()),
                pa.array(model.whitened(x, k).reshape(-1), pa.float64()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return kept.mapInArrow(project, RESULT)
