"""Product codes of vectors by Lloyd's rounds with Yinyang's bounds, in whole numbers.

Vectors are scaled to whole numbers and cut into equal parts; every part position has a codebook of its own. The entries
of a codebook are clustered into groups once. A part keeps its entry, an upper bound of its distance to it and for each
group one lower bound of its distance to the group's other entries. When entries move, the bounds move by the drift of
the entry and of the group; only groups whose bound then doesn't exceed the upper bound are scanned. Bounds are whole
numbers, rounded away from the distance, so a group that isn't scanned is truly farther; what is scanned is compared by
exact squared distances, and ties go to the lower index.

A round is one pass over a stored table of parts and bounds. It writes the next one, and beside it for each task the sums
and counts of the parts that changed their entry; only these, of a fixed size, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.llm.common import apart
from loomq.session import expose_package, remove_folder, shared_folder, store

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Entries of a codebook for each group of them.
GROUP_ENTRIES = 4
#: Scaled components lie below this, so that squared distances of whole vectors and their sums fit 64 bits.
LARGEST = 1 << 27
#: Vectors that a task looks at together.
TOGETHER = 8192


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """The whole numbers floor(scale * x); null for a vector that is null, or holds null, NaN or infinite components.

    A component beyond LARGEST is an error: distances would not be exact.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = F.when(vector.isNotNull() & ~bad, vector.cast("array<double>"))
    huge = F.exists(one, lambda x: F.abs(x) * scale >= LARGEST)
    failed = F.raise_error(F.lit(f"components have to lie below {LARGEST // scale}"))
    return F.when(huge, failed.cast("array<int>")).otherwise(F.transform(one, lambda x: F.floor(x * scale).cast("int")))


@dataclass
class Codebooks:
    """Entries (parts, entries, components), the group of each entry, and how far entries and groups moved last."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray
    group_drift: np.ndarray

    def __post_init__(self):
        parts, count = self.groups.shape
        n = int(self.groups.max()) + 1
        most = max(int((self.groups[p] == g).sum()) for p in range(parts) for g in range(n))
        self.members = np.full((parts, n, most), -1)
        for p in range(parts):
            for g in range(n):
                own = np.flatnonzero(self.groups[p] == g)
                self.members[p, g, : len(own)] = own

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """The next codebooks: floors of the means; unused entries stay."""
        used = counts > 0
        means = np.where(used[..., None], np.floor_divide(sums, np.maximum(counts, 1)[..., None]), self.entries)
        drift = root_up(((means - self.entries) ** 2).sum(-1))
        by_group = np.where(self.members >= 0, drift[np.arange(len(drift))[:, None, None], self.members], 0).max(-1)
        return Codebooks(means, self.groups, drift, by_group)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def root_down(squares: np.ndarray) -> np.ndarray:
    """Floors of square roots, exact for whole numbers below 2^62."""
    roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    roots -= roots * roots > squares
    return roots + ((roots + 1) ** 2 <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    roots = root_down(squares)
    return roots + (roots * roots < squares)


def grouped(entries: np.ndarray, size: int = GROUP_ENTRIES, rounds: int = 5) -> np.ndarray:
    """The group of each entry of one codebook: a few rounds of k-means over the entries from evenly chosen ones."""
    count = max(1, len(entries) // size)
    centres = entries[np.arange(count) * len(entries) // count].astype(np.float64)
    for _ in range(rounds):
        near = ((entries[:, None].astype(np.float64) - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([entries[near == g].mean(0) if (near == g).any() else centres[g] for g in range(count)])
    return near


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest ids, ascending; a null id comes last, equal ids by their vectors."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return None
    whole = np.array([r["x"] for r in first], dtype=np.int64)
    cut = whole.reshape(len(whole), parts, -1).swapaxes(0, 1).copy()
    groups = np.stack([grouped(book) for book in cut])
    return Codebooks(cut, groups, np.zeros(groups.shape, np.int64), np.zeros((parts, int(groups.max()) + 1), np.int64))


@dataclass
class Assigned:
    """What is known of points (a vector's parts, one after the other): entry, upper bound, and lower bounds by group."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    gap = points - others
    return np.einsum("...i,...i->...", gap, gap)


def scan_groups(books: Codebooks, x: np.ndarray, part: np.ndarray, rows: np.ndarray, wanted: np.ndarray, best: np.ndarray, entry: np.ndarray, lower: np.ndarray) -> None:
    """Scan the wanted groups (points in rows by groups) by exact distances; best, entry and lower change in place."""
    was, was_best = entry[rows].copy(), best[rows].copy()
    exact: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in range(wanted.shape[1]):
        own = np.flatnonzero(wanted[:, g])
        if not len(own):
            continue
        at = rows[own]
        members = books.members[part[at], g]
        far = squared(x[at][:, None, :], books.entries[part[at][:, None], np.maximum(members, 0)])
        far = np.where(members >= 0, far, np.iinfo(np.int64).max)
        exact[g] = (own, members, far)
        low = far.argmin(1)  # members ascend, so the first of equal ones has the lower index
        nearest, index = far[np.arange(len(own)), low], members[np.arange(len(own)), low]
        better = (nearest < best[at]) | ((nearest == best[at]) & (index < entry[at]) & (index >= 0))
        best[at] = np.where(better, nearest, best[at])
        entry[at] = np.where(better, index, entry[at])
    for g, (own, members, far) in exact.items():
        at = rows[own]
        rest = np.where(members == entry[at][:, None], np.iinfo(np.int64).max, far).min(1)
        lower[at, g] = np.where(rest == np.iinfo(np.int64).max, LARGEST * 8, root_down(np.minimum(rest, 1 << 61)))
    left = np.flatnonzero(was != entry[rows])  # the entry that was left counts for its group again
    old = books.groups[part[rows[left]], was[left]]
    lower[rows[left], old] = np.minimum(lower[rows[left], old], root_down(was_best[left]))


def assign(books: Codebooks, x: np.ndarray, part: np.ndarray, known: Assigned | None) -> tuple[Assigned, int]:
    """The nearest entry of every point, lower index first, and how many distances it took."""
    n, groups = len(x), books.members.shape[1]
    if known is None:
        entry, best = np.zeros(n, np.int64), squared(x, books.entries[part, 0])
        lower = np.full((n, groups), 0, np.int64)
        scan_groups(books, x, part, np.arange(n), np.ones((n, groups), bool), best, entry, lower)
        return Assigned(entry, root_up(best), lower), n * books.groups.shape[1]
    entry, lower = known.entry.copy(), np.maximum(known.lower - books.group_drift[part], 0)
    upper = known.upper + books.drift[part, entry]
    open_ = np.flatnonzero(lower.min(1) <= upper)
    if not len(open_):
        return Assigned(entry, upper, lower), 0
    best = np.zeros(n, np.int64)
    best[open_] = squared(x[open_], books.entries[part[open_], entry[open_]])
    upper[open_] = root_up(best[open_])
    wanted = lower[open_] <= upper[open_][:, None]
    needed = wanted.any(1)
    rows, wanted = open_[needed], wanted[needed]
    scan_groups(books, x, part, rows, wanted, best, entry, lower)
    upper[rows] = root_up(best[rows])
    sizes = (books.members >= 0).sum(-1)
    return Assigned(entry, upper, lower), len(open_) + int((wanted * sizes[part[rows]]).sum())


# --- passes over the table ------------------------------------------------------------------------------------------

STATE = "row long, x array<int>, entry array<int>, upper array<int>, lower array<int>"
_STATE = pa.schema([("kind", pa.string()), ("row", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("x", "entry", "upper", "lower")], ("changed", pa.list_(pa.int64()))])
_PASS = "kind string, " + STATE + ", changed array<long>"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _lists(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32), pa.array(values.reshape(-1).astype(np.int32)))


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches joined until they have the rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_pass(books: Codebooks, first: bool):
    """A task's work: the rows with their new entries and bounds, then one row with what changed.

    changed holds for each part and entry the count and the sum of the components that came less those that left, and
    last the distances that were computed.
    """
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, looked = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64), 0
        for table in gathered(batches, TOGETHER):
            n = table.num_rows
            if not n:
                continue
            column = {c: table.column(c).combine_chunks() for c in table.schema.names}
            x = _matrix(column["x"], n).reshape(n * parts, width)
            part = np.tile(np.arange(parts), n)
            known = None if first else Assigned(*[_matrix(column[c], n * parts) for c in ("entry", "upper", "lower")])
            if known is not None:
                known.entry, known.upper = known.entry.reshape(-1), known.upper.reshape(-1)
            new, seen = assign(books, x, part, known)
            looked += seen
            came = np.arange(n * parts) if known is None else np.flatnonzero(new.entry != known.entry)
            np.add.at(sums, part[came] * entries + new.entry[came], x[came])
            np.add.at(counts, part[came] * entries + new.entry[came], 1)
            if known is not None:
                np.subtract.at(sums, part[came] * entries + known.entry[came], x[came])
                np.subtract.at(counts, part[came] * entries + known.entry[came], 1)
            lists = [_lists(new.entry.reshape(n, -1)), _lists(new.upper.reshape(n, -1)), _lists(new.lower.reshape(n, -1))]
            yield pa.RecordBatch.from_arrays([pa.array(["row"] * n), column["row"], column["x"], *lists, pa.nulls(n, _STATE.field("changed").type)], schema=_STATE)
        flat = [*np.concatenate([counts[:, None], sums], axis=1).reshape(-1).tolist(), looked]
        yield pa.RecordBatch.from_pylist([{"kind": "sum", "changed": flat}], _STATE)

    return run


@dataclass
class Fitted:
    """Codebooks after all rounds, the table of parts with entries for them, and the distances of each pass."""

    books: Codebooks
    state: DataFrame
    folder: str
    looked: list[int]


def fit(rows: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Fitted:
    """Lloyd's rounds over stored rows (row, x), and a last assignment.

    A pass reads the state of the one before and writes its own in the shared folder; then the former goes. A lost task
    is run again over the same stored rows, and gives the same.
    """
    spark, looked = rows.sparkSession, []
    parts, entries, width = books.entries.shape
    sums, counts, state, last = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), rows, None
    for n in range(rounds + 1):
        folder = shared_folder(spark, "codes")
        state.mapInArrow(one_pass(books, n == 0), _PASS).write.mode("overwrite").partitionBy("kind").parquet(folder)
        read = spark.read.schema(_PASS).parquet(folder)
        changed = read.filter("kind = 'sum'").select(F.posexplode("changed").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
        totals = np.zeros(parts * entries * (width + 1) + 1, np.int64)
        for r in changed.collect():  # a row for each number of the codebooks
            totals[r["at"]] = r["value"]
        looked.append(int(totals[-1]))
        if last is not None:
            remove_folder(spark, last)
        state, last = read.filter("kind = 'row'").select("row", "x", "entry", "upper", "lower"), folder
        if n < rounds:
            delta = totals[:-1].reshape(parts, entries, width + 1)
            counts, sums = counts + delta[..., 0], sums + delta[..., 1:]
            books = books.moved(sums, counts)
    return Fitted(books, state, last, looked)


def codes_of(books: Codebooks):
    """A task's code and exact error of every row of the last pass."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, entry = _matrix(batch.column("x"), n).reshape(n, parts, width), _matrix(batch.column("entry"), n).reshape(n, parts)
            error = squared(x, books.entries[np.arange(parts)[None], entry]).sum(1)
            code = pa.array(["".join(f"{e:02x}" for e in row) for row in entry.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), code, pa.array(error, pa.int64())], names=["row", "code", "error"])

    return run


RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """Every kept vector's code, with its squared error, the errors summed over its label, and the codebooks' digest.

    Vectors that are null, or hold null, NaN or infinite components, go. Components become floor(scale * x); the vector
    is cut into equal parts. A part's codebook begins with that part of the vectors with the smallest ids (null ids last,
    equal ids by vector; fewer vectors than entries give fewer entries). Each round assigns parts to the nearest entry,
    ties to the lower index, and moves entries to the floors of their means; parts are assigned once more at the end.
    Labels that are null go together. Repeated rows are rows of their own; an empty table gives no rows. Vectors of
    several lengths, or of one that the parts don't divide, are an error, and so are components beyond LARGEST / scale.
    """
    if entries > 256:
        raise ValueError("two digits hold at most 256 entries")
    spark = df.sparkSession
    expose_package(spark)
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), scaled(F.col(f"`{vector_col}`"), scale).alias("x"), F.col(f"`{label_col}`").alias("label"))
    kept = store(own.filter(F.col("x").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "vectors")
    books = None
    lengths = kept.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if lengths["most"] is not None:
        if lengths["least"] != lengths["most"] or lengths["most"] % parts or not lengths["most"]:
            raise ValueError(f"vectors need one length that {parts} parts divide, not {lengths['least']} to {lengths['most']}")
        books = first_codebooks(kept, parts, entries)
    if books is None:
        return spark.createDataFrame([], RESULT)
    fitted = fit(kept.select("row", "x"), books, rounds)
    coded = fitted.state.mapInArrow(codes_of(fitted.books), "row long, code string, error long")
    named = coded.join(kept.select("row", "vec_id", "label"), "row")
    key = F.to_json(F.struct("label"))  # of a null label too
    result = store(named.select("vec_id", key.alias("key"), "code", "error"), "coded")
    remove_folder(spark, fitted.folder)
    by_label = apart(result.groupBy("key").agg(F.sum("error").alias("label_error")), "key")
    return result.join(by_label, "key").select("vec_id", "code", "error", "label_error", F.lit(fitted.books.digest()).alias("codebooks_sha256"))


# --- SQL --------------------------------------------------------------------------------------------------------------


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds spelt out in SQL, every distance of each."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pieces AS MATERIALIZED (
  SELECT row, vec_id, label, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS v
  FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (
  SELECT p, k, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id, row) - 1 AS k FROM pieces) WHERE k < {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""
near{n} AS MATERIALIZED (
  SELECT s.row, s.p, arg_min(b.k, d * {entries} + b.k) AS k, min(d) AS d
  FROM pieces s JOIN book{n} b USING (p), LATERAL (
    SELECT list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d)
  GROUP BY ALL)""")
        if n < rounds:
            steps.append(f"""
means{n} AS (
  SELECT p, k, list(m ORDER BY i) AS v FROM (
    SELECT near.p, near.k, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM near{n} near JOIN pieces USING (row, p), range(1, (SELECT max(len(v)) FROM pieces) + 1) t(i) GROUP BY ALL) GROUP BY p, k),
book{n + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN means{n} m USING (p, k))""")
    return "WITH " + ",".join(steps) + f""",
whole AS (
  SELECT vec_id, label, row, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} JOIN pieces USING (row, p) GROUP BY vec_id, label, row),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM whole, digest"""


ORACLE = oracle()
