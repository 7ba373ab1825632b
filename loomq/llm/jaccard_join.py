"""Similarity join of documents on word shingles by chosen paths.

A document is its set of shingles of five words. Equal sets are one set from the start, so exact copies cost nothing.
Every set is embedded as 64 sampled tokens, the minima of its shingles under 64 hash functions: two sets share a token
with a probability that equals their Jaccard similarity.

1. A run splits all sets on a few tokens of its own: sets that share one meet in a bucket. A bucket is split again on
   further tokens, which its path chooses, until it is small or doesn't shrink any more. A pair that one bucket's tokens
   part has others in the buckets it shares besides. Runs repeat until the target recall is met for a pair at the
   threshold, splits counted in.
2. Small buckets compare all their sets by shared tokens and link what may reach the threshold, by a wide margin. A
   bucket yields a forest, not pairs. Its links make candidate groups.
3. Within candidate groups every pair gets its exact similarity, in blocks by matrix products of shingle incidence, so
   that a group of any size is spread over many tasks. Only sums and forests leave a task.

Classes are the connected components of the exact links.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.llm.common import apart, documents_of, hold, map_batches, raw_texts, record_batch
from loomq.llm.decontamination import words_of
from loomq.session import expose_package, materialize, store

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Sampled tokens of a set, and how many of them a run or a level splits on.
TOKENS, CHOICE = 64, 4
#: Share of sampled tokens that makes a candidate, this far below the threshold (5 standard deviations).
MARGIN = 5.0
#: A bucket of at most SMALL sets is compared outright; one over LARGE is split by the cluster, not in one task. A path
#: is split at most LEVELS times after its run's first step, wherever that is done.
SMALL, LARGE, LEVELS = 256, 1024, 4
#: A large bucket is alike if one of its next splits would keep so much of it together, as told by its first set.
ALIKE = 0.75
#: Sets of a candidate group that one task compares with as many others.
BLOCK = 512
#: Words whose hashes a worker keeps.
KEPT_WORDS = 300_000

_SETS = "doc_id long, set_key binary, n_shingles long, tokens binary"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n_shingles", pa.int64()), ("tokens", pa.binary())])
_EDGE = "a binary, b binary"
_EDGE_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_FULL = "doc_id long, set_key binary, shingles binary"
_FULL_ARROW = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.binary())])
_EXACT = "a binary, b binary, links long"
_EXACT_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

_seeds = np.random.default_rng(20240229)
_MULTIPLY = (_seeds.integers(0, 1 << 32, TOKENS, np.uint64) << np.uint64(1) | np.uint64(1)).astype(np.uint32)
_ADD = _seeds.integers(0, 1 << 32, TOKENS, np.uint64).astype(np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 1)
        if len(self) < KEPT_WORDS and len(word) <= 64:
            self[word] = value
        return value


_hashes = WordHashes()


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a text of fewer words has one, one without words none."""
    words = words_of(text)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    if not k:
        return h
    mixed = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.tobytes())


def sampled_tokens(found: np.ndarray) -> np.ndarray:
    """The minima of a set's hashes under TOKENS functions, in pieces so that very long texts stay small."""
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    best = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        x = low[i : i + 4096, None] * _MULTIPLY + _ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        best = np.minimum(best, x.min(axis=0))
    return best


def lost(runs: int, threshold: float, levels: int = LEVELS) -> float:
    """At most the probability that a pair at the threshold meets in no bucket that is compared, however deep it is split.

    It shares each of the runs' first tokens with the threshold's probability, and so as many buckets; at every split a
    bucket is lost if none of its tokens is shared. Counted here as if all buckets were split to the last level.
    """
    n, parted = runs * CHOICE, 1 - (1 - (1 - threshold) ** CHOICE) ** levels
    return sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) * parted**k for k in range(n + 1))


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met with the target probability."""
    for runs in range(1, (TOKENS - LEVELS * CHOICE) // CHOICE + 1):
        if lost(runs, threshold) <= 1 - recall:
            return runs
    raise ValueError(f"{TOKENS} tokens can't give a recall of {recall} at a similarity of {threshold}")


def split_places(first: int, level: int, path: int) -> list[int]:
    """The tokens on which a bucket with some path is split at a level, from 1; first is the number of the runs' tokens.

    Every level has tokens of its own, of which the path picks some.
    """
    width = (TOKENS - first) // LEVELS
    return [first + (level - 1) * width + (path % width + k) % width for k in range(CHOICE)]


def least_shared(threshold: float) -> int:
    """Sampled tokens that a candidate shares at least."""
    return max(1, math.floor(TOKENS * threshold - MARGIN * math.sqrt(TOKENS * threshold * (1 - threshold))))


class Forest:
    """Union and find over the numbers from 0; a root is the least of its tree."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def join_all(self, rows: np.ndarray, columns: np.ndarray) -> None:
        for i, j in zip(rows.tolist(), columns.tolist()):
            self.join(i, j)


def link_bucket(tokens: np.ndarray, members: np.ndarray, forest: Forest, level: int, path: int, first: int, least: int) -> None:
    """Link the candidates among some sets; a large bucket that has been split level times is split on its path's tokens."""
    n = len(members)
    if n > SMALL and level < LEVELS:
        parts = []
        for c in split_places(first, level + 1, path):
            values, inverse, counts = np.unique(tokens[members, c], return_inverse=True, return_counts=True)
            order = np.argsort(inverse, kind="stable")
            found = zip(values.tolist(), np.split(order, np.cumsum(counts)[:-1]))
            parts += [(xxhash.xxh64_intdigest(b"%d:%d:%d" % (path, c, v)), members[p]) for v, p in found if len(p) > 1]
        if max((len(p) for _, p in parts), default=0) <= n // 2:  # else they are alike, and splitting repeats work
            for own, part in parts:
                link_bucket(tokens, part, forest, level + 1, own, first, least)
            return
    short = (tokens[members] & np.uint32(0xFFFF)).astype(np.uint16)
    for i in range(n - 1):
        near = np.flatnonzero((short[i + 1 :] == short[i]).sum(axis=1) >= least)
        for j in near.tolist():
            forest.join(int(members[i]), int(members[i + 1 + j]))


def _bucket_edges(rows: pa.Table, level: int, first: int, least: int) -> pa.Table:
    """Forest edges of all the buckets that were dealt to one group."""
    rows = rows.sort_by([("path", "ascending"), ("set_key", "ascending")])
    keys, path = rows.column("set_key").to_pylist(), rows.column("path").to_numpy()
    tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
    forest = Forest(len(keys))
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 1:
            link_bucket(tokens, np.arange(a, b), forest, level, int(path[a]), first, least)
    edges = {(keys[forest.find(i)], keys[i]) for i in range(len(keys)) if forest.find(i) != i}
    edges = sorted(e for e in edges if e[0] != e[1])
    return pa.Table.from_batches([record_batch(_EDGE_ARROW, [[e[0] for e in edges], [e[1] for e in edges]])])


def _exact_task(pairs: pa.Table, threshold: float) -> list[tuple[bytes, bytes, int]]:
    """Exact similarities between the sets of two blocks, or within one: (root, set, links weighted by copies)."""
    keys, sizes = pairs.column("set_key").to_pylist(), []
    sets = [np.frombuffer(x, np.uint64) for x in pairs.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.float32)
    copies = np.array(pairs.column("copies").to_pylist(), np.int64)
    side, both = pairs.column("block").to_numpy(), pairs.column("mixed")[0].as_py()
    if both and side.min() == side.max():
        return []  # the other block has no sets
    left = np.flatnonzero(side == side.min()) if both else np.arange(len(keys))
    right = np.flatnonzero(side == side.max()) if both else left
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[inverse]  # shingles of one set can't be shared
    ends = np.cumsum(sizes.astype(np.int64))
    shared_columns = [c[c >= 0] for c in np.split(column, ends[:-1])]
    width = int((counts > 1).sum())
    common = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, width, 4096):  # so many shingles at a time bound the matrices
        x = np.zeros((len(keys), min(4096, width - a)), np.float32)
        for i, c in enumerate(shared_columns):
            x[i, c[(c >= a) & (c < a + 4096)] - a] = 1
        common += x[left] @ x[right].T
    linked = common >= threshold * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-4
    if not both:
        np.fill_diagonal(linked, False)
    forest = Forest(len(keys))
    rows, columns = np.nonzero(linked)
    forest.join_all(left[rows], right[columns])
    links = np.zeros(len(keys), np.int64)
    links[left] += linked @ copies[right]
    if both:
        links[right] += linked.T @ copies[left]
    return [(keys[forest.find(i)], keys[i], int(links[i])) for i in range(len(keys)) if links[i]]


def _exact(rows: pa.Table, threshold: float) -> pa.Table:
    rows = rows.sort_by([("component", "ascending"), ("pair", "ascending"), ("set_key", "ascending")])
    component, pair = rows.column("component").to_pylist(), rows.column("pair").to_pylist()
    cuts = [0, *(i for i in range(1, len(pair)) if pair[i] != pair[i - 1] or component[i] != component[i - 1]), len(pair)]
    out: list[tuple[bytes, bytes, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 1:
            out += _exact_task(rows.slice(a, b - a), threshold)
    return pa.Table.from_batches([record_batch(_EXACT_ARROW, [list(c) for c in zip(*out)] or [[], [], []])])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is connected with each node of some edges (a, b).

    Labels spread along edges and jump to the label of their label until nothing changes; each round is written to the
    shared checkpoint folder.
    """
    edges = edges.filter("a != b").select("a", "b").distinct()
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("component", "near").alias("label"), F.col("component").alias("old"))
        target = labels.select(F.col("node").alias("of"), F.col("component").alias("jump"))
        jumped = spread.join(target, spread["label"] == target["of"]).select("node", F.least("label", "jump").alias("component"), "old")
        jumped = materialize(jumped)
        labels = jumped.select("node", "component")
        if jumped.filter("component != old").isEmpty():
            return labels


def _linker(level: int, first: int, least: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _bucket_edges(rows, level, first, least)


def _comparer(threshold: float) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _exact(rows, threshold)


def _paths(rows: DataFrame, path: Column, places: Column) -> DataFrame:
    """One row for each of some sampled tokens, with the path it extends."""
    token = F.substring("tokens", F.col("place") * 4 + 1, F.lit(4))
    return rows.withColumn("place", F.explode(places)).withColumn("path", F.xxhash64(path, "place", token)).drop("place")


def candidate_edges(sets: DataFrame, threshold: float, recall: float, large: int = LARGE) -> DataFrame:
    """Edges between sets that may reach the threshold; sets has set_key and tokens, each key once.

    All runs take their first step at once, without the sampled tokens; only paths that several sets share go on.
    """
    n, least = runs_for(recall, threshold) * CHOICE, least_shared(threshold)
    keys = _paths(sets, F.lit(0).cast("long"), F.sequence(F.lit(0), F.lit(n - 1))).select("path", "set_key", F.lit(None).cast("long").alias("above"))
    found: DataFrame | None = None
    for level in range(LEVELS + 1):
        sizes = apart(keys.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "path")
        shared = materialize(keys.join(sizes, "path").join(sets, "set_key").select("path", "n", "above", "set_key", "tokens"))
        # Small buckets share a task; one of more than a task's worth of comparisons has its own.
        group = F.when(F.col("n") > SMALL, F.col("path")).otherwise(F.pmod("path", F.lit(_groups(shared, 1024))))
        small = shared.filter(F.col("n") <= large).select(group.alias("dealt"), "path", "set_key", "tokens")
        edges = small.groupBy("dealt").applyInArrow(_linker(level, n, least), _EDGE)
        found = edges if found is None else found.unionByName(edges)
        big = shared.filter(F.col("n") > large)
        if big.isEmpty():
            break
        # A large bucket that is alike becomes a star, which the exact comparison takes apart; splitting it would only
        # repeat it. So does one that kept over half of the one above, or can't be split any more.
        width = (TOKENS - n) // LEVELS  # as in split_places()
        places = F.transform(F.sequence(F.lit(0), F.lit(CHOICE - 1)), lambda k: F.lit(n + level * width) + F.pmod(F.pmod("path", F.lit(width)) + k, F.lit(width)).cast("int"))
        hearts = apart(_hearts(big, places), "path")
        alike = F.lit(level == LEVELS) | (F.col("n") * 2 > F.coalesce("above", F.col("n") * 2)) | (F.col("same") >= F.col("n") * ALIKE)
        judged = big.join(hearts, "path").withColumn("alike", alike)
        found = found.unionByName(judged.filter("alike").select("a", F.col("set_key").alias("b")))
        rest = judged.filter("not alike")
        if rest.isEmpty():
            break
        # Written once: a level's rows are counted first, then read again.
        keys = store(_paths(rest, F.col("path"), places).select("path", "set_key", F.col("n").alias("above")), "paths")
    return found


def _hearts(big: DataFrame, places: Column) -> DataFrame:
    """For each bucket its first set (a), and how many sets share the first one's token at the place where most do."""
    first = apart(big.groupBy("path").agg(F.min(F.struct("set_key", "tokens")).alias("first")), "path")

    def token(tokens: Column, k: int) -> Column:
        return F.substring(tokens, F.get(places, F.lit(k)) * 4 + 1, F.lit(4))

    own, other = F.col("tokens"), F.col("first.tokens")
    shares = [F.count_if(token(own, k) == token(other, k)).alias(f"same{k}") for k in range(CHOICE)]
    told = big.join(first, "path").groupBy("path").agg(*shares, F.min("first.set_key").alias("a"))
    return told.select("path", "a", F.greatest(*[f"same{k}" for k in range(CHOICE)]).alias("same"))


def _groups(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def jaccard_classes(
    df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text",
    large: int = LARGE, block: int = BLOCK,
) -> DataFrame:
    """The class of every document, linked by a Jaccard similarity of at least the threshold on shingles of five words.

    One row for each row: doc_id, class_id (the least doc_id of its class), n_links (other documents that reach the
    threshold, copies included), n_copies (documents of the same set, itself included) and n_shingles. Words are as in
    the decontamination. A text of fewer than five words has one shingle of all of them; a null or empty text, or one
    without words, is a class of its own without links. Repeated rows are copies; a null id sorts first in a class. An
    empty table gives no rows.
    """
    docs = documents_of(df, id_col, text_col)
    expose_package(df.sparkSession)

    def sketch(rows: pa.RecordBatch) -> pa.RecordBatch:
        hold("jaccard join", _hashes.clear)
        keys, sizes, tokens = [], [], []
        for text in raw_texts(rows):
            found = shingles(text)
            keys.append(set_key(found) if len(found) else None)
            sizes.append(len(found))
            tokens.append(sampled_tokens(found).tobytes() if len(found) else None)
        return record_batch(_SETS_ARROW, [rows.column("doc_id"), keys, sizes, tokens])

    rows = materialize(map_batches(docs, sketch, _SETS).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))))
    filled = rows.filter("set_key is not null")
    sets = filled.groupBy("set_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    once = filled.join(sets, ["set_key", "id"]).select("set_key", "tokens").dropDuplicates(["set_key"])
    candidates = components(candidate_edges(materialize(once), threshold, recall, large))
    members = materialize(candidates.withColumnRenamed("node", "set_key").join(sets, "set_key").select("set_key", "component", "id", "copies"))

    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(block))
    dealt = members.join(sized, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_key"), "blocks"))

    def spelt(rows: pa.RecordBatch) -> pa.RecordBatch:
        hold("jaccard join", _hashes.clear)
        found = [shingles(text) for text in raw_texts(rows)]
        return record_batch(_FULL_ARROW, [rows.column("doc_id"), [set_key(x) if len(x) else None for x in found], [x.tobytes() for x in found]])

    # The texts of the candidates only, once each; equal ids with other texts fall out by the set's key.
    wanted = members.select(F.col("id").alias("wanted")).distinct()
    texts = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(wanted, F.col("id") == F.col("wanted"), "left_semi")
    full = map_batches(texts.select(F.col("id").alias("doc_id"), "text"), spelt, _FULL).select("set_key", "shingles")
    spread = full.join(dealt, "set_key").dropDuplicates(["set_key"])
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = spread.withColumn("other", other).withColumn("mixed", F.col("block") != F.col("other")).withColumn("pair", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    group = F.when(F.col("n") > F.lit(min(64, block)), F.xxhash64("component", "pair")).otherwise(F.pmod(F.xxhash64("component"), F.lit(_groups(members, 1024))))
    kept = ["component", "pair", "block", "mixed", "set_key", "copies", "shingles"]
    exact = pairs.withColumn("dealt", group).select("dealt", *kept).groupBy("dealt").applyInArrow(_comparer(threshold), _EXACT)
    exact = materialize(exact)

    linked = components(exact).withColumnRenamed("node", "set_key")
    links = exact.groupBy(F.col("b").alias("set_key")).agg(F.sum("links").alias("links"))
    classes = linked.join(sets.select("set_key", "id"), "set_key").groupBy("component").agg(F.min("id").alias("class"))
    classed = linked.join(classes, "component").join(links, "set_key").select("set_key", "class", "links")
    known = sets.join(classed, "set_key", "left").select("set_key", F.coalesce("class", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
    known = apart(known, "set_key")  # a third of all documents may be copies of one
    class_id = F.when(F.col("class") != -(1 << 63), F.col("class")).alias("class_id")
    n_links = (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links")
    joined = filled.join(known, "set_key").select("doc_id", class_id, n_links, F.col("copies").cast("long").alias("n_copies"), "n_shingles")
    none = rows.filter("set_key is null")
    one = [F.lit(x).cast("long").alias(c) for x, c in ((0, "n_links"), (1, "n_copies"), (0, "n_shingles"))]
    return joined.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), *one))


def keep_one(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns unchanged, with one row of each class: the first by its place in the table.

    Rows are told apart by their place, so null and repeated ids do no harm. Places are given once and written with the
    rows, since a later scan may be split otherwise. A text without words stays.
    """
    placed = store(df.withColumn("__place", F.monotonically_increasing_id()), "placed")
    classes = jaccard_classes(placed.select(F.col("__place").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), threshold, recall)
    others = classes.filter("doc_id != class_id").select(F.col("doc_id").alias("__place"))
    return placed.join(others, "__place", "left_anti").drop("__place")


#: DuckDB SQL for jaccard_classes() with its defaults.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
             list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM d),
one AS (SELECT doc_id, unnest(g) AS g, len(g) AS n FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
n AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT s.doc_id, c.class_id, coalesce(n.n, 0) AS n_links, CASE WHEN len(s.g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s.g) END AS n_copies,
       CAST(len(s.g) AS BIGINT) AS n_shingles
FROM s JOIN c ON c.doc_id = s.doc_id LEFT JOIN n ON n.doc_id = s.doc_id
"""
