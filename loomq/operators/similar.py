"""What a group's least pairwise similarity decides, with few alignments.

A classification asks only whether the least similarity of a group's pairs is below one or two thresholds, and a group's
other facts say which. Equal texts count as one. The common characters of two texts, read from histograms, bound their
similarity from above; a group with a pair whose bound is below the threshold is decided without an alignment. Of the
others the pair with the least bound is aligned, and only groups that this leaves open are aligned pair by pair, in
blocks that spread one group over many tasks and stop at the first pair below the threshold.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.operators.dedupe import HIGH, LOW, group_facts
from loomq.session import expose_package, store

#: Texts in a block; a task compares two blocks.
BLOCK = 256
#: Characters are counted in so many classes.
CLASSES = 128


def histograms(text: Column) -> Column:
    """How often each class of characters occurs, by code point; more common ones than a pair shares it can't have."""

    def count(column: pa.Array) -> pa.Array:
        rows = []
        for t in column.to_pylist():
            codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4")
            rows.append(np.bincount(codes % CLASSES, minlength=CLASSES))
        flat = np.concatenate(rows) if rows else np.zeros(0)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, CLASSES, dtype=np.int32), pa.array(flat.astype(np.int32)))

    return F.arrow_udf(count, "array<int>")(text)


def bounds(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The bound of every pair of rows of two histogram matrices; two empty texts are alike."""
    common = np.zeros((len(left), len(right)), np.int64)
    for c in np.flatnonzero(left.any(0) & right.any(0)):
        common += np.minimum(left[:, c, None], right[None, :, c])
    total = left.sum(1)[:, None] + right.sum(1)[None, :]
    return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)


def ratio(a: dict, b: dict) -> tuple[float, int]:
    """The least similarity of two distinct texts over the orders in which their candidates come, and the alignments."""
    found = []
    for one, other in ((a, b), (b, a)):
        if one["first"] < other["last"]:
            found.append(SequenceMatcher(None, one["body"], other["body"]).ratio())
    return min(found), len(found)


def thresholds(candidates: DataFrame) -> DataFrame:
    """group_id and need: the least similarity that the group's class can depend on; null where it depends on none."""
    facts = group_facts(candidates)
    apart = ((F.col("domains") > 0) | (F.col("developers") > 0)) & ~((F.col("domains") == 1) & (F.col("developers") == 1))
    differ = (F.col("sizes") > 1) | (F.col("dates") > 1)
    return facts.select("group_id", F.when(F.col("n") >= 2, F.when(differ | apart, LOW).otherwise(HIGH)).alias("need"))


_BOUND = "group_id {kind}, bound double, left long, right long, pairs long"
_RATIO = "group_id {kind}, similarity double, aligned long"


def _pairs_of_blocks(texts: DataFrame) -> DataFrame:
    """Every text once for each block of its group, under the two blocks' numbers; blocks meet in one group each."""
    met = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def _sides(rows: list[dict], low: int, high: int) -> tuple[list[dict], list[dict]]:
    rows = sorted(rows, key=lambda r: r["tid"])
    return ([r for r in rows if r["block"] == low], [r for r in rows if r["block"] == high]) if low != high else (rows, rows)


def _least_bound(key: tuple, table: pa.Table) -> pa.Table:
    group, low, high = (k.as_py() for k in key)
    a, b = _sides(table.to_pylist(), low, high)
    out = {"group_id": [group], "bound": [None], "left": [None], "right": [None], "pairs": [0]}
    if a and b:
        found = bounds(np.array([r["histogram"] for r in a]), np.array([r["histogram"] for r in b]))
        if low == high:
            found[np.tril_indices(len(a))] = np.inf
        out["pairs"] = [len(a) * (len(a) - 1) // 2 if low == high else len(a) * len(b)]
        if out["pairs"][0]:
            at = np.unravel_index(found.argmin(), found.shape)
            out |= {"bound": [float(found[at])], "left": [a[at[0]]["tid"]], "right": [b[at[1]]["tid"]]}
    return pa.table({k: pa.array(v, table.schema.field("group_id").type if k == "group_id" else pa.float64() if k == "bound" else pa.int64()) for k, v in out.items()})


def _least_ratio(key: tuple, table: pa.Table) -> pa.Table:
    group, low, high = (k.as_py() for k in key)
    a, b = _sides(table.to_pylist(), low, high)
    least, aligned = None, 0
    for i, one in enumerate(a):
        for other in b[i + 1 :] if low == high else b:
            value, n = ratio(one, other)
            least, aligned = value if least is None else min(least, value), aligned + n
            if least < one["need"]:
                break
        if least is not None and least < one["need"]:
            break
    kinds = {"group_id": table.schema.field("group_id").type, "similarity": pa.float64(), "aligned": pa.int64()}
    return pa.table({k: pa.array([v], kinds[k]) for k, v in {"group_id": group, "similarity": least, "aligned": aligned}.items()})


def _texts(candidates: DataFrame) -> DataFrame:
    """The distinct texts of each group, stored with a number, their first and last place, copies and histogram."""
    usable = candidates.filter(F.col("error").isNull()).select("group_id", F.col("idx").cast("long").alias("idx"), F.coalesce("body", F.lit("")).alias("body"))
    keyed = usable.withColumn("digest", F.sha2("body", 256))
    distinct = keyed.groupBy("group_id", "digest").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("copies"), F.min("body").alias("body"))
    return store(distinct.withColumn("tid", F.monotonically_increasing_id()).withColumn("histogram", histograms(F.col("body"))), "texts")


def _groups(texts: DataFrame) -> DataFrame:
    sizes = texts.groupBy("group_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("copies")).filter("copies > 1")
    return sizes.withColumn("blocks", F.ceil(F.col("texts") / BLOCK).cast("int"))


def _placed(texts: DataFrame, groups: DataFrame) -> DataFrame:
    return texts.drop("copies").join(groups, "group_id").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))


def _least(placed: DataFrame, kind: str) -> DataFrame:
    """group_id, the pair with the least bound, and the pairs of distinct texts."""
    narrow = _pairs_of_blocks(placed.select("group_id", "tid", "block", "blocks", "histogram"))
    found = narrow.groupBy("group_id", "low", "high").applyInArrow(_least_bound, _BOUND.format(kind=kind))
    return found.groupBy("group_id").agg(F.min_by(F.struct("bound", "left", "right"), "bound").alias("pair"), F.sum("pairs").alias("pairs"))


def least_bounds(candidates: DataFrame) -> DataFrame:
    """group_id, bound and pairs of every group of distinct texts: above what no pair's similarity lies, the least of all pairs'."""
    expose_package(candidates.sparkSession)
    texts = _texts(candidates)
    placed = _placed(texts, _groups(texts).filter("texts > 1").select("group_id", "blocks"))
    return _least(placed, candidates.schema["group_id"].dataType.simpleString()).select("group_id", "pair.bound", "pairs")


def bounded_similarities(candidates: DataFrame) -> DataFrame:
    """group_id, similarity, decided_by, pairs, aligned for every group with a pair of readable candidates.

    candidates: group_id, idx, body (null is empty), error, and what classify_groups() reads. similarity leads to the
    class that the least similarity of all pairs leads to: it is that, or a bound or an alignment of one pair that lies
    below the least threshold that matters. decided_by: copies (all texts are equal), facts (no threshold matters),
    bound, witness, all. pairs counts pairs of distinct texts, aligned the alignments that were made, in either order.
    """
    spark = candidates.sparkSession
    expose_package(spark)
    kind = candidates.schema["group_id"].dataType.simpleString()
    texts = _texts(candidates)
    groups = store(_groups(texts).join(thresholds(candidates), "group_id"), "groups")
    placed = _placed(texts, groups.filter("texts > 1 and need is not null").select("group_id", "blocks", "need"))
    least = store(_least(placed, kind).join(groups, "group_id"), "bounds")

    body = texts.select("group_id", "tid", F.struct("first", "last", "body").alias("text"))
    open_ = least.filter("pair.bound >= need")
    left = open_.join(body.withColumnRenamed("text", "a"), (body["group_id"] == open_["group_id"]) & (body["tid"] == F.col("pair.left"))).select(open_["group_id"], "need", "pair", "a")
    both = left.join(body.withColumnRenamed("text", "b"), (body["group_id"] == left["group_id"]) & (body["tid"] == F.col("pair.right"))).select(left["group_id"], "need", "a", "b")

    def align(batches):
        for batch in batches:
            done = [ratio(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("group_id"), pa.array([d[0] for d in done], pa.float64()), pa.array([d[1] for d in done], pa.int64())], names=["group_id", "witness", "tried"])

    spread = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group_id")  # alignments take long, whatever the bytes
    witness = store(spread.mapInArrow(align, f"group_id {kind}, witness double, tried long"), "witnesses")
    left_open = open_.join(witness, "group_id").filter((F.col("witness") >= F.col("need")) & (F.col("texts") > 2)).select("group_id")
    rest = _pairs_of_blocks(placed.join(left_open, "group_id", "left_semi").select("group_id", "tid", "block", "blocks", "need", "first", "last", "body"))
    whole = rest.groupBy("group_id", "low", "high").applyInArrow(_least_ratio, _RATIO.format(kind=kind)).groupBy("group_id").agg(F.min("similarity").alias("least"), F.sum("aligned").alias("aligned"))

    joined = groups.join(least.select("group_id", "pair", "pairs"), "group_id", "left").join(witness, "group_id", "left").join(whole, "group_id", "left")
    zero = F.lit(0).cast("long")
    cases = [
        (F.col("texts") == 1, "copies", F.lit(1.0)), (F.col("need").isNull(), "facts", F.lit(None).cast("double")), (F.col("pair.bound") < F.col("need"), "bound", F.col("pair.bound")),
        (F.col("least").isNull(), "witness", F.col("witness")), (F.lit(True), "all", F.col("least")),
    ]
    how, value = F, F
    for condition, name, similarity in cases:
        how, value = how.when(condition, name), value.when(condition, similarity)
    return joined.select(
        "group_id", value.alias("similarity"), how.alias("decided_by"), F.coalesce("pairs", zero).alias("pairs"), (F.coalesce("tried", zero) + F.coalesce("aligned", zero)).alias("aligned"),
    )
