"""Snapshots of a folder against a manifest of approved files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a difference; the last three need somebody's attention.
APPROVED, UNCHANGED, CHANGED, DUPLICATE, MISSING = "auto_approved", "unchanged", "changed", "new_duplicate", "missing"
ISSUES = (CHANGED, DUPLICATE, MISSING)


def with_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with the SHA-256 of their bytes."""
    return files.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


def needed_hashes(scan: DataFrame, manifest: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A scan (number, filename, mtime) with sha256 where a difference needs it; only those files are read.

    read(files) returns the files with their content. A hash is needed for an approved file whose time differs from the
    manifest's; all others get null.
    """
    keys = ["number", "filename"]
    old = manifest.filter("role <> 'excluded'").select(*keys, F.col("mtime").alias("__before"))
    doubtful = scan.join(old, keys).filter(~F.col("mtime").eqNullSafe(F.col("__before"))).drop("__before")
    hashed = with_hashes(read(doubtful)).select(*keys, "sha256")
    return scan.join(hashed, keys, "left")


def diff(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """number, filename, bucket and reason of every file, driven by the scanned numbers.

    scan: number, filename, mtime, sha256. manifest: the same with role (approved or excluded). A number that only the
    manifest has is left out. Hashes are compared only where the times differ; needed_hashes() reads those files only.
    """
    counts = scan.groupBy("number").agg(F.count(F.lit(1)).alias("n_files"))
    known = manifest.select("number").distinct().withColumn("known", F.lit(True))
    numbers = counts.join(known, "number", "left")
    fresh = scan.join(numbers.filter("known is null"), "number").select(
        "number", "filename", F.when(F.col("n_files") == 1, APPROVED).otherwise(DUPLICATE).alias("bucket"), F.lit(None).cast("string").alias("reason"),
    )
    old = manifest.join(numbers.filter("known").select("number"), "number", "left_semi")
    seen = scan.join(numbers.filter("known").select("number"), "number", "left_semi")
    s = seen.select("number", "filename", F.col("mtime").alias("s_mtime"), F.col("sha256").alias("s_sha"), F.lit(True).alias("scanned"))
    m = old.select("number", "filename", F.col("mtime").alias("m_mtime"), F.col("sha256").alias("m_sha"), "role")
    both = s.join(m, ["number", "filename"], "full_outer")
    same_time = F.col("s_mtime") == F.col("m_mtime")
    bucket = (
        F.when(F.col("role") == "excluded", None)
        .when(F.col("role").isNull(), CHANGED)
        .when(F.col("scanned").isNull(), MISSING)
        .when(same_time, UNCHANGED)
        .when(F.col("s_sha") == F.col("m_sha"), UNCHANGED)
        .otherwise(CHANGED)
    )
    reason = F.when(F.col("role").isNull(), "unexpected").when(bucket == CHANGED, "mtime and sha256 differ")
    judged = both.select("number", "filename", bucket.alias("bucket"), reason.alias("reason")).filter("bucket is not null")
    return fresh.unionByName(judged)


def issues(difference: DataFrame) -> DataFrame:
    return difference.filter(F.col("bucket").isin(*ISSUES))


def suggestions(difference: DataFrame, classes: DataFrame) -> DataFrame:
    """Each number with new duplicates, its files and the suggested class of its group (number, n_files, class).

    classes: group_id and class as dedupe.classify_groups() gives them; a group that wasn't classified has none.
    """
    groups = difference.filter(F.col("bucket") == DUPLICATE).groupBy("number").agg(F.count(F.lit(1)).alias("n_files"))
    return groups.join(classes.select(F.col("group_id").cast("string").alias("number"), "class"), "number", "left")


def approve_new(manifest: DataFrame, scan: DataFrame, difference: DataFrame) -> DataFrame:
    """The manifest with the files that a difference approves of itself."""
    approved = difference.filter(F.col("bucket") == APPROVED).select("number", "filename")
    added = scan.join(approved, ["number", "filename"], "left_semi")
    kept = manifest.join(approved.select("number").distinct(), "number", "left_anti")
    return kept.unionByName(added.select("number", F.lit("approved").alias("status"), "filename", "mtime", "sha256", F.lit("approved").alias("role")), allowMissingColumns=True)


def approve(manifest: DataFrame, scan: DataFrame, number: str, filenames: list[str]) -> DataFrame:
    """The manifest with a number's files set by hand; its other scanned files are excluded."""
    own = scan.filter(F.col("number") == number)
    role = F.when(F.col("filename").isin(*filenames), "approved").otherwise("excluded")
    rows = own.select("number", F.lit("approved").alias("status"), "filename", "mtime", "sha256", role.alias("role"))
    return manifest.filter(F.col("number") != number).unionByName(rows, allowMissingColumns=True)


def select_documents(manifest: DataFrame, only: list[str] | None = None, limit: int | None = None, ordinal: str = "filename") -> DataFrame:
    """Approved files by number as a whole number, then by ordinal; the limit counts files."""
    chosen = manifest.filter((F.col("status") == "approved") & (F.col("role") == "approved"))
    if only is not None:
        chosen = chosen.filter(F.col("number").isin(*only))
    ordered = chosen.orderBy(F.col("number").cast("decimal(38,0)"), ordinal).select("number", "filename")
    return ordered if limit is None else ordered.limit(limit)
