"""Duplicate groups: exact copies, pairwise similarity, classification and the choice of a source."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.functions.text import document_number, is_variant
from loomq.session import expose_package

#: Similarities from which documents may be versions and from which they are alike.
LOW, HIGH = 0.5, 0.9
#: What a group is called, and the titles that are known to come in two variants.
INDEPENDENT, SYNCED, VERSIONS, UNCLEAR = (
    "wahrscheinlich unabhaengige Dokumente", "wahrscheinlich Sync-Duplikat", "wahrscheinlich Versions-Update", "uneindeutig",
)
KNOWN_PAIRS = ("HARMONICJ", "MNEMOSYNE", "CONTINUUM", "AXIOMCRADLE", "WOUNDS", "ONEPERCENT", "SILENCE")
VARIANT_PREFERRED = ("MNEMOSYNE",)


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """digest, n and first_id of the texts that occur more than once; counting is combined before the shuffle."""
    own = docs.select(F.md5(F.encode(F.col(text), "UTF-8")).alias("digest"), F.col(doc_id).alias("id"))
    found = own.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return found.filter((F.col("n") > 1) & F.col("digest").isNotNull())


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """Pairs i < j of the candidates of a group that could be read: group_id, i, j and both bodies.

    A group is a handful of files that share a document number; its pairs are what the classification is defined on.
    """
    usable = candidates.filter(F.col("error").isNull()).select("group_id", "idx", "body")
    a, b = usable.alias("a"), usable.alias("b")
    joined = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.idx") < F.col("b.idx")))
    return joined.select("a.group_id", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.col("a.body").alias("left"), F.col("b.body").alias("right"))


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="object")


def similarity(left: Column, right: Column) -> Column:
    """The matching-blocks ratio of two texts, in this order; null if one is."""
    return F.pandas_udf(_ratio, "double")(left, right)


def pair_similarities(candidates: DataFrame) -> DataFrame:
    expose_package(candidates.sparkSession)
    return candidate_pairs(candidates).select("group_id", "i", "j", similarity(F.col("left"), F.col("right")).alias("similarity"))


def group_facts(candidates: DataFrame) -> DataFrame:
    """group_id, n, and how many known domains, developers, dates and sizes a group's candidates have."""

    def distinct(name: str) -> Column:
        return F.countDistinct(F.nullif(F.col(name), F.lit("")))

    return candidates.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), distinct("domain").alias("domains"), distinct("developer").alias("developers"), distinct("date").alias("dates"),
        F.countDistinct("paragraph_count").alias("sizes"),
    )


def classify_groups(candidates: DataFrame, similarities: DataFrame) -> DataFrame:
    """One row for each group with n, min_similarity and its class; the first rule that holds decides.

    candidates: group_id, developer, domain, date (null or empty: unknown), paragraph_count.
    """
    facts = group_facts(candidates)
    least = similarities.groupBy("group_id").agg(F.min("similarity").alias("min_similarity"))
    m = F.col("min_similarity")
    known = (F.col("domains") > 0) | (F.col("developers") > 0)
    one = (F.col("domains") == 1) & (F.col("developers") == 1)
    differ = (F.col("sizes") > 1) | (F.col("dates") > 1)
    rule = (
        F.when((F.col("n") < 2) | m.isNull(), UNCLEAR)
        .when(known & ~one & (m < LOW), INDEPENDENT)
        .when((m >= HIGH) & ~differ, SYNCED)
        .when((m >= LOW) & differ, VERSIONS)
        .otherwise(UNCLEAR)
    )
    return facts.join(least, "group_id", "left").select("group_id", "n", "min_similarity", rule.alias("class"))


def discover(files: DataFrame, path: str = "path") -> DataFrame:
    """number and its sorted paths; a file without a leading number is an error."""
    number = document_number(F.col(path))
    checked = F.coalesce(number, F.raise_error(F.concat(F.lit("no leading number: "), F.col(path))).cast("string"))
    return files.select(checked.alias("number"), F.col(path).alias("path")).groupBy("number").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def resolve_source(groups: DataFrame, title: str = "title", paths: str = "paths") -> DataFrame:
    """The groups with source (null where the choice is open) and error.

    One path is the source. Of two paths of a known title, one of them its variant, the preference decides.
    """
    name, all_paths = F.upper(F.trim(title)), F.col(paths)
    variants, others = F.filter(all_paths, is_variant), F.filter(all_paths, lambda p: ~is_variant(p))
    pair = (F.size(all_paths) == 2) & name.isin(*KNOWN_PAIRS) & (F.size(variants) == 1) & (F.size(others) == 1)
    chosen = F.when(F.size(all_paths) == 1, F.get(all_paths, F.lit(0))).when(pair, F.when(name.isin(*VARIANT_PREFERRED), F.get(variants, F.lit(0))).otherwise(F.get(others, F.lit(0))))
    return groups.withColumn("source", chosen).withColumn("error", F.when(chosen.isNull(), F.concat(F.lit("cannot choose among "), F.size(all_paths).cast("string"), F.lit(" candidates"))))
