"""From raw documents to packed training sequences, in five stages that each call one operator.

Every stage reads what its predecessor kept and returns the columns of documents, but for the last, which returns the
packed pieces. Stages don't swallow errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomq.llm.decontamination import drop_contaminated
from loomq.llm.jaccard_join import keep_one
from loomq.llm.language_id import keep_languages
from loomq.llm.packing import pack
from loomq.llm.secrets import redact
from loomq.session import remove_folder, scratch, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; 'und' and hardly decided ones go."""
    return keep_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets in their texts masked and n_chars kept right."""
    return redact(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their identifiers and these' crc32."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]
#: No stage but decontamination can be put as SQL; the tests hold the others against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared checkpoint folder and read again.

    A stage's working tables go when its result is written, and that when the next one's is; what the last stage reads
    goes when the application ends.
    """
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        with scratch(f"{path}-work") as work:
            docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            remove_folder(spark, work)
            if n:
                remove_folder(spark, f"{folder}/{n - 1}-{STAGES[n - 1][0]}")
    return docs
