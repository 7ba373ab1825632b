"""Session helpers: a tuned builder for local use, and what every query needs from a running session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC, as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomq")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


#: Rows in an Arrow batch where the session leaves Spark's default, which is too many for long texts.
BATCH_SETTING, SPARK_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def expose_package(spark: SparkSession) -> None:
    """Prepare a session for Python on its executors; safe to call often.

    The workers can import this package from where the driver has it (on a cluster whose machines do not share that
    path it has to be installed there). Arrow batches get smaller unless the session has its own setting.
    """
    if spark.conf.get(BATCH_SETTING, SPARK_BATCH) == SPARK_BATCH:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; set a folder of our own only in local mode, where none is named.

    That folder goes when the process ends. On a cluster a local folder would be lost with its machine, so there a
    missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomq-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: list[str] = []


@contextmanager
def scratch(folder: str) -> Iterator[str]:
    """Shared folders that are made meanwhile lie below this one, so that they can be removed with it."""
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.pop()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, or the scratch folder, which goes when the application ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{_scratch[-1] if _scratch else spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    path, file_system = _path(spark, folder)
    file_system.mkdirs(path)
    file_system.deleteOnExit(path)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    path, file_system = _path(spark, folder)
    file_system.delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path, file_system = _path(spark, folder)
    return file_system.exists(path)


def _path(spark: SparkSession, folder: str):
    # Spark has no other way to a store that only its readers and writers can open.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def store(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as a table in the shared folder and read from it, column by column as they are needed.

    What a later step computes from them, such as numbers given to rows, is the same however often and on whatever
    executors it is read.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below a folder; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
