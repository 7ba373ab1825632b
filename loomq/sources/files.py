"""Files and trees as tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomq.functions.text import stem
from loomq.session import expose_package, materialize

#: Extensions by what is looked for.
PDF, WORD, SLIDES = (".pdf",), (".docx",), (".pptx",)
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")


def files(spark: SparkSession, folder: str, extensions: Sequence[str], recursive: bool = False, with_content: bool = False) -> DataFrame:
    """path, name, mtime, size (and content) of the files with one of some extensions, in any case.

    Only the columns asked for are read: without content no file is opened. Spark's listing leaves out names that begin
    with a dot or an underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folder)
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions)
    columns = [F.col("path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]
    return found.filter(wanted).select(*columns, *([F.col("content")] if with_content else []))


def stems(found: DataFrame) -> DataFrame:
    return found.withColumn("stem", stem(F.col("path")))


def tree_files(entries: DataFrame, root: str, recursive: bool = True) -> DataFrame:
    """The files below a folder of a tree (id, parent_id, name, is_folder, modified), with their depth.

    Only the folders are walked, each level one join of the last level's folders with theirs, written once; the files
    are joined to the folders found at the end, whatever the depth. A folder that is met again isn't walked again, so a
    ring of folders ends.
    """
    kids = entries.select("id", "parent_id", "name", "is_folder", "modified")
    spark = entries.sparkSession
    first = spark.createDataFrame([(root, 0)], "id string, depth int").withColumn("id", F.col("id").cast(entries.schema["id"].dataType))
    seen = level = first
    if recursive:
        folders = kids.filter("is_folder").select("id", "parent_id")
        while True:
            found = folders.join(level.select(F.col("id").alias("parent_id"), "depth"), "parent_id").select("id", (F.col("depth") + 1).alias("depth")).distinct()
            level = materialize(found.join(seen.select("id"), "id", "left_anti"))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
    above = seen.select(F.col("id").alias("parent_id"), (F.col("depth") + 1).alias("depth"))
    return kids.filter(~F.col("is_folder")).join(above, "parent_id").select("id", "parent_id", "name", "modified", "depth")


def remote_date(value: Column) -> Column:
    """The day of a remote timestamp such as 2026-08-15T10:23:00.000Z, as written there; null for what isn't one."""
    shape = r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    stamp = F.regexp_extract(value, shape, 1)
    clock = F.regexp_extract(value, r"[T ](\d{2}:\d{2}(?::\d{2})?)", 1)
    valid = (clock == "") | F.concat(F.lit("2000-01-01 "), clock).try_cast("timestamp").isNotNull()
    return F.when(valid, F.nullif(stamp, F.lit("")).try_cast("date"))


# --- a remote drive that lists pages ------------------------------------------------------------------------------

#: Attempts and the first wait in seconds, which doubles; answers that are tried again.
ATTEMPTS, FIRST_WAIT = 5, 1.0
RETRIED = (403, 429, 500, 502, 503, 504)
#: Entries that one listing returns.
PAGE_SIZE = 1000


class RemoteError(Exception):
    def __init__(self, status: int, text: str = ""):
        super().__init__(f"{status} {text}".strip())
        self.status = status


def with_retries(call: Callable[[], Any], attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Any:
    """A call's result; refusals and server errors are tried again after doubling waits."""
    for n in range(attempts):
        try:
            return call()
        except RemoteError as error:
            if error.status not in RETRIED or n == attempts - 1:
                raise
            sleep(first_wait * 2**n)


def checked_folder(get: Callable[[str], dict], folder: str) -> dict:
    """A remote folder's id and name before a long scan; one in the bin, or a file, is an error that names it."""
    found = with_retries(lambda: get(folder))
    if found.get("trashed"):
        raise ValueError(f"{found.get('name', folder)!r} is in the bin")
    if not found.get("is_folder"):
        raise ValueError(f"{found.get('name', folder)!r} is not a folder")
    return {"id": found["id"], "name": found["name"]}


def client_of(name: str) -> Any:
    """What the function named module:function returns, given what follows a further colon, if anything does."""
    import importlib

    module, function, *given = name.split(":", 2)
    return getattr(importlib.import_module(module), function)(*given)


def downloaded(entries: DataFrame, client: str, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT) -> DataFrame:
    """The entries (id, …) with content and error, fetched by executors in whole; refusals are tried again.

    client names a module:function that returns fetch(id) -> bytes. One file is held at a time; a file that can't be
    fetched has a null content and its error, and doesn't stop the others.
    """
    expose_package(entries.sparkSession)
    columns = entries.columns
    schema = entries.limit(0).select("*", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = client_of(client)
        for batch in batches:
            for n, key in enumerate(batch.column("id").to_pylist()):
                try:
                    content, error = with_retries(lambda: fetch(key), attempts, first_wait), None
                except Exception as problem:  # one file must not stop the others
                    content, error = None, f"{type(problem).__name__}: {problem}"
                own = [batch.column(c).slice(n, 1) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*columns, "content", "error"])

    return entries.mapInArrow(run, schema)


class PagedListing(DataSource):
    """A remote folder's entries as a table: spark.read.format("paged_listing").

    The option client names a module:function that returns list_page(folder, kinds, token, size) -> (entries, next
    token); folders has the folders' ids, one partition each.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "id string, parent_id string, name string, is_folder boolean, modified date"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _Folder(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.client = options["client"]
        self.folders = [f for f in options["folders"].split(",") if f]
        self.kinds = [k for k in options.get("kinds", "").split(",") if k]

    def partitions(self) -> Sequence[InputPartition]:
        return [_Folder(f) for f in self.folders]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        list_page = client_of(self.client)
        token = None
        while True:
            entries, token = with_retries(lambda: list_page(partition.folder, self.kinds, token, PAGE_SIZE))
            for e in entries:
                yield e["id"], partition.folder, e["name"], e["is_folder"], e.get("modified")
            if not token:
                return


def cached(found: DataFrame, folder: str, order: str = "id") -> DataFrame:
    """Remote files that match (id, name, snippet) with local_path: each a name of its own in a folder for copies."""
    from loomq.operators.merge import free_names

    named = free_names(found, "name", order)
    return named.select("id", "name", "snippet", F.concat(F.lit(folder.rstrip("/") + "/"), "destination").alias("local_path"))
