"""Remote folders as a table whose filters the server applies, and their changes as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, Not,
)

from loomq.session import expose_package
from loomq.sources.files import PAGE_SIZE, client_of, with_retries

#: The kind of an entry that is a folder.
FOLDER = "folder"
ENTRY = "id string, parent_id string, name string, kind string, trashed boolean, modified date"
CHANGE = "id string, feed string, name string, kind string, trashed boolean, at timestamp"
#: Folders that one task lists.
FOLDERS_A_TASK = 200
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Lister(Protocol):
    """A remote client. where holds what the server filters by: kinds (a list), trashed (a boolean), since (a date)."""

    def page(self, folder: str, where: dict[str, Any], token: str | None, size: int) -> tuple[list[dict], str | None]: ...


@dataclass
class _Given(InputPartition):
    folders: list[str]


@dataclass
class _Stored(InputPartition):
    """Some rows of one row group of a Parquet file."""

    path: str
    group: int
    first: int
    count: int


class RemoteListing(DataSource):
    """Entries of remote folders: read by listing(), whose docstring says what the options are."""

    @classmethod
    def name(cls) -> str:
        return "remote_listing"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


class _ListingReader(DataSourceReader):
    def __init__(self, options):
        self.client, self.path = options["client"], options.get("folders_path")
        self.given = [f for f in options.get("folders", "").split(",") if f]
        self.where: dict[str, Any] = {}
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """What the server or the choice of folders can do is taken; the rest is left to Spark."""
        left = [f for f in filters if not self._takes(f)]
        sure = {("kind",): "kinds" in self.where, ("trashed",): "trashed" in self.where, ("modified",): "since" in self.where, ("parent_id",): self.only is not None}
        return [f for f in left if not (isinstance(f, IsNotNull) and sure.get(f.attribute))]

    def _takes(self, f: Filter) -> bool:
        if isinstance(f, (EqualTo, In)) and f.attribute in (("kind",), ("parent_id",)):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            wanted.discard(None)
            if f.attribute == ("parent_id",):
                self.only = wanted if self.only is None else self.only & wanted
            else:
                self.where["kinds"] = sorted(wanted & set(self.where.get("kinds", wanted)))
            return True
        if isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute == ("trashed",) and isinstance(f.child.value, bool):
            f = EqualTo(("trashed",), not f.child.value)
        if isinstance(f, EqualTo) and f.attribute == ("trashed",) and isinstance(f.value, bool) and self.where.get("trashed", f.value) == f.value:
            self.where["trashed"] = f.value
            return True
        if isinstance(f, GreaterThanOrEqual) and f.attribute == ("modified",) and isinstance(f.value, date):
            self.where["since"] = max(f.value, self.where.get("since", f.value))
            return True
        return False

    def partitions(self) -> Sequence[InputPartition]:
        """Folders by the task; of a table only its footers are read here, its ids by the tasks."""
        given = [f for f in self.given if self.only is None or f in self.only]
        out: list[InputPartition] = [_Given(given[i : i + FOLDERS_A_TASK]) for i in range(0, len(given), FOLDERS_A_TASK)]
        if self.path:
            import pyarrow.dataset as ds

            for fragment in ds.dataset(self.path, format="parquet").get_fragments():
                for group in fragment.row_groups:
                    out += [_Stored(fragment.path, group.id, i, FOLDERS_A_TASK) for i in range(0, group.num_rows, FOLDERS_A_TASK)]
        return out or [_Given([])]

    def _folders(self, partition: InputPartition) -> list[str]:
        if isinstance(partition, _Given):
            return partition.folders
        import pyarrow.parquet as pq

        ids = pq.ParquetFile(partition.path).read_row_group(partition.group, columns=["id"]).column("id").slice(partition.first, partition.count)
        return [f for f in ids.to_pylist() if f is not None and (self.only is None or f in self.only)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if "kinds" in self.where and not self.where["kinds"]:
            return  # filters that exclude one another
        client = client_of(self.client)
        for folder in self._folders(partition):
            token = None
            while True:
                entries, token = with_retries(lambda: client.page(folder, self.where, token, PAGE_SIZE))
                for e in entries:
                    yield e["id"], folder, e["name"], e["kind"], e.get("trashed", False), e.get("modified")
                if not token:
                    break


def listing(spark: SparkSession, client: str, folders: Sequence[str] = (), folders_path: str | None = None) -> DataFrame:
    """id, parent_id, name, kind, trashed and modified of the entries of remote folders.

    client names a module:function on the executors that returns a Lister. Folders are given by name or as a Parquet
    table with their id, which tasks read in parts, so it may have any size. Filters on kind (=, IN), trashed, modified
    (from a day on) and parent_id are applied by the server or by leaving folders out; what they exclude isn't sent.
    Turns on the session's setting for filters of Python sources. A folder that is given twice is listed twice.
    """
    expose_package(spark)
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(RemoteListing)
    options = {"client": client, "folders": ",".join(folders)} | ({"folders_path": folders_path} if folders_path else {})
    return spark.read.format("remote_listing").options(**options).load()


# --- changes ------------------------------------------------------------------------------------------------------


class Feed(Protocol):
    """A remote client's feed of changes. Tokens are opaque; following pages from one leads to any later one."""

    def start(self, feed: str) -> str: ...

    def end(self, feed: str) -> str: ...

    def changes(self, feed: str, token: str, until: str, size: int) -> tuple[list[dict], str]: ...


@dataclass
class _Span(InputPartition):
    feed: str
    token: str
    until: str


class RemoteChanges(DataSource):
    """Changes of remote folders as a stream: read by changes()."""

    @classmethod
    def name(cls) -> str:
        return "remote_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChangesReader(self.options)


class _ChangesReader(DataSourceStreamReader):
    """Offsets are the page tokens of each feed, so a batch that is read again after a failure has the same pages."""

    def __init__(self, options):
        self.client = options["client"]
        self.feeds = [f for f in options["feeds"].split(",") if f]

    def initialOffset(self) -> dict:
        client = client_of(self.client)
        return {f: with_retries(lambda: client.start(f)) for f in self.feeds}

    def latestOffset(self) -> dict:
        client = client_of(self.client)
        return {f: with_retries(lambda: client.end(f)) for f in self.feeds}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        client = client_of(self.client)
        begins = {f: start.get(f) or client.start(f) for f in self.feeds}  # a feed that is new to the query
        return [_Span(f, begins[f], end[f]) for f in self.feeds if f in end and begins[f] != end[f]]

    def read(self, partition: _Span) -> Iterator[tuple]:
        client, token = client_of(self.client), partition.token
        while token != partition.until:
            entries, following = with_retries(lambda: client.changes(partition.feed, token, partition.until, PAGE_SIZE))
            for e in entries:
                yield e["id"], partition.feed, e["name"], e["kind"], e.get("trashed", False), _stamp(e["at"])
            if following == token:
                raise ValueError(f"feed {partition.feed!r} doesn't go on from {token!r} to {partition.until!r}")
            token = following

    def commit(self, end: dict) -> None:
        pass


def _stamp(at: datetime | str) -> datetime:
    return datetime.fromisoformat(at) if isinstance(at, str) else at


def changes(spark: SparkSession, client: str, feeds: Sequence[str]) -> DataFrame:
    """id, feed, name, kind, trashed and at of remote changes, as a stream with one task for each feed.

    client names a module:function that returns a Feed, on the driver, which asks for tokens only, and on the executors.
    """
    expose_package(spark)
    spark.dataSource.register(RemoteChanges)
    return spark.readStream.format("remote_changes").options(client=client, feeds=",".join(feeds)).load()


def first_entries(changed: DataFrame, late: str = "1 day") -> DataFrame:
    """Each entry once, as it first changed; one that comes again within the watermark is left out, and its state goes after."""
    return changed.filter("not trashed").withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


# --- a listing without a server -----------------------------------------------------------------------------------


class CatalogueClient:
    """A Lister over a Parquet table of entries (id, parent_id, name, kind, trashed, modified), such as a saved listing.

    The table's own filters find a folder's entries, so other folders' rows aren't read where it is sorted by folder.
    """

    def __init__(self, path: str):
        self.path, self._folder, self._rows = path.removeprefix("file:"), None, []

    def page(self, folder: str, where: dict[str, Any], token: str | None, size: int) -> tuple[list[dict], str | None]:
        key = (folder, repr(sorted(where.items())))
        if self._folder != key:  # the pages of a folder are asked for one after the other
            import pyarrow.dataset as ds

            wanted = ds.field("parent_id") == folder
            for name, column in (("kinds", "kind"), ("trashed", "trashed"), ("since", "modified")):
                if name in where:
                    own = ds.field(column)
                    wanted &= own.isin(where[name]) if name == "kinds" else own == where[name] if name == "trashed" else own >= where[name]
            self._folder, self._rows = key, ds.dataset(self.path, format="parquet").to_table(filter=wanted).sort_by("id").to_pylist()
        first = int(token or 0)
        return self._rows[first : first + size], str(first + size) if first + size < len(self._rows) else None


def catalogue_client(path: str) -> str:
    """The client's name for a saved listing, as listing() takes it."""
    return f"loomq.sources.listing:CatalogueClient:{path}"
