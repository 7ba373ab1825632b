import datetime
import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from loomq.sources import listing
from loomq.sources.files import RemoteError

CLIENT = '''
import datetime, json, os
from loomq.sources.files import RemoteError

PLACE = {place!r}

class Client:
    """Folders of 30 entries in pages of 7; every entry that goes out is written down."""

    def page(self, folder, where, token, size):
        if folder == "gone":
            raise RemoteError(404, "no folder")
        kinds = ["folder", "pdf", "docx"]
        rows = [dict(id=f"{{folder}}-{{i}}", name=f"n{{i}}", kind=kinds[i % 3], trashed=i % 5 == 0, modified=datetime.date(2026, 1, 1 + i)) for i in range(30)]
        if "kinds" in where:
            rows = [r for r in rows if r["kind"] in where["kinds"]]
        if "trashed" in where:
            rows = [r for r in rows if r["trashed"] == where["trashed"]]
        if "since" in where:
            rows = [r for r in rows if r["modified"] >= where["since"]]
        at = int(token or 0)
        with open(os.path.join(PLACE, f"sent-{{os.getpid()}}"), "a") as out:
            out.writelines(r["id"] + "\\n" for r in rows[at : at + 7])
        return rows[at : at + 7], str(at + 7) if at + 7 < len(rows) else None

    def _feed(self, feed):
        with open(os.path.join(PLACE, f"feed-{{feed}}.json")) as f:
            return json.load(f)

    def start(self, feed):
        return "0"

    def end(self, feed):
        return str(len(self._feed(feed)))

    def changes(self, feed, token, until, size):
        at = int(token)
        last = min(at + 3, int(until))
        return self._feed(feed)[at:last], str(last)

def client():
    return Client()
'''


@pytest.fixture()
def remote(spark, tmp_path):
    """A client module of its own for each test, and what it sent."""
    name = f"remote_{tmp_path.name.replace('-', '_')}"
    (tmp_path / f"{name}.py").write_text(CLIENT.format(place=str(tmp_path)))
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    sys.path.insert(0, str(tmp_path))
    environment = spark.sparkContext.environment  # a stream's reader on the driver has a process of its own
    environment["PYTHONPATH"] = os.pathsep.join([str(tmp_path), environment.get("PYTHONPATH", "")])

    def sent():
        lines = [line for f in tmp_path.glob("sent-*") for line in f.read_text().split()]
        for f in tmp_path.glob("sent-*"):
            f.unlink()
        return lines

    yield f"{name}:client", sent
    sys.path.remove(str(tmp_path))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_server_filters(spark, remote):
    """What filters exclude isn't sent, the plan says so, and the rows are those that Spark would have kept."""
    client, sent = remote
    whole = listing.listing(spark, client, ["a", "b"])
    rows = [r.asDict() for r in whole.collect()]
    assert len(rows) == 60 and len(sent()) == 60
    day = datetime.date(2026, 1, 10)
    cases = [
        (F.col("kind") == "pdf", lambda r: r["kind"] == "pdf"), (F.col("kind").isin("folder", "docx"), lambda r: r["kind"] != "pdf"),
        (~F.col("trashed"), lambda r: not r["trashed"]), (F.col("trashed"), lambda r: r["trashed"]), (F.col("parent_id") == "b", lambda r: r["parent_id"] == "b"),
        (F.col("modified") >= F.lit(day), lambda r: r["modified"] >= day), ((F.col("kind") == "pdf") & (F.col("kind") == "docx"), lambda r: False),
        (F.col("kind").isin("folder", "pdf") & ~F.col("trashed") & (F.col("modified") >= F.lit(day)), lambda r: r["kind"] != "docx" and not r["trashed"] and r["modified"] >= day),
    ]
    for condition, same in cases:
        expected = sorted(r["id"] for r in rows if same(r))
        assert ids(whole.filter(condition)) == expected
        assert sorted(sent()) == expected
    pushed, left = plan(whole.filter("kind = 'pdf' and not trashed")), plan(whole.filter("kind = 'pdf' or trashed"))
    assert " Filter " not in pushed and " Filter " in left  # no filter is left to Spark, against one that is


def test_filters_that_stay(spark, remote):
    """A filter that the server doesn't know is Spark's, beside one that it does."""
    client, sent = remote
    found = listing.listing(spark, client, ["a"]).filter("kind = 'pdf' and name like 'n1%'")
    assert ids(found) == sorted(f"a-{i}" for i in range(30) if i % 3 == 1 and str(i)[0] == "1") and len(sent()) == 10
    either = listing.listing(spark, client, ["a"]).filter("kind = 'pdf' or trashed")
    assert len(ids(either)) == 10 + 6 - 2 and len(sent()) == 30


def test_folders_from_a_table(spark, remote, tmp_path):
    client, sent = remote
    folders = spark.createDataFrame([(f"f{i}",) for i in range(450)] + [(None,)], "id string")
    folders.repartition(2).write.parquet(str(tmp_path / "folders"))
    found = listing.listing(spark, client, folders_path=str(tmp_path / "folders")).filter("kind = 'pdf'")
    assert found.rdd.getNumPartitions() >= 4 and found.count() == 4500 and len(sent()) == 4500
    assert found.filter("parent_id in ('f7', 'f400', 'x')").count() == 20 and len(sent()) == 20
    assert listing.listing(spark, client).count() == 0


def test_missing_folder(spark, remote):
    with pytest.raises(Exception, match="404 no folder"):
        listing.listing(spark, remote[0], ["gone"]).collect()
    assert RemoteError(404).status == 404


def change(n, day, trashed=False):
    return {"id": f"e{n}", "name": f"n{n}", "kind": "pdf", "trashed": trashed, "at": f"2026-01-{day:02d}T10:00:00"}


def test_changes_once(spark, remote, tmp_path):
    """Started again from its checkpoint the stream goes on behind the last token; every entry is there once."""
    client, _ = remote

    def feed(name, entries):
        (tmp_path / f"feed-{name}.json").write_text(json.dumps(entries))

    def run():
        stream = listing.first_entries(listing.changes(spark, client, ["a", "b"]))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    a, b = [change(n % 6, 1) for n in range(10)], [change(20, 1), change(21, 1, trashed=True)]
    feed("a", a)
    feed("b", b)
    first = ["e0", "e1", "e2", "e20", "e3", "e4", "e5"]
    assert run() == first
    assert run() == first
    feed("a", a + [change(2, 1), change(7, 2), change(7, 2)])
    feed("b", b + [change(20, 2), change(21, 2)])
    assert run() == sorted([*first, "e7", "e21"])


def test_a_feed_that_stalls():
    class Stalled:
        def changes(self, feed, token, until, size):
            return [], token

    reader = listing._ChangesReader({"client": "x:y", "feeds": "a"})
    original, listing.client_of = listing.client_of, lambda name: Stalled()
    try:
        with pytest.raises(ValueError, match="doesn't go on"):
            list(reader.read(listing._Span("a", "1", "2")))
    finally:
        listing.client_of = original


def test_saved_listing(spark, tmp_path):
    """A saved listing serves pages of a folder, filtered, in the order of ids."""
    rows = [(f"{p}{i}", p, f"n{i}", "pdf" if i % 2 else "folder", i % 3 == 0, datetime.date(2026, 1, 1 + i)) for p in "ab" for i in range(9)]
    spark.createDataFrame(rows, listing.ENTRY).write.parquet(str(tmp_path / "saved"))
    client = listing.CatalogueClient(str(tmp_path / "saved"))
    where, found, token = {"kinds": ["pdf"], "trashed": False, "since": datetime.date(2026, 1, 2)}, [], None
    while True:
        entries, token = client.page("a", where, token, 2)
        found.append([e["id"] for e in entries])
        if token is None:
            break
    assert found == [["a1", "a5"], ["a7"]]
    assert len(client.page("b", {}, None, 100)[0]) == 9 and client.page("c", {}, None, 5) == ([], None)
    found = listing.listing(spark, listing.catalogue_client(str(tmp_path / "saved")), ["b"]).filter("kind = 'pdf'")
    assert ids(found) == ["b1", "b3", "b5", "b7"]
