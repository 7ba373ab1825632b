import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomq.operators.search import search
from loomq.sources import files, office, sinks
from loomq.streaming import folders


def test_files(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "c.docx", "sub/d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["name"] for r in files.files(spark, str(tmp_path), files.PDF).orderBy("path").collect()] == ["a.pdf", "b.PDF"]
    deep = files.files(spark, str(tmp_path), files.PDF, recursive=True, with_content=True)
    assert sorted(r["name"] for r in deep.collect()) == ["a.pdf", "b.PDF", "d.pdf"] and "content" in deep.columns


def test_tree(spark):
    rows = [("1", "root", "f", True), ("2", "1", "g", True), ("3", "2", "x", False), ("4", "root", "y", False), ("5", "9", "z", False)]
    tree = spark.createDataFrame([(*r, datetime.date(2026, 1, 1)) for r in rows], "id string, parent_id string, name string, is_folder boolean, modified date")
    assert {r["name"]: r["depth"] for r in files.tree_files(tree, "root").collect()} == {"y": 1, "x": 3}
    assert [r["name"] for r in files.tree_files(tree, "root", recursive=False).collect()] == ["y"]


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise files.RemoteError(503)
        return "ok"

    assert files.with_retries(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(files.RemoteError):
        files.with_retries(lambda: (_ for _ in ()).throw(files.RemoteError(404)), sleep=waits.append)
    assert len(waits) == 3


def fake_client():
    pages = {None: ([{"id": "1", "name": "a", "is_folder": False}], "t"), "t": ([{"id": "2", "name": "b", "is_folder": True}], None)}
    return lambda folder, kinds, token, size: pages[token]


def test_paged_listing(spark, tmp_path, monkeypatch):
    (tmp_path / "fake_drive.py").write_text(
        "def client():\n    pages = {None: ([{'id': '1', 'name': 'a', 'is_folder': False}], 't'), 't': ([{'id': '2', 'name': 'b', 'is_folder': True}], None)}\n"
        "    return lambda folder, kinds, token, size: pages[token]\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "fake_drive.py"))
    spark.dataSource.register(files.PagedListing)
    got = spark.read.format("paged_listing").options(client="fake_drive:client", folders="x,y").load()
    assert sorted((r["parent_id"], r["id"]) for r in got.collect()) == [("x", "1"), ("x", "2"), ("y", "1"), ("y", "2")]


def test_word(spark):
    content = office.word_bytes({"header": ["QSI ICO: TESTMARK"], "body": ["Issuer XYZ", "---", "a translatable paragraph"], "footer": ["page"]})
    plain = office.word_bytes({"body": ["no separator"]})
    df = spark.createDataFrame([("a.docx", bytearray(content)), ("b.docx", bytearray(plain)), ("c.docx", bytearray(b"junk"))], "path string, content binary")
    rows = office.read_word(df, mask_metadata=True)
    got = {(r["path"], r["part"], r["para_index"]): r["translatable"] for r in rows.filter("error is null").collect()}
    assert got[("a.docx", "body", 0)] is False and got[("a.docx", "body", 2)] is True and got[("a.docx", "header", 0)] is False
    assert rows.filter("error is not null").count() == 1
    scopes = {r["path"]: r for r in office.word_scopes(rows).collect()}
    assert scopes["a.docx"]["ico_format"] == "QSI ICO: TESTMARK\nIssuer XYZ" and scopes["a.docx"]["footer"] == "page"
    assert scopes["a.docx"]["full_text"] == "QSI ICO: TESTMARK\nIssuer XYZ\na translatable paragraph" and scopes["b.docx"]["ico_format"] is None
    assert [r["path"] for r in search(office.word_scopes(rows), "testmark AND issuer").collect()] == ["a.docx"]
    again = office.replaced_word(content, {("body", 2): "neu"})
    texts = office.read_word(spark.createDataFrame([("a", bytearray(again))], "path string, content binary")).filter("part = 'body'").orderBy("para_index")
    assert [office_text for office_text in [r["t"] for r in texts.select(office.paragraph_text(F.col("runs")).alias("t")).collect()]] == ["Issuer XYZ", "", "neu"]


def _slides(texts):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'

    def box(i, t, ph=""):
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="n{i}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:ext cx="1270000" cy="254000"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:rPr sz="1200"/><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in texts.items():
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld {ns}><p:cSld><p:spTree>{box(1, t)}<p:grpSp>{box(2, 'grouped')}</p:grpSp>{box(3, 'foot', '<p:ph type=&quot;ftr&quot;/>'.replace('&quot;', chr(34)))}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


def test_slides(spark):
    df = spark.createDataFrame([("a", bytearray(_slides({10: "ten", 2: "two"})))], "path string, content binary")
    found = office.read_slides(df)
    got = [(r["slide_number"], r["paragraphs"], r["font_points"], r["width"]) for r in found.filter("translatable").collect()]
    assert got == [(2, ["two"], 12.0, 1270000), (2, ["grouped"], 12.0, 1270000), (10, ["ten"], 12.0, 1270000), (10, ["grouped"], 12.0, 1270000)]
    kept = [(r["paragraphs"], r["exclusion_reason"]) for r in found.filter("not translatable").collect()]
    assert kept == [(["foot"], "protected_placeholder:ftr")] * 2
    other = spark.createDataFrame([("a", bytearray(_slides({10: "zehn", 2: "zwei"})))], "path string, content binary")
    assert sorted(r["sha256"] for r in office.structure_digest(df).collect()) == sorted(r["sha256"] for r in office.structure_digest(other).collect())


def test_shapes_as_a_current_program_writes_them(spark):
    """The name's element has an extension list, whose a:ext has no size; tables and groups have boxes of their own."""
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    lists = '<a:extLst><a:ext uri="{FF2B}"><x xmlns="urn:x" id="1"/></a:ext></a:extLst>'
    sp = f'<p:sp><p:nvSpPr><p:cNvPr id="4" name="Title">{lists}</p:cNvPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm rot="600"><a:off x="7" y="8"/><a:ext cx="1000" cy="2000"/></a:xfrm></p:spPr><p:txBody><a:bodyPr wrap="square"><a:normAutofit/></a:bodyPr><a:p><a:r><a:t>a</a:t></a:r><a:r><a:t>b</a:t></a:r></a:p></p:txBody></p:sp>'
    cell = "<a:tc><a:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></a:txBody></a:tc>"
    frame = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9" name="T">{lists}</p:cNvPr></p:nvGraphicFramePr><p:xfrm><a:off x="1" y="2"/><a:ext cx="30" cy="40"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr h="5">{cell.format("c0")}{cell.format("c1")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="2" name="G"/></p:nvGrpSpPr>{frame}</p:grpSp>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {ns}><p:cSld><p:spTree>{sp}{group}</p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/other.bin", b"x")
    df = spark.createDataFrame([("a", bytearray(out.getvalue()))], "path string, content binary")
    rows = office.read_slides(df).collect()
    title = rows[0]
    assert (title["x"], title["y"], title["width"], title["height"], title["rotation"]) == (7, 8, 1000, 2000, 600)
    assert title["placeholder_type"] == "title" and title["translatable"] and title["autofit"] == "normAutofit" and title["body"] == {"wrap": "square"}
    assert [(r["paragraphs"], r["table_col"], r["width"], r["group_path"]) for r in rows[1:]] == [(["c0"], 0, 30, ["2:G"]), (["c1"], 1, 30, ["2:G"])]
    new = spark.createDataFrame([("a", "ppt/slides/slide1.xml", 0, 1, "B"), ("a", "ppt/slides/slide1.xml", 2, 0, "C & 1")], "path string, slide_path string, paragraph int, run int, text string")
    saved = office.saved_slides(df, new).first()
    again = office.read_slides(spark.createDataFrame([("a", saved["content"])], "path string, content binary")).collect()
    assert [r["paragraphs"] for r in again] == [["aB"], ["c0"], ["C & 1"]] and saved["error"] is None
    assert office.saved_slides(df, new.filter("false")).first()["content"] == out.getvalue()
    wrong = new.limit(1).withColumn("run", F.lit(5))
    assert "no run 5" in office.saved_slides(df, wrong).first()["error"]
    digests = [{r["part"]: r["sha256"] for r in office.structure_digest(d).collect()} for d in (df, spark.createDataFrame([("a", saved["content"])], "path string, content binary"))]
    assert digests[0] == digests[1]


def test_remote(spark, tmp_path, value):
    for given, expected in (("2026-08-15T10:23:00.000Z", "2026-08-15"), ("2026-08-15T23:59:00+02:00", "2026-08-15"), ("2026-08-15", "2026-08-15"), ("2026-13-15T10:23:00Z", None), ("2026-08-15T25:23:00Z", None), ("soon", None), ("", None), (None, None)):
        got = value(files.remote_date, (given, "string"))
        assert (None if got is None else str(got)) == expected
    known = {"f": {"id": "f", "name": "F", "is_folder": True}, "t": {"id": "t", "name": "T", "is_folder": True, "trashed": True}, "x": {"id": "x", "name": "X", "is_folder": False}}
    assert files.checked_folder(known.__getitem__, "f") == {"id": "f", "name": "F"}
    for bad, words in (("t", "in the bin"), ("x", "not a folder")):
        with pytest.raises(ValueError, match=words):
            files.checked_folder(known.__getitem__, bad)
    (tmp_path / "fake_fetch.py").write_text("def client():\n    def fetch(key):\n        if key == 'b':\n            raise OSError('gone')\n        return key.encode() * 3\n    return fetch\n")
    spark.sparkContext.addPyFile(str(tmp_path / "fake_fetch.py"))
    got = {r["id"]: (r["name"], r["content"], r["error"]) for r in files.downloaded(spark.createDataFrame([("a", "n"), ("b", "m")], "id string, name string"), "fake_fetch:client", first_wait=0.0).collect()}
    assert got == {"a": ("n", bytearray(b"aaa"), None), "b": ("m", None, "OSError: gone")}


def test_deep_tree(spark):
    rows = [(str(i), str(i - 1) if i else "root", f"f{i}", True) for i in range(12)] + [("leaf", "11", "deep", False), ("0", "11", "ring", True)]
    tree = spark.createDataFrame([(*r, None) for r in rows], "id string, parent_id string, name string, is_folder boolean, modified date")
    assert [(r["name"], r["depth"]) for r in files.tree_files(tree, "root").collect()] == [("deep", 13)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "x"), ("b.txt", "y")], "name string, content string")
    sinks.write_files(df, str(tmp_path / "out"))
    assert (tmp_path / "out/b.txt").read_text() == "y"
    sinks.write_files(df, str(tmp_path / "out"))  # the same bytes again, as a task that is run again writes them
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_files(df.withColumn("content", F.lit("z")), str(tmp_path / "out"))
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert [r["line"] for r in sinks.markdown_table(spark.createDataFrame([("a|b", 1)], "x string, y int"), ["x", "y"]).collect()] == ["| a\\|b | 1 |"]
    outcomes = spark.createDataFrame([("translated", 5, None), ("failed", 0, "e")], "status string, chars_sent int, error string")
    assert sinks.run_report(outcomes).first().asDict() == {"total": 2, "translated": 1, "skipped": 0, "failed": 1, "characters": 5, "errors": ["e"]}


def test_reports(spark):
    stats = spark.createDataFrame([(1, 3, 1, 1, 90, 2, ["page0:block1: E: x"]), (2, 1, 0, 0, 5, 0, [])], "doc_id int, translated int, skipped int, failed int, chars_sent int, overflow_blocks int, errors array<string>")
    got = {r["doc_id"]: r["report"] for r in sinks.qa_report(stats, {"source": "a.pdf"}).collect()}
    assert got[1].startswith("source: a.pdf\n\n  blocks translated: 3\n") and got[1].endswith("failed blocks:\n  - page0:block1: E: x\n") and got[2].endswith("no failed blocks\n")
    regions = spark.createDataFrame([("i", 1, "b"), ("i", 0, "a")], "image string, region_index int, text string")
    report = json.loads(sinks.correction_report(regions, ["image"], "region_index", {"command": "correct"}).first()["report"])
    assert report == {"command": "correct", "image": "i", "regions": [{"region_index": 0, "text": "a"}, {"region_index": 1, "text": "b"}]}
    entries = spark.createDataFrame([(1, 5.0, "two\nlines", "x|y"), (0, 9.0, "one", None)], "page_index int, y0 double, text string, echo string")
    lines = [r["report"].split("\n") for r in sinks.comparison_report(entries, ["echo"], ["page_index", "y0"]).collect()]
    assert lines[0][0] == "## 1 (page 1)" and lines[1][2:4] == ["> two", "> lines"] and lines[1][-2] == "| echo | x\\|y |"


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the license"), (2, "nothing")], "doc_id int, full_text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = folders.search_stream(folders.document_stream(spark, str(tmp_path / "in"), "doc_id int, full_text string"), "license").select("doc_id")
    folders.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).start().awaitTermination()
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
    events = [(datetime.datetime(2026, 1, d, h), "deepl", 10) for d in (1, 2, 20) for h in (1, 5)]
    spark.createDataFrame(events, "ts timestamp, provider string, characters long").write.parquet(str(tmp_path / "ev"))
    usage = folders.usage_stream(spark.readStream.schema("ts timestamp, provider string, characters long").parquet(str(tmp_path / "ev")))
    folders.to_table(usage, str(tmp_path / "use"), str(tmp_path / "ck2")).start().awaitTermination()
    got = {r["day"].day: r["characters"] for r in spark.read.parquet(str(tmp_path / "use")).collect()}
    assert got == {1: 20, 2: 20}
