import re

import pytest
from pyspark.sql import functions as F

from loomq.operators import layout, pages, pipelines, translate
from loomq.sources import office


@pytest.fixture(autouse=True, scope="module")
def shout():
    class Shout:  # local, so that it travels to the workers by value
        """Upper case outside of tags; loses marks where a text says so."""

        def translate(self, texts, target, source):
            out = []
            for t in texts:
                if "[[fail]]" in t:
                    out.append(ValueError("refused"))
                elif "[[lose]]" in t and t.count("<span") != 1:
                    out.append(re.sub("<[^>]+>", "", t))
                else:
                    out.append(re.sub(r"(<[^>]+>|&[a-z#0-9]+;|§§\w+§§)|([^<&§]+)", lambda m: m[1] or m[2].upper(), t))
            return out

    translate.register("shout", Shout)


def test_word(spark):
    content = office.word_bytes({"header": ["head"], "body": ["Hello & bye", "", "x [[fail]]", "keep WISDOM low"]})
    paragraphs = office.read_word(spark.createDataFrame([("a", bytearray(content))], "path string, content binary"))
    done = pipelines.translate_word(paragraphs, "shout", "DE", terms=["wisdom"])
    got = {(r["part"], r["para_index"]): r for r in done.collect()}
    assert [r["text"] for r in got["body", 0]["new_runs"]] == ["HELLO & BYE"] and got["body", 0]["chars_sent"] == len("Hello &amp; bye")
    assert got["header", 0]["status"] == "skipped" and got["body", 1]["status"] == "skipped"
    assert got["body", 2]["error"] == "body:2: ValueError: refused" and got["body", 2]["chars_sent"] == 0
    assert [r["text"] for r in got["body", 3]["new_runs"]] == ["KEEP WISDOM LOW"]
    stats = pipelines.word_stats(done).first()
    assert (stats["body_translated"], stats["body_skipped"], stats["body_failed"], stats["header_skipped"]) == (2, 1, 1, 1)


def test_word_loses_a_link(spark):
    runs = "array(named_struct('text', 'a', 'translatable', true, 'is_image', false, 'is_hyperlink', true, 'hyperlink_target', 'u', 'bold', false, 'italic', false, 'underline', false))"
    df = spark.createDataFrame([("p", "body", 0, True)], "path string, part string, para_index int, translatable boolean").withColumn("runs", F.expr(runs))

    class Strip:
        def translate(self, texts, target, source):
            return [re.sub("<[^>]+>", "", t) for t in texts]

    translate.register("strip", Strip)
    r = pipelines.translate_word(df, "strip", "DE").first()
    assert (r["status"], r["chars_sent"]) == ("failed", 0) and "<a> marks changed" in r["error"]


def test_slides(spark):
    rows = [(1, ["hi", "12", "you"]), (2, ["12"]), (3, ["a [[lose]]", "b"]), (4, ["[[fail]]"])]
    done = pipelines.translate_slides(spark.createDataFrame(rows, "id int, texts array<string>"), ["id"], "shout", "DE")
    got = {r["id"]: r for r in done.collect()}
    assert got[1]["new_texts"] == {0: "HI", 2: "YOU"} and got[2]["status"] == "skipped" and got[4]["status"] == "failed"
    assert got[3]["status"] == "translated" and got[3]["new_texts"] == {0: "A [[LOSE]]", 1: "B"}
    assert got[3]["chars_sent"] == 2 * len(got[3]["html"])


def test_images(spark):
    rows = [(1, 0, "a", 20, 20, 150, 12, 90.0, None, True), (1, 1, "b", 20, 33, 150, 12, 90.0, None, True), (1, 2, "c", 400, 20, 50, 12, 10.0, None, True), (1, 3, "[[fail]]", 20, 300, 50, 12, 90.0, None, True), (2, 0, "z", 0, 0, 5, 5, 1.0, None, True)]
    df = spark.createDataFrame(rows, "image int, idx int, text string, x int, y int, width int, height int, confidence double, line_height int, translatable boolean")
    done, stats = pipelines.translate_images(df, ["image"], "idx", "shout", "DE")
    assert [r["translated"] for r in done.collect()] == ["A B"]
    got = {r["image"]: r for r in stats.collect()}
    assert (got[1]["regions"], got[1]["skipped"], got[1]["translated"], got[1]["failed"], got[1]["chars_sent"]) == (4, 1, 2, 1, 3)
    assert (got[2]["skipped"], got[2]["translated"]) == (1, 0)


def test_engines(spark):
    class Fake:
        returns_paragraphs = False

        def recognise(self, image, language):
            if image == b"bad":
                raise OSError("no image")
            return [{"text": image.decode(), "x": 1, "y": 2, "width": 3, "height": 4, "confidence": 50.0, "translatable": True}]

    pipelines.register_engine("fake", Fake)
    df = spark.createDataFrame([("a", bytearray(b"hi")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {r["path"]: r for r in pipelines.recognise(df, "fake").collect()}
    assert got["a"]["text"] == "hi" and got["a"]["region_index"] == 0 and got["b"]["error"] == "OSError: no image"
    with pytest.raises(KeyError, match="fake"):
        pipelines.recognise(df, "none")


LINE = "doc_id int, page_index int, block_index int, line_index int, x0 double, y0 double, x1 double, y1 double, text string"
MARK = "doc_id int, page_index int, x0 double, y0 double, x1 double, y1 double"


def _line(block, n, y, text, x=10.0, page=0):
    return (1, page, block, n, x, float(y), x + 100, float(y + 10), text)


def test_page_blocks_move_rows_once(spark):
    """The lines go through Python once and are moved three times: by page, after the fold and by document for zones."""
    box = "x0 double, y0 double, x1 double, y1 double"
    lines = spark.createDataFrame([(None, 0, 0, 0, 1.0, 10.0, 9.0, 18.0, "a"), (None, 0, 0, 1, 1.0, 20.0, 9.0, 28.0, "b")], f"doc_id long, page_index int, block_index int, line_index int, {box}, text string")
    marks = spark.createDataFrame([(None, 0, 0.0, 20.0, 9.0, 28.0)] * 2, f"doc_id long, page_index int, {box}")
    zones = spark.createDataFrame([(None, 0.0, 0.0, 9.0, 15.0)], f"doc_id long, {box}")
    found = pages.page_blocks(lines, marks, marks, zones=zones)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange ") <= 6
    assert [(r["text"], r["highlighted"], r["is_link"], r["translatable"]) for r in found.orderBy("place").collect()] == [("a", False, False, False), ("b", True, True, False)]


def test_page_blocks(spark):
    lines = spark.createDataFrame([_line(0, 0, 5, "Letterhead"), _line(1, 0, 30, "Issuer Address: X"), _line(1, 1, 42, "street"), _line(1, 2, 54, ""), _line(1, 3, 66, "Title"), _line(1, 4, 78, "quoted"), _line(1, 5, 90, "linked"), _line(1, 6, 102, "right", 300.0), _line(2, 0, 130, " ")], LINE)
    bands = spark.createDataFrame([(1, 0, 0.0, 78.0, 500.0, 88.0)], MARK)
    links = spark.createDataFrame([(1, 0, 10.0, 90.0, 60.0, 100.0)], MARK)
    got = [(r["text"], r["translatable"], r["highlighted"], r["is_link"]) for r in pages.page_blocks(lines, bands, links, ["Issuer Address:"]).orderBy("place").collect()]
    assert got == [("Letterhead", True, False, False), ("Issuer Address: X\nstreet", False, False, False), ("Title", True, False, False), ("quoted", True, True, False), ("linked", False, False, True), ("right", True, False, False)]
    zones = spark.createDataFrame([(1, "header", 0.0, 0.0, 500.0, 20.0)], "doc_id int, zone string, x0 double, y0 double, x1 double, y1 double")
    zoned = pages.page_blocks(lines, bands, links, ["Issuer Address:"], zones).filter("text = 'Letterhead'").first()
    assert zoned["translatable"] is False
    scopes = pages.page_scopes(lines, bands, links, zones, ["Issuer Address:"]).first()
    assert scopes["ico_format"] == "Letterhead\nIssuer Address: X\nstreet" and scopes["header"] == "Letterhead"
    assert scopes["full_text"].startswith("Letterhead\nIssuer Address: X\nstreet") and scopes["full_text"].endswith("right")
    assert layout.COLUMN_SPREAD == 50.0


def test_insert_place_and_corrections(spark):
    lines = spark.createDataFrame([_line(0, 0, 5, " "), _line(0, 1, 20, "text")], LINE)
    none = spark.createDataFrame([], MARK)
    block = pages.page_blocks(lines, none, none).first()
    assert (block["y0"], block["insert_y0"]) == (5.0, 20.0)
    records = spark.createDataFrame([(1, 0, 0, "<p><b>a</b></p>"), (1, 0, 1, "<p>b</p>"), (1, 9, 9, "<p>gone</p>")], "doc_id int, page_index int, block_index int, html string")
    blocks = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 1.0, 1.0), (1, 0, 1, 0.0, 0.0, 1.0, 1.0)], "doc_id int, page_index int, block_index int, x0 double, y0 double, x1 double, y1 double")
    edits = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "new & b")], "doc_id int, page_index int, block_index int, edited_text string")
    got = [r["new_html"] for r in pages.corrections(records, edits, blocks).orderBy("block_index").collect()]
    assert got == ["<p><b>a</b></p>", "<p>new &amp; b</p>"]
