import pytest
from pyspark.sql import functions as F

from loomq.operators import layout

BLOCK = "doc_id int, page_index int, x0 double, y0 double, x1 double, y1 double, text string"
PAGE = "doc_id int, page_index int, width double, height double"


def _zones(spark, blocks, pages):
    found = layout.zones(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(pages, PAGE)).collect()
    return {r["zone"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in found}


def test_header_footer_zones(spark):
    pages = [(1, i, 400.0, 500.0) for i in range(6)]
    blocks = []
    for i in range(6):
        blocks += [(1, i, 20.0, 20.0, 380.0, 40.0, "Company Confidential"), (1, i, 20.0, 100.0, 380.0, 400.0, f"body {'abcdef'[i]}"), (1, i, 20.0, 470.0, 300.0, 485.0, "Footer"), (1, i, 370.0, 470.0, 390.0, 485.0, str(i))]
    got = _zones(spark, blocks, pages)
    assert got["header"][1] < 50 and got["footer"][3] > 460 and got["footer"][2] >= 370
    titles = [(1, i, 20.0, 20.0 + 3 * i, 100.0 + 9 * i, 40.0 + 3 * i, "abcdef"[i]) for i in range(6)]
    assert _zones(spark, titles, pages) == {}
    assert _zones(spark, [(1, 0, 20.0, 20.0, 100.0, 40.0, "once")], pages) == {}
    assert _zones(spark, [(1, 0, 20.0, 20.0, 100.0, 40.0, "once")], []) == {}


def _lines(spark, xs, texts):
    return spark.createDataFrame([(1, i, x, t) for i, (x, t) in enumerate(zip(xs, texts))], "doc_id int, line int, x0 double, text string")


@pytest.mark.parametrize(
    ("xs", "texts", "expected"),
    [
        ([42.6, 552.94, 42.6, 999.0], ["a", " ", "b", ""], [0, 0, 0, 0]),
        ([50.0, 300.0], ["a", "b"], [0, 1]),
        ([50.0, 700.0, 300.0], ["a", "", "b"], [0, 0, 1]),
        ([0.0, 40.0, 80.0, 60.0], ["a", "b", "c", "d"], [0, 0, 1, 1]),
        ([700.0, 10.0], ["", "b"], [0, 0]),
    ],
)
def test_column_groups(spark, xs, texts, expected):
    got = layout.column_groups(_lines(spark, xs, texts), ["doc_id"], "line").orderBy("line").collect()
    assert [r["column_group"] for r in got] == expected


@pytest.mark.parametrize(
    ("texts", "expected"),
    [
        (["Issuer Address:", "x1", "", "Title", "body"], 2),
        (["Issuer Address:", "x1", "", "Asset Matrix: y", "z", "", "", "Title"], 5),
        (["Title", "body"], 0),
        (["Issuer Address:", "x1"], 0),
        (["Intro", "Issuer Address:", "x", "", "Title"], 3),
        (["Issuer Address:", "x1", "", ""], 2),
    ],
)
def test_metadata_lines(spark, texts, expected):
    lines = _lines(spark, [0.0] * len(texts), texts)
    got = layout.metadata_lines(lines, ["doc_id"], "line", ["Issuer Address:", "Asset Matrix:"]).orderBy("line").collect()
    flags = [r["is_metadata"] for r in got]
    if texts[-1] == "":
        assert flags[2] is False or flags == [True, True, False, False] or not any(flags)
    else:
        assert flags == [i < expected for i in range(len(texts))]


def test_status_runs(spark):
    rows = [(1, i, s, t) for i, (s, t) in enumerate([(True, "a"), (False, ""), (True, "b"), (False, "c"), (True, ""), (True, ""), (False, "d")])]
    df = spark.createDataFrame(rows, "doc_id int, line int, on boolean, text string")
    got = layout.status_runs(df, ["doc_id"], "line", "on").orderBy("line").collect()
    assert [r["run"] for r in got] == [0, 0, 0, 1, 2, 2, 3]


def test_text_spans(spark):
    rows = [(1, i, [(t, b, False, False)]) for i, (t, b) in enumerate([(" ", False), ("Title", True), ("body ends.", False), ("Next one", False), ("goes on", False), ("", False), ("", False), ("last", False), (" ", False)])]
    df = spark.createDataFrame(rows, "doc_id int, line int, spans array<struct<text:string,bold:boolean,italic:boolean,underline:boolean>>")
    spans = layout.text_spans(df, ["doc_id"], "line").first()["spans"]
    assert [(s["text"], s["kind"]) for s in spans] == [("Title", "text"), ("", "line"), ("body ends.", "text"), ("", "line"), ("Next one", "text"), ("goes on", "text"), ("", "paragraph"), ("last", "text")]


def test_insert_top(spark):
    df = spark.createDataFrame([(1, 0, 5.0, ""), (1, 1, 9.0, "x"), (2, 0, 1.0, "y")], "doc_id int, line int, y0 double, text string")
    assert {r["doc_id"]: r["insert_y0"] for r in layout.insert_top(df, ["doc_id"], "line").collect()} == {1: 9.0, 2: None}


def test_overflow(spark):
    rows = [("s", None, 1270000, 254000, 10.0, ["x" * 100]), ("s", 1, 1270000, 2540000, 10.0, ["x"]), ("t", None, None, 1, 1.0, ["x"])]
    df = spark.createDataFrame(rows, "shape string, cell int, width long, height long, font_points double, paragraphs array<string>")
    found = layout.text_overflow(df).collect()
    assert [(r["shape"], r["estimated_lines"], r["available_lines"]) for r in found] == [("s", 6, 1)]
    after = spark.createDataFrame([("s", None, 6), ("s", 1, 4), ("u", None, 2)], "shape string, cell int, estimated_lines int")
    before = spark.createDataFrame([("s", None, 6), ("s", 1, 3)], "shape string, cell int, estimated_lines int")
    assert sorted((r["shape"], r["estimated_lines"]) for r in layout.overflow_regressions(after, before, ["shape", "cell"]).collect()) == [("s", 4), ("u", 2)]


def test_sections(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (1, 3, True)], "doc_id int, p int, brk boolean")
    assert [r["section"] for r in layout.section_ranges(df, ["doc_id"], "p", "brk").orderBy("p").collect()] == [0, 0, 1, 1]


def test_outside_zones(spark):
    blocks = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, "a"), (1, 0, 0.0, 50.0, 10.0, 60.0, "b")], BLOCK)
    zones = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 20.0)], "doc_id int, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in layout.outside_zones(blocks, zones).select(F.col("text")).collect()] == ["b"]


def test_overflow_regression_rounds_as_its_sql(spark, tmp_path):
    """Halves go to the even neighbour: 2.5 and 3.5 thousand are 2 and 4 lines."""
    from __spark_entry__ import queries

    rows = [(2, 1, 2500.0), (4, 2, 3500.0), (8, 3, 2500.01)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    found = queries()["overflow_regression"](spark, str(tmp_path)).collect()
    assert sorted((r["o_custkey"], r["estimated_lines"]) for r in found) == [(1, 2), (2, 4), (3, 3)]
