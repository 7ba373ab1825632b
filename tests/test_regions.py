import pytest
from pyspark.sql import functions as F

from loomq.operators import geometry, regions

REGION = "doc_id int, idx int, text string, x int, y int, width int, height int, confidence double, line_height int, translatable boolean"


def _regions(spark, boxes, **more):
    rows = [(1, i, f"t{i}", *b, more.get("confidence", [90.0] * 9)[i], None, True) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, REGION)


@pytest.mark.parametrize(
    ("boxes", "expected"),
    [
        ([(822, 180, 138, 12), (837, 196, 71, 12)], [[0, 1]]),
        ([(20, 20, 150, 12), (20, 53, 150, 12)], [[0], [1]]),
        ([(20, 20, 150, 12), (400, 32, 150, 12)], [[0], [1]]),
        ([(100, 10, 300, 37), (100, 50, 300, 20)], [[0], [1]]),
        ([(20, 20, 150, 12), (20, 33, 150, 12), (20, 46, 150, 12)], [[0, 1, 2]]),
        ([(20, 20, 200, 12), (100, 20, 200, 12), (20, 33, 280, 12)], [[0, 2], [1]]),
        ([(20, 20, 150, 12)], [[0]]),
    ],
)
def test_paragraph_chains(spark, boxes, expected):
    chained = regions.paragraph_chains(_regions(spark, boxes), ["doc_id"], "idx").orderBy("chain", "place").collect()
    got = {}
    for r in chained:
        got.setdefault(r["chain"], []).append(r["idx"])
    assert sorted(got.values()) == sorted(expected)


def test_merged_region(spark):
    chained = regions.paragraph_chains(_regions(spark, [(20, 20, 150, 12), (25, 33, 150, 13)]), ["doc_id"], "idx")
    r = regions.merged_regions(chained, ["doc_id"]).first()
    assert (r["text"], r["x"], r["y"], r["width"], r["height"], r["line_height"], r["members"]) == ("t0 t1", 20, 20, 155, 26, 12, 2)


def test_eligibility(spark):
    rows = [(1, 0, "a", 0, 0, 9, 24, 90.0, None, True), (1, 1, "b", 0, 0, 9, 22, 90.0, None, True), (1, 2, "c", 0, 0, 9, 200, 85.0, None, True), (1, 3, "d", 0, 0, 9, 22, 10.0, None, True), (1, 4, "e", 0, 0, 9, 22, 90.0, None, False), (2, 0, "f", 0, 0, 9, 900, 10.0, None, True)]
    got = {(r["doc_id"], r["idx"]): r["reason"] for r in regions.eligibility(spark.createDataFrame(rows, REGION), ["doc_id"], ratio=3.5).collect()}
    assert got == {(1, 0): "ok", (1, 1): "ok", (1, 2): "outlier_height", (1, 3): "low_confidence", (1, 4): "layout", (2, 0): "low_confidence"}


WORD = "doc_id int, word_index int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string"


def test_word_lines(spark):
    rows = [(1, 0, 0, 0, 0, 0, 0, 10, 10, 90.0, "a"), (1, 1, 0, 0, 0, 30, 1, 10, 10, -1.0, "b"), (1, 2, 0, 0, 0, 90, 0, 10, 10, 50.0, "c"), (1, 3, 0, 0, 0, 50, 0, 10, 10, 50.0, "•"), (1, 4, 0, 0, 1, 0, 20, 5, 5, -1.0, "d"), (1, 5, 0, 0, 1, 9, 20, 5, 5, 1.0, "  ")]
    got = [(r["text"], r["x"], r["width"], r["confidence"]) for r in regions.word_lines(spark.createDataFrame(rows, WORD)).orderBy("line_order", "run").collect()]
    assert got == [("a b", 0, 40, 90.0), ("c", 90, 10, 50.0), ("d", 0, 5, 0.0)]


LINES = "doc_id int, line_index int, x0 double, y0 double, x1 double, y1 double, text string, score double"
BLOCKS = "doc_id int, block_index int, label string, x0 double, y0 double, x1 double, y1 double"


def test_layout_regions(spark):
    lines = [
        (1, 0, 10.0, 10.0, 90.0, 20.0, "one", 0.9), (1, 1, 10.0, 22.0, 90.0, 32.0, "two", 0.8), (1, 2, 10.0, 40.0, 90.0, 70.0, "BIG", 0.9),
        (1, 3, 10.0, 210.0, 90.0, 220.0, "in image", 0.9), (1, 4, 10.0, 400.0, 90.0, 410.0, "orphan a", 0.9), (1, 5, 10.0, 412.0, 90.0, 422.0, "orphan b", 0.9),
        (1, 6, 10.0, 500.0, 20.0, 510.0, "x", 0.5),
    ]
    blocks = [(1, 0, "text", 0.0, 0.0, 100.0, 100.0), (1, 1, "image", 0.0, 200.0, 100.0, 300.0), (1, 2, "text", 300.0, 0.0, 310.0, 10.0)]
    got = regions.layout_regions(spark.createDataFrame(lines, LINES), spark.createDataFrame(blocks, BLOCKS)).collect()
    shown = sorted((r["text"], r["origin"], r["translatable"], r["y"], r["height"]) for r in got)
    assert shown == sorted([("one two", "block", True, 10, 22), ("BIG", "block", True, 40, 30), ("in image", "block", False, 200, 100), ("in image", "line", True, 210, 10), ("orphan a orphan b", "orphan", True, 400, 22)])


def test_single_run_keeps_the_block(spark):
    lines = spark.createDataFrame([(1, 0, 10.0, 10.0, 90.0, 20.0, "one", 0.9)], LINES)
    r = regions.block_regions(lines, spark.createDataFrame([(1, 0, "text", 0.0, 0.0, 100.0, 100.0)], BLOCKS)).first()
    assert (r["x"], r["y"], r["width"], r["height"], r["line_height"], r["confidence"]) == (0, 0, 100, 100, 10, 90.0)


def test_annotated_paragraph(value):
    expr = """named_struct('box', array(named_struct('x', 1, 'y', 2), named_struct('x', 11, 'y', 22)), 'confidence', 0.5D, 'words', array(
      named_struct('box', array(named_struct('x', 1, 'y', 2), named_struct('x', 5, 'y', 12)), 'symbols', array('H', 'i')), named_struct('box', array(named_struct('x', 1, 'y', 2)), 'symbols', array('•'))))"""
    got = value(lambda: regions.annotated_paragraph(F.expr(expr)))
    assert got.asDict() == {"text": "Hi", "x": 1, "y": 2, "width": 10, "height": 20, "confidence": 50.0, "line_height": 10}
    only = expr.replace("array('H', 'i')", "array('©')")
    assert value(lambda: regions.annotated_paragraph(F.expr(only))) is None


def test_rooms(spark):
    boxes = [(10, 100, 50, 20), (10, 140, 50, 20), (80, 105, 10, 10), (300, 300, 10, 10)]
    df = _regions(spark, boxes).withColumn("w", F.lit(400)).withColumn("h", F.lit(400))
    got = {r["idx"]: [r[c] for c in ("room_below", "room_above", "room_left", "room_right")] for r in geometry.rooms(df, ["doc_id"], "idx", "w", "h").collect()}
    assert got[0] == [17.0, 80.0, 7.0, 17.0]
    assert got[1] == [80.0, 17.0, 7.0, 337.0]
    assert got[3] == [40.0, 40.0, 297.0, 87.0]


BOX = "page int, id int, x0 double, y0 double, x1 double, y1 double"


def test_bands_and_next(spark):
    blocks = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 5.0, 30.0, 15.0, 40.0), (1, 2, 50.0, 12.0, 60.0, 20.0)], BOX)
    bands = spark.createDataFrame([(1, 0, 0.0, 8.0, 99.0, 14.0), (1, 1, 0.0, 39.0, 99.0, 50.0)], BOX)
    assert {r["id"]: r["highlighted"] for r in geometry.under_bands(blocks, bands, ["page"]).collect()} == {0: True, 1: False, 2: True}
    assert {r["id"]: r["y1"] for r in geometry.band_extent(blocks, bands, ["page"], "id").collect()} == {0: 14.0, 1: None, 2: 14.0}
    assert {r["id"]: r["next_y0"] for r in geometry.next_below(blocks, ["page"], "id").collect()} == {0: 30.0, 1: None, 2: None}


def test_obstacles(spark):
    """A region that wasn't replaced still takes room, from every side; one that was replaced doesn't count twice."""
    from loomq.operators import geometry, pipelines

    box = "image int, idx int, x int, y int, width int, height int"
    rows = [(1, 0, 100, 100, 50, 20), (1, 1, 100, 140, 50, 20), (1, 2, 200, 100, 50, 20), (2, 0, 0, 0, 10, 10)]
    regions = spark.createDataFrame(rows, box)
    chained = regions.filter("idx < 2").withColumn("chain", F.lit(0)).filter("image = 1 or idx = 0")
    drawn = spark.createDataFrame([(1, 0)], "image int, chain int")
    left = pipelines.obstacle_regions(regions, chained, drawn, ["image"], "idx")
    assert sorted((r["image"], r["idx"]) for r in left.collect()) == [(1, 2), (2, 0)]
    sized = regions.filter("image = 1 and idx = 0").selectExpr("*", "400 AS w", "400 AS h")
    free = geometry.rooms(sized, ["image"], "idx", "w", "h").first()
    beside = geometry.rooms(sized, ["image"], "idx", "w", "h", left).first()
    assert free["room_right"] == 247.0 and beside["room_right"] == 47.0 and beside["room_below"] == free["room_below"]
