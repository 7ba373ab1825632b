import pytest
from pyspark.sql import functions as F

from loomq.operators import corrections as c

BLOCKS = "doc_id int, page_index int, block_index int, x0 double, y0 double, x1 double, y1 double, font_size double, limit double"


@pytest.fixture()
def page(spark):
    rows = [(1, 0, 0, 10.0, 10.0, 110.0, 30.0, 10.0, 700.0), (1, 0, 1, 10.0, 60.0, 110.0, 80.0, 10.0, 700.0), (1, 0, 2, 200.0, 40.0, 300.0, 50.0, 10.0, 700.0), (2, 5, 0, 10.0, 10.0, 110.0, 30.0, 10.0, 700.0)]
    records = [(1, 0, 0, "<p><b>old &amp; bold</b></p>"), (1, 0, 1, "<p>keep</p>"), (2, 5, 0, "<p>x</p>"), (9, 9, 9, "<p>gone</p>")]
    edits = [(1, 0, 0, "new text " * 90), (1, 0, 1, "keep"), (1, 0, 2, "no record"), (2, 5, 0, "a"), (2, 5, 0, "b < c")]
    return (
        spark.createDataFrame(records, "doc_id int, page_index int, block_index int, html string"),
        spark.createDataFrame(edits, "doc_id int, page_index int, block_index int, edited_text string"), spark.createDataFrame(rows, BLOCKS),
    )


@pytest.mark.parametrize("stored", [False, True])
def test_corrected(page, stored):
    records, edits, blocks = page
    if stored:
        records, blocks = c.store_pages(records, "test_records", 4), c.store_pages(blocks, "test_blocks", 4)
    done = c.corrected_pages(records, edits, blocks)
    got = {(r["doc_id"], r["block_index"]): r for r in done.collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    first = got[1, 0]
    assert first["edited"] and first["new_html"].startswith("<p>new text") and first["next_y0"] == 60.0 and first["final_font"] < 10 and not first["fits"]
    assert not got[1, 1]["edited"] and got[1, 1]["new_html"] == "<p>keep</p>" and got[1, 1]["next_y0"] is None and got[1, 1]["fits"]
    assert got[2, 0]["new_html"] == "<p>b &lt; c</p>"
    stats = {r["doc_id"]: tuple(r)[1:] for r in c.correction_stats(done).collect()}
    assert stats == {1: (2, 1, 1), 2: (1, 1, 0)}


def test_stored_pages_are_not_moved(spark, page):
    """Only the edits are shuffled, and each stored table is scanned once."""
    records, edits, blocks = page
    records, blocks = c.store_pages(records, "plan_records", 4), c.store_pages(blocks, "plan_blocks", 4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = c.corrected_pages(records, edits, blocks)
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert len(done.collect()) == 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    lines = plan.splitlines()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") == sum("Exchange" in line for line in lines) == 1
    for n, line in enumerate(lines):
        if "Exchange" in line:  # below an exchange there is nothing stored
            depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
            below = []
            for other in lines[n + 1 :]:
                if len(other) - len(other.lstrip(" :+-*()0123456789")) <= depth:
                    break
                below.append(other)
            assert not any("FileScan" in other for other in below)


def test_odd_pages(spark, page):
    """Rows without a page aren't stored; a table is replaced; a name must be one."""
    _, _, blocks = page
    more = blocks.unionByName(blocks.limit(1).withColumn("page_index", F.lit(None).cast("int")))
    assert c.store_pages(more, "odd_blocks", 2).count() == 4 and c.store_pages(blocks.limit(2), "odd_blocks", 3).count() == 2
    with pytest.raises(ValueError):
        c.store_pages(blocks, "x; drop", 2)
