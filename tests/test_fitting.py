import random

import pytest
from pyspark.sql import functions as F

from loomq.operators import fitting, pipelines, translate


def wrap(text, per_line):
    lines, widest = 0, 0
    for segment in text.split("\n"):
        own = [""]
        for word in segment.split():
            if own[-1] and len(own[-1]) + 1 + len(word) <= per_line:
                own[-1] += " " + word
            elif own[-1]:
                own.append(word)
            else:
                own[-1] = word
        lines, widest = lines + len(own), max(widest, *map(len, own))
    return lines, widest


def test_wrapping(spark):
    r = random.Random(7)
    rows = [(" ".join("x" * r.randint(1, 9) for _ in range(r.randrange(12))) + r.choice(["", "\n", "\n\nend"]), r.randrange(1, 20)) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, n int").select("t", "n", fitting.wrapped(F.col("t"), F.col("n")).alias("w"))
    assert all((x["w"]["lines"], x["w"]["widest"]) == wrap(x["t"], x["n"]) for x in df.collect())


def test_growth(spark):
    rows = [(1, 0, "word " * 30, 10, 10, 100, 20, None, None), (1, 1, "short", 10, 400, 100, 20, None, None), (1, 2, "word " * 30, 300, 10, 60, 20, 20, (1, 2, 3, 4)), (1, 3, "word " * 4000, 10, 500, 50, 20, None, None)]
    df = spark.createDataFrame(rows, "image int, idx int, t string, x int, y int, width int, height int, line_height int, render_box struct<x:int,y:int,width:int,height:int>")
    got = {x["idx"]: x["render_box"] for x in fitting.grow_regions(df.withColumns({"w": F.lit(500), "h": F.lit(600)}), ["image"], "idx", "t", "w", "h").collect()}
    assert tuple(got[2]) == (1, 2, 3, 4) and got[3] is None  # a given box stays; too long for any box
    size, high = 16, 18
    lines, _ = wrap("word " * 30, int(got[0]["width"] / (size * 0.52)))
    assert got[0]["x"] == 10 and got[0]["y"] == 10 and got[0]["height"] == lines * high
    assert tuple(got[1]) == (10, 400, 100, 20)


BLOCK = "doc_id int, page_index int, block_index int, text string, html string, translatable boolean, x0 double, y0 double, x1 double, y1 double, font_size double"


def _blocks(spark):
    rows = [
        (1, 0, 0, "long " * 60, None, True, 10.0, 10.0, 110.0, 30.0, 10.0), (1, 0, 1, "below", "<b>below</b>", True, 10.0, 80.0, 110.0, 100.0, 10.0),
        (1, 0, 2, "aside", None, False, 200.0, 40.0, 300.0, 50.0, 10.0), (1, 1, 0, "[[fail]]", None, True, 10.0, 10.0, 110.0, 30.0, 10.0),
    ]
    return spark.createDataFrame(rows, BLOCK).withColumn("limit", F.lit(700.0))


def test_blocks_grow_then_shrink(spark):
    fitted = fitting.fit_blocks(_blocks(spark), ["doc_id", "page_index"], "block_index", "text", "limit")
    got = {(r["page_index"], r["block_index"]): r for r in fitted.collect()}
    long = got[0, 0]
    assert long["next_y0"] == 80.0 and long["cap_y1"] == 77.0 and long["final_y1"] <= 77.0 and long["final_font"] < 10.0
    assert got[0, 1]["next_y0"] is None and got[0, 1]["cap_y1"] == 700.0 and got[0, 1]["final_font"] == 10.0 and got[0, 1]["fits"]
    kinds = {r["kind"] for r in fitting.growth_anomalies(fitted).filter("block_index = 0 and page_index = 0").collect()}
    assert "small_final_font" in kinds and "excessive_height_growth" in kinds
    wide = _blocks(spark).withColumns({"wx0": F.when(F.col("block_index") == 0, 10.0), "wx1": F.when(F.col("block_index") == 0, 250.0)})
    assert fitting.fit_blocks(wide, ["doc_id", "page_index"], "block_index", "text", "limit", ("wx0", "wx1")).filter("page_index = 0 and block_index = 0").first()["next_y0"] == 40.0


def test_pages(spark):
    done = pipelines.translate_pages(_blocks(spark), "echo", "DE")
    got = {(r["page_index"], r["block_index"]): r for r in done.collect()}
    assert got[0, 1]["translated_html"] == "[DE] <b>below</b>" and got[0, 1]["translated_text"] is None and got[0, 1]["chars_sent"] == len("<b>below</b>")
    assert got[0, 2]["status"] == "skipped" and got[1, 0]["error"] == "page1:block0: ValueError: refused"
    assert [tuple(r) for r in pipelines.block_records(done).collect()] == [(1, 0, 1, "below", "[DE] <b>below</b>")]
    fitted = fitting.fit_blocks(done.withColumn("shown", F.coalesce("translated_text", "text")), ["doc_id", "page_index"], "block_index", "shown", "limit")
    stats = pipelines.page_stats(fitted.withColumn("fits", F.col("block_index") != 0)).first()
    assert (stats["translated"], stats["skipped"], stats["failed"], stats["overflow_blocks"]) == (2, 1, 1, 1) and stats["errors"] == ["page1:block0: ValueError: refused"]
    ordered = translate.reading_order(_blocks(spark).withColumn("place", F.col("block_index")))
    assert [(r["page_index"], r["block_index"]) for r in ordered.collect()] == [(0, 0), (0, 1), (1, 0)]


def test_missing_links(spark):
    link = "doc_id int, page_index int, x0 double, y0 double, x1 double, y1 double, kind int, uri string, target_page int, target string"
    rows = [(1, 0, 1.001, 2.0, 3.0, 4.0, 2, "http://a", None, None), (1, 0, 5.0, 2.0, 9.0, 4.0, 1, None, 3, "p"), (1, 1, 1.0, 2.0, 3.0, 4.0, 2, "http://a", None, None)]
    kept = [(1, 0, 1.0, 2.0, 3.0, 4.0, 2, "http://a", None, None), (1, 0, 5.0, 2.0, 9.0, 4.0, 1, None, 4, "p")]
    lost = fitting.missing_links(spark.createDataFrame(rows, link), spark.createDataFrame(kept, link))
    assert sorted((r["page_index"], r["kind"]) for r in lost.collect()) == [(0, 1), (1, 2)]


@pytest.mark.parametrize("text", [None, ""])
def test_empty_text(value, text):
    assert tuple(value(lambda t: fitting.wrapped(t, F.lit(5)), (text, "string"))) == (1, 0)


def fit_in_steps(text, width, first, high, left, right):
    """Every size from the first down, then every width, as one would try them by hand."""
    each = fitting.SANS.each()

    def wide(word):
        return sum(each.get(c, fitting.SANS.default) for c in word)

    def lines_at(most):
        out = []
        for segment in text.split("\n"):
            own = []
            for word in segment.split():
                if own and wide(own[-1].replace(" ", "")) + own[-1].count(" ") * fitting.SANS.space + fitting.SANS.space + wide(word) <= most:
                    own[-1] += " " + word
                else:
                    own.append(word)
            out += own or [""]
        return out

    def good(size, most):
        lines = lines_at(most * 1000 / size)
        return len(lines) * max(1, int(size * 1.15)) <= high and max(wide(w) for w in [*text.split(), ""]) * size <= most * 1000, lines

    size = first
    while True:
        fits, lines = good(size, width)
        if fits or size <= 9:
            break
        size = max(9, size - 2)
    extra, more = 0.0, left + right
    while not fits and extra < more:
        extra = min(extra + max(more / 8, 1.0), more)
        fits, lines = good(size, width + extra)
    return size, "\n".join(lines), -(extra - min(extra, right)), fits


def test_fit_texts(spark):
    r = random.Random(11)
    rows = []
    for n in range(250):
        text = " ".join("".join(r.choice("iWmaÄé中l") for _ in range(r.randint(1, 14))) for _ in range(r.randrange(25))) + r.choice(["", "\n", "\nend  of it", "\n\n"])
        rows.append((n, text, r.randint(0, 300), r.randint(5, 70), r.randint(10, 200), r.choice([0, 3, 50]), r.choice([0, 1, 90])))
    df = spark.createDataFrame(rows, "id int, text string, width int, height int, high int, l int, r int")
    got = {x["id"]: x for x in fitting.fit_texts(df, "text", "high", "l", "r").collect()}
    seen = set()
    for n, text, width, height, high, left, right in rows:
        first = min(max(int(height * 0.8), 9), 48)
        size, lines, offset, fits = fit_in_steps(text, max(width, 1), first, high, left, right)
        x = got[n]
        assert (x["size"], x["wrapped"], x["n_lines"], x["fits"]) == (size, lines, lines.count("\n") + 1, fits) and x["x_offset"] == pytest.approx(offset)
        assert x["line_height"] == max(1, int(size * 1.15))
        seen.add((size < first, offset < 0, fits))
    assert len(seen) >= 5  # shrunk or not, widened or not, fitting or not


def test_fit_texts_from_columns(spark):
    df = spark.createDataFrame([(None, 50, 30, 13, 31), ("a", 50, 30, None, 8)], "text string, width int, height int, line_height int, first int")
    assert [(x["size"], x["n_lines"], x["fits"]) for x in fitting.fit_texts(df, "text").collect()] == [(10, 1, True), (24, 1, True)]
    assert [x["size"] for x in fitting.fit_texts(df, "text", start_size="first").collect()] == [25, 8]
