import itertools
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomq.operators import answers, cost, pipelines, translate

UNIT = "run int, unit_index int, text string, translatable boolean"


@pytest.fixture()
def counted(tmp_path):
    """A provider that writes down every text it is sent, and makes of it what another would."""
    numbers = itertools.count()

    def make(name="counted", answer=lambda t: ValueError("refused") if "fail" in t else t.upper()):
        folder = tmp_path / f"{name}{next(numbers)}"
        folder.mkdir()
        place = str(folder)

        class Counted:
            def __init__(self):
                with open(os.path.join(place, f"made-{os.getpid()}"), "a") as out:
                    out.write("x")

            def translate(self, texts, target, source):
                with open(os.path.join(place, f"sent-{os.getpid()}"), "a") as out:
                    out.writelines(repr(t) + "\n" for t in texts)
                return [answer(t) for t in texts]

        translate.register(name, Counted)

        def seen() -> Counter:
            return Counter(line for f in folder.glob("sent-*") for line in f.read_text().splitlines())

        def makings() -> dict[str, int]:
            return {f.name: len(f.read_text()) for f in folder.glob("made-*")}

        return seen, makings

    return make


def test_each_text_once(spark, counted):
    """Repeated texts go out once, whatever is done with the result; a worker makes one provider for all its batches."""
    seen, makings = counted()
    units = spark.range(6000).select(F.lit(1).alias("run"), F.col("id").cast("int").alias("unit_index"), F.concat(F.lit("t"), F.col("id") % 500).alias("text"), F.lit(True).alias("translatable"))
    done = translate.translate_units(units.repartition(3), "counted", "DE")
    assert done.filter("status = 'translated' and translated = upper(text)").count() == 6000
    assert done.agg(F.sum("chars_sent")).first()[0] == units.agg(F.sum(F.length("text"))).first()[0]
    done.join(done.select("unit_index"), "unit_index").collect()
    assert len(seen()) == 500 and set(seen().values()) == {1} and set(makings().values()) == {1}


def test_slides_pages_images_and_word(spark, counted):
    seen, _ = counted(answer=lambda t: re.sub("<[^>]+>", "", t) if "lose" in t and t.count("<span") != 1 else t)
    slides = spark.createDataFrame([(i, [f"a {i % 7}", "12", "b"]) for i in range(40)] + [(99, ["lose", "x"])], "id int, texts array<string>")
    done = pipelines.translate_slides(slides, ["id"], "counted", "DE")
    translate.outcome_stats(done, ["id"]).collect()
    done.filter("status = 'failed'").collect()
    assert len(seen()) == 7 + 1 + 2 and set(seen().values()) == {1}

    seen, _ = counted()
    blocks = spark.createDataFrame([(d, 0, b, f"t{b}", f"<b>t{b}</b>" if b % 2 else None, True) for d in range(5) for b in range(20)], "doc_id int, page_index int, block_index int, text string, html string, translatable boolean")
    pages = pipelines.translate_pages(blocks, "counted", "DE")
    assert pipelines.page_stats(pages).join(pipelines.block_records(pages).groupBy("doc_id").count(), "doc_id").filter("translated = 20 and count = 10").count() == 5
    assert len(seen()) == 20 and set(seen().values()) == {1}

    seen, _ = counted()
    boxes = spark.createDataFrame([(i, 0, "same", 20, 20, 150, 12, 90.0, None, True) for i in range(30)], "image int, idx int, text string, x int, y int, width int, height int, confidence double, line_height int, translatable boolean")
    replacements, stats = pipelines.translate_images(boxes, ["image"], "idx", "counted", "DE")
    assert replacements.count() == 30 and stats.filter("translated = 1").count() == 30 and list(seen().values()) == [1]

    seen, _ = counted()
    runs = "array(named_struct('text', concat('w', id % 3), 'translatable', true, 'is_image', false, 'is_hyperlink', false, 'hyperlink_target', cast(null as string), 'bold', false, 'italic', false, 'underline', false))"
    word = spark.range(12).selectExpr("'p' AS path", "'body' AS part", "cast(id AS int) AS para_index", "true AS translatable", f"{runs} AS runs")
    done = pipelines.translate_word(word, "counted", "DE")
    assert pipelines.word_stats(done).first()["body_translated"] == 12 and done.count() == 12
    assert len(seen()) == 3 and set(seen().values()) == {1}


def in_turn(sizes: list[int], fails: list[bool], budget: int) -> tuple[list[str], int]:
    """What one call after the other does: refuse what doesn't fit, add up after success only."""
    used, out = 0, []
    for n, bad in zip(sizes, fails):
        if used + n > budget:
            out.append("over budget")
        else:
            out.append("failed" if bad else "translated")
            used += 0 if bad else n
    return out, used


def test_failures_leave_the_budget(spark, counted):
    """The first fails, the second fits all the same, the third doesn't; nothing over the budget ever goes out."""
    seen, _ = counted()
    units = spark.createDataFrame([(1, 0, "fail....", True), (1, 1, "a" * 8, True), (1, 2, "b" * 3, True)], UNIT)
    done = translate.translate_units(units, "counted", "DE", run=["run"], budget=10).orderBy("unit_index").collect()
    assert [(r["status"], r["error"], r["chars_sent"]) for r in done] == [("failed", "ValueError: refused", 0), ("translated", None, 8), ("failed", "over budget", 0)]
    assert sorted(seen()) == sorted(map(repr, ["fail....", "a" * 8]))


@pytest.mark.parametrize("seed", range(3))
def test_budget_as_in_turn(spark, counted, seed):
    r = random.Random(seed)
    rows, expected = [], {}
    for run in range(12):
        sizes = [r.randint(1, 9) for _ in range(r.randint(1, 25))]
        fails = [r.random() < 0.4 for _ in sizes]
        # within a run texts differ by their number, so that every one has an outcome of its own
        texts = [(("f" if bad else "g") + f"{run:02d}{i:02d}").ljust(5 + n, ".") for i, (n, bad) in enumerate(zip(sizes, fails))]
        rows += [(run, i, t, True) for i, t in enumerate(texts)]
        expected[run] = in_turn([len(t) for t in texts], fails, 60)
    seen, _ = counted(answer=lambda t: ValueError("no") if t[0] == "f" else t)
    got = translate.translate_units(spark.createDataFrame(rows, UNIT), "counted", "DE", run=["run"], budget=60).collect()
    for run, (states, used) in expected.items():
        own = sorted((u for u in got if u["run"] == run), key=lambda u: u["unit_index"])
        assert ["over budget" if u["error"] == "over budget" else u["status"] for u in own] == states
        assert sum(u["chars_sent"] for u in own) == used
    refused = {repr(u["text"]) for u in got if u["error"] == "over budget"}
    assert not refused & set(seen()) and set(seen().values()) == {1}


def test_ledger_and_log(spark, counted, tmp_path):
    counted()
    units = spark.createDataFrame([(1, 0, "aa", True), (1, 1, "aa", True), (1, 2, "fail", True), (1, 3, "bbb", True), (1, 4, " ", True)], UNIT)
    run = translate.run_units(units, "counted", "DE", log=str(tmp_path / "log"))
    assert sorted(r["characters"] for r in answers.ledger(run.new, "counted").collect()) == [2, 3]
    log = spark.read.schema("provider string, ts timestamp, characters long").json(str(tmp_path / "log"))
    usage = cost.monthly_usage(log).collect()
    assert [(r["provider"], r["characters"]) for r in usage] == [("counted", 5)]
    assert run.units.agg(F.sum("chars_sent")).first()[0] == 7


def test_book(spark, counted, tmp_path):
    """A second run asks for failed and new texts only; another target or source asks anew."""
    seen, _ = counted()
    book = answers.Book(str(tmp_path / "book"))
    first = spark.createDataFrame([(1, 0, "a", True), (1, 1, "fail", True)], UNIT)
    second = spark.createDataFrame([(1, 0, "a", True), (1, 1, "fail", True), (1, 2, "c", True)], UNIT)
    translate.translate_units(first, "counted", "DE", book=book)
    for more in ({}, {"run": ["run"], "budget": 50}):
        got = translate.translate_units(second, "counted", "DE", book=book, **more).orderBy("unit_index").collect()
        assert [r["status"] for r in got] == ["translated", "failed", "translated"]
    assert seen() == {"'a'": 1, "'fail'": 3, "'c'": 1}
    translate.translate_units(first, "counted", "FI", book=book)
    translate.translate_units(first, "counted", "DE", "EN", book=book)
    assert seen()["'a'"] == 3


def test_odd_providers_and_units(spark, counted):
    """A provider that breaks or loses texts fails their units; an empty table is empty; a null budget key is a run."""
    def explode(t):
        raise OSError("down")

    counted(answer=explode)
    units = spark.createDataFrame([(None, 0, "a", True), (None, 1, None, True), (1, None, "a", None)], UNIT)
    for more in ({}, {"run": ["run"], "budget": 9}):
        got = {(r["run"], r["unit_index"]): (r["status"], r["error"]) for r in translate.translate_units(units, "counted", "DE", **more).collect()}
        assert got == {(None, 0): ("failed", "OSError: down"), (None, 1): ("skipped", None), (1, None): ("skipped", None)}
        assert translate.translate_units(units.filter("false"), "counted", "DE", **more).count() == 0
    assert answers.answered(type("Lossy", (), {"translate": lambda *_: []})(), ["a"], "DE", None)[0].args == ("1 texts sent, 0 came back",)
