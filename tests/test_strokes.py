import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomq.operators import strokes as s


def brute(rows: list[list[float]], background: float) -> tuple[float, float, float]:
    """ink, serif and slant of one region, step by step."""
    mask = np.abs(np.array(rows, float) - background) > s.INK_THRESHOLD
    ink = mask.mean() if mask.size else 0.0
    if not mask.any():
        return ink, 0.0, 0.0
    counts = mask.sum(1)
    good = np.flatnonzero(counts >= max(1, int(counts.max() * 0.08)))
    mask = mask[good[0] : good[-1] + 1]
    counts = mask.sum(0)
    good = np.flatnonzero(counts >= max(1, int(counts.max() * 0.08)))
    mask = mask[:, good[0] : good[-1] + 1]
    height, width = mask.shape
    counts, third = mask.sum(1), max(1, height // 3)
    serif = np.concatenate([counts[:third], counts[-third:]]).var() / (counts[third : height - third].var() + 1e-6) if height >= 6 else 0.0
    high, points = max(1, height // 4), []
    for band in range(4):
        xs = np.nonzero(mask[band * high : height if band == 3 else (band + 1) * high])[1]
        if len(xs):
            points.append((band, xs.mean()))
    slant = np.polyfit(*zip(*points), 1)[0] / width if height >= 8 and len(points) > 1 else 0.0
    return ink, serif, slant


def image(kind: str, seed: int) -> list[list[float]]:
    r = random.Random(seed)
    height, width = r.randint(1, 30), r.randint(1, 40)
    ink = {"blank": 0.0, "noise": 0.4, "sparse": 0.04, "full": 1.0}.get(kind)
    if kind == "slanted":
        return [[200.0 if abs(x - width / 2 - (y - 10) * 0.5) < 2 else 0.0 for x in range(40)] for y in range(20)]
    if kind == "serif":
        return [[200.0 if abs(x - 20) < (9 if y in (0, 19) else 2) else 0.0 for x in range(40)] for y in range(20)]
    return [[200.0 if r.random() < ink else 10.0 for _ in range(width)] for _ in range(height)]


def test_against_masks(spark):
    images = {(kind, n): image(kind, n) for kind in ("blank", "noise", "sparse", "full", "slanted", "serif") for n in range(6)}
    lines = [(k, n, y, row, 0.0) for (k, n), rows in images.items() for y, row in enumerate(rows)]
    df = spark.createDataFrame(lines, "kind string, n int, line int, values array<double>, background double").repartition(5)
    got = {(r["kind"], r["n"]): (r["ink"], r["serif"], r["slant"]) for r in s.stroke_statistics(df, ["kind", "n"]).collect()}
    assert set(got) == set(images)
    for key, rows in images.items():
        assert got[key] == pytest.approx(brute(rows, 0.0), rel=1e-9, abs=1e-9), key
    assert got["slanted", 0][2] > 0.05 and abs(got["serif", 0][2]) < 1e-9 and got["serif", 0][1] > 100


def test_odd_lines(spark):
    """Null and empty lines, regions with null keys, names that clash, and an empty table."""
    rows = [(None, 0, [200.0, 0.0], 0.0), (None, 1, None, 0.0), (1, 0, [], 0.0), (2, 0, [0.0, 90.0, 90.0, 0.0], 0.0), (2, 0, [0.0, 90.0, 90.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "floor int, line int, values array<double>, background double").withColumn("region", F.lit("x")).withColumn("places", F.lit("y"))
    got = {r["floor"]: tuple(r)[1:] for r in s.stroke_statistics(df, ["floor"]).collect()}
    assert got == {None: (0.5, 0.0, 0.0), 1: (0.0, 0.0, 0.0), 2: (0.5, 0.0, 0.0)}
    assert s.stroke_statistics(df.filter("false"), ["floor"]).count() == 0


def test_nearer(value):
    def of(*x):
        return value(lambda *c: s.nearer(*c), *[(v, "double") for v in x])

    assert tuple(of(4.0, 0.0, 4.0)) == (True, 1.0) and tuple(of(1.0, 0.0, 4.0)) == (False, 0.5)
    assert tuple(of(2.0, 0.0, 4.0)) == (False, 0.0) and tuple(of(9.0, 0.0, 4.0)) == (True, 1.0)  # the middle stays plain
    for x in ((None, 0.0, 4.0), (1.0, None, 4.0), (1.0, 2.0, 2.0), (float("nan"), 0.0, 1.0)):
        assert tuple(of(*x)) == (False, None)
    assert value(lambda r: s.luminance(r, F.lit(255), F.lit(255)), 255) == pytest.approx(255)


def test_styles_in_turn(spark):
    """The weight is told against the family that was told before, the slant against both; what can't be told is plain."""
    faces = [(f, b, i) for f in ("sans_serif", "serif") for b in (False, True) for i in (False, True)]
    references = [("x", f, b, i, 0.1 + 0.2 * b + 0.5 * (f == "serif"), 10.0 * (f == "serif"), 0.5 * i) for f, b, i in faces] + [("same", f, b, i, 0.1, 1.0, 0.0) for f, b, i in faces]
    refs = spark.createDataFrame(references, "sample string, family string, bold boolean, italic boolean, ink double, serif double, slant double")
    seen = [(1, "x", 0.75, 9.0, 0.4), (2, "x", 0.12, 1.0, 0.0), (3, "x", 0.28, 4.9, 0.25), (4, "same", 0.1, 1.0, 0.0), (5, None, 0.7, 9.0, 0.3), (6, "none", 0.7, 9.0, 0.3)]
    df = spark.createDataFrame(seen, "id int, sample string, ink double, serif double, slant double").withColumn("family", F.lit("clash"))
    got = {r["id"]: (r["family"], r["bold"], r["italic"], r["decided"]) for r in s.font_styles(df, refs, undecided=0.1).collect()}
    assert got[1] == ("serif", True, True, True) and got[2] == ("sans_serif", False, False, True)
    assert got[3] == ("sans_serif", True, False, False)  # the slant lies in the middle, and the family almost
    assert got[4] == got[5] == got[6] == ("sans_serif", False, False, False)
