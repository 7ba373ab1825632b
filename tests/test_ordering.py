import re

import pytest
from pyspark.sql import functions as F

from loomq.functions import ordering


def _python_key(name):
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"([0-9]+)", name)]


@pytest.mark.parametrize(
    "names",
    [
        ["1747 ABSENCE", "1750 ANEMNESIS", "1759 IDEOGENESIS", "176 ChinaAMC"],
        ["020 b", "003 a", "100 c"],
        ["a2b10", "a2b9", "a10b1"],
        ["Bravo", "alpha"],
        ["x", "1", "x1", "1x", "", "007", "7a", "123456789012345678901234567890123456789012", "99999"],
    ],
)
def test_natural_order(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["name"] for r in df.orderBy(ordering.natural_key(F.col("name"))).collect()]
    assert got == sorted(names, key=_python_key)


def test_stable_order_descending(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "B"), (3, "c")], "ordinal int, name string")
    got = [r["ordinal"] for r in ordering.stable_order(df, ordering.natural_key(F.col("name")), "ordinal", descending=True).collect()]
    assert got == [3, 0, 2, 1]


@pytest.mark.parametrize(
    ("spec", "pages"),
    [
        ("", [0, 1, 2, 3, 4]), (None, [0, 1, 2, 3, 4]), ("1-3", [0, 1, 2]), ("3-1", [2, 1, 0]), ("2,4", [1, 3]), ("3-", [2, 3, 4]), ("-2", [0, 1]),
        (" 1 , 2 - 3 ", [0, 1, 2]), ("1,1", [0, 0]),
    ],
)
def test_page_selection(value, spec, pages):
    got = value(lambda s: ordering.page_selection(s, F.lit(5)), (spec, "string"))
    assert (got["pages"], got["error"]) == (pages, None)


@pytest.mark.parametrize(("spec", "n"), [("0", 5), ("6", 5), ("abc", 5), ("1-6", 5), ("1", 0), (",", 5), ("-", 5), ("1-2-3", 5)])
def test_page_selection_errors(value, spec, n):
    got = value(lambda s: ordering.page_selection(s, F.lit(n)), spec)
    assert got["pages"] is None and got["error"]


def test_history(spark):
    rows = [("a", 1), (" a ", 5), ("", 9), ("b", 3)] + [(f"q{i}", -i) for i in range(30)]
    got = [r["query"] for r in ordering.history(spark.createDataFrame(rows, "query string, used int"), "query", "used").collect()]
    assert got[:2] == ["a", "b"] and len(got) == 20 and "" not in got


def test_move(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal long, name string")
    assert [r["name"] for r in ordering.move(df, "ordinal", 0, 1).orderBy("ordinal").collect()] == ["b", "a", "c"]
    assert [r["name"] for r in ordering.move(df, "ordinal", 0, -1).orderBy("ordinal").collect()] == ["a", "b", "c"]
