"""Natural order, stable sorts, page selections and ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """A sortable key: digit runs compare as whole numbers of any length, other runs in lower case, digits first."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def part(run: Column) -> Column:
        digits = run.rlike("^[0-9]")
        number = F.regexp_replace(run, "^0+(?=.)", "")
        size = F.when(digits, F.length(number)).otherwise(0)
        return F.struct((~digits).alias("is_text"), size.alias("size"), F.when(digits, number).otherwise(run).alias("run"))

    return F.transform(runs, part)


def stable_order(df: DataFrame, key: Column, ordinal: str, descending: bool = False) -> DataFrame:
    """Sorted by a key; equal keys keep the order of the ordinal, also where the key descends."""
    return df.orderBy(key.desc() if descending else key.asc(), F.col(ordinal).asc())


def slide_key(path: Column) -> list[Column]:
    """Slides by the number that all the digits of their file's stem make, then by path."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    digits = F.regexp_replace(stem, "[^0-9]", "")
    return [F.when(digits == "", F.lit(0)).otherwise(digits.cast("decimal(38,0)")), path]


def move(df: DataFrame, ordinal: str, at: int, by: int) -> DataFrame:
    """Swap the row at a place with its neighbour (by is 1 or -1); a place at the edge stays."""
    last, target = df.agg(F.max(ordinal)).first()[0], at + by
    if last is None or not 0 <= target <= last:
        return df
    swapped = F.when(F.col(ordinal) == at, F.lit(target)).when(F.col(ordinal) == target, F.lit(at)).otherwise(F.col(ordinal))
    return df.withColumn(ordinal, swapped.cast("long"))


#: What a page selection's errors say.
NO_PAGES, NOT_A_NUMBER, OUT_OF_RANGE, NOTHING = "document has no pages", "not a page number", "page out of range", "selects no page"


def page_selection(spec: Column, n_pages: Column) -> Column:
    """A struct of pages (numbers from 0 in the order asked for, repeats kept) and error (null if there is none).

    A blank specification is every page. Its tokens are N, N-M (descending if M < N), N- and -M.
    """
    text = F.trim(F.regexp_replace(F.coalesce(spec, F.lit("")), r"(?U)\s+", " "))
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")

    def bounds(token: Column) -> Column:
        number = token.rlike(r"^[0-9]+$")
        dash = token.rlike(r"^[0-9]* ?- ?[0-9]*$") & (F.regexp_replace(token, "[ -]", "") != "")
        left = F.regexp_extract(token, r"^([0-9]*)", 1)
        right = F.regexp_extract(token, r"([0-9]*)$", 1)
        first = F.when(number | (left != ""), left.try_cast("int")).when(dash, F.lit(1))
        last = F.when(number, left.try_cast("int")).when(right != "", right.try_cast("int")).when(dash, n_pages.cast("int"))
        return F.struct(F.when(number | dash, first).alias("a"), F.when(number | dash, last).alias("b"))

    found = F.transform(tokens, bounds)
    bad = F.exists(found, lambda x: x["a"].isNull() | x["b"].isNull())
    outside = F.exists(found, lambda x: (F.least(x["a"], x["b"]) < 1) | (F.greatest(x["a"], x["b"]) > n_pages))
    error = F.when(text == "", F.lit(None)).when(n_pages < 1, F.lit(NO_PAGES)).when(F.size(tokens) == 0, F.lit(NOTHING)).when(bad, F.lit(NOT_A_NUMBER)).when(outside, F.lit(OUT_OF_RANGE))
    every = F.when(n_pages > 0, F.sequence(F.lit(0), F.greatest(n_pages.cast("int"), F.lit(1)) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    chosen = F.flatten(F.transform(found, lambda x: F.sequence(x["a"] - 1, x["b"] - 1)))
    pages = F.when(error.isNull(), F.when(F.size(tokens) == 0, every).otherwise(chosen))
    return F.struct(pages.alias("pages"), error.alias("error"))


def history(df: DataFrame, query: str, used: str, most: int = 20) -> DataFrame:
    """The latest queries first, each once, blank ones left out and cut to a length: what a search box offers again."""
    text = F.trim(F.col(query))
    kept = df.filter(text != "").groupBy(text.alias(query)).agg(F.max(used).alias(used))
    return kept.orderBy(F.desc(used), query).limit(most)
