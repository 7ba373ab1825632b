"""Searching documents: scopes, the Boolean query, date filters, order and the pages to merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.functions.dates import DateFilter
from loomq.functions.ordering import natural_key, stable_order
from loomq.plans.query_lang import matches

#: The scopes a text may be searched in, in the order they are joined, the default, and date regions.
SCOPES = ("ico_format", "header", "full_text")
DEFAULT_SCOPES = ("ico_format",)
DATE_REGIONS = ("ico_format", "header", "footer", "full_text")


def scope_text(scopes: Sequence[str], known: Sequence[str] = SCOPES) -> Column:
    """The texts of the chosen scopes, empty ones left out, joined by new lines; null if there is none."""
    chosen = [F.nullif(F.col(s), F.lit("")) for s in known if s in set(scopes)]
    return F.nullif(F.concat_ws("\n", *chosen), F.lit("")) if chosen else F.lit(None).cast("string")


def search(docs: DataFrame, query: str | None, scopes: Sequence[str] = DEFAULT_SCOPES, dates: DateFilter | None = None, modified: str = "mtime") -> DataFrame:
    """The rows that match a query in some scopes and pass a date filter, with snippet.

    A query may span scopes. A blank query takes every row without reading a text, and its snippet is empty.
    """
    text = scope_text(scopes)
    is_blank = not (query or "").strip()
    found = docs if is_blank else docs.filter(matches(text, query))
    if dates is not None and dates.days.bounded:
        found = found.filter(dates.predicate(F.col(modified), scope_text(dates.regions, DATE_REGIONS) if dates.source == "document" else None))
    return found.withColumn("snippet", F.lit("") if is_blank else first_line(text))


def first_line(text: Column, length: int = 80) -> Column:
    return F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, length)


def sorted_results(found: DataFrame, by: str = "name", descending: bool = False, ordinal: str = "ordinal", modified: str = "mtime") -> DataFrame:
    """By natural name or by time; a vanished file counts as the oldest; equal ones keep their order."""
    key = natural_key(F.col("name")) if by == "name" else F.coalesce(F.col(modified).cast("timestamp"), F.lit(0).cast("timestamp"))
    return stable_order(found, key, ordinal, descending)
