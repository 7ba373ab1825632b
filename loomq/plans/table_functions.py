"""The query language in SQL: queries as SQL functions that Catalyst sees through, and a table function for any table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from loomq.plans.query_lang import Node, parse
from loomq.session import expose_package

ADDED = ("place", "snippet")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def predicate_sql(query: str | None, text: str) -> str:
    """A query as SQL over an expression for a text, the same as query_lang.matches() makes as a column."""
    node = parse(query)
    if node is None:
        return "true"

    def compiled(n: Node) -> str:
        if n.op == "term":
            return f"contains(lower({text}), {_quoted(n.text.lower())})"
        return "(" + f" {n.op.upper()} ".join(compiled(part) for part in n.parts) + ")"

    return f"coalesce({compiled(node)}, false)"


def register_query(spark: SparkSession, name: str, query: str | None) -> None:
    """A temporary SQL function name(text) that says whether a text matches; plans show its terms, not a call."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a function's name: {name!r}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(searched STRING) RETURNS BOOLEAN RETURN {predicate_sql(query, 'searched')}")


def holds(node: Node | None, lowered: str) -> bool:
    """The same in Python, over a text in lower case."""
    if node is None:
        return True
    if node.op == "term":
        return node.text.lower() in lowered
    return (all if node.op == "and" else any)(holds(part, lowered) for part in node.parts)


@dataclass
class _Planned(AnalyzeResult):
    """What planning settles for all tasks: the parsed query, the scopes' places in a row, and the most hits."""

    node: Node | None = None
    scopes: list[int] = field(default_factory=list)
    most: int | None = None


class SearchTable:
    """search_table(TABLE(t) PARTITION BY … ORDER BY …, query, scopes [, most]): the rows of any table that match.

    The table's columns come back with place, the number of a match within its partition, from 1 in its order, and
    snippet, the text's first line; tables that have such columns are refused. scopes is a comma-separated list of text
    columns, joined by new lines without empty ones. With most, a partition ends after so many matches. A blank query
    matches every row and has empty snippets. The query is parsed when the statement is planned, and what is wrong with
    the arguments is told there. Without PARTITION BY Spark deals the rows as it likes and places count within a task.
    """

    def __init__(self, planned: _Planned):
        self.planned, self.found = planned, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, query: AnalyzeArgument, scopes: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable or query.isTable or scopes.isTable:
            raise ValueError("the first argument has to be a table, the others constants")
        if not isinstance(scopes.value, str) or not (query.value is None or isinstance(query.value, str)):
            raise ValueError("query and scopes have to be constant texts")
        if most is not None and not (isinstance(most.value, int) and most.value > 0):
            raise ValueError("most has to be a positive whole number")
        names = rows.dataType.names
        wanted = [s.strip() for s in scopes.value.split(",") if s.strip()]
        for s in wanted:
            if s not in names or not isinstance(rows.dataType[s].dataType, StringType):
                raise ValueError(f"no text column {s!r}; the table has {', '.join(names)}")
        if clash := [n for n in ADDED if n in names]:
            raise ValueError(f"the table has columns of its own named {', '.join(clash)}")
        schema = StructType([*rows.dataType.fields]).add("place", IntegerType()).add("snippet", StringType())
        return _Planned(schema=schema, node=parse(query.value), scopes=[names.index(s) for s in wanted], most=most.value if most is not None else None)

    def eval(self, row, query, scopes, most=None) -> Iterator[tuple]:
        plan = self.planned
        if plan.most is not None and self.found >= plan.most:
            return
        text = "\n".join(row[i] for i in plan.scopes if row[i])
        if plan.node is not None and (not text or not holds(plan.node, text.lower())):
            return
        self.found += 1
        yield (*row, self.found, text.split("\n", 1)[0][:80] if plan.node is not None else "")


def register_search_table(spark: SparkSession) -> None:
    """Make search_table() known to a session's SQL."""
    expose_package(spark)
    spark.udtf.register("search_table", udtf(SearchTable))
