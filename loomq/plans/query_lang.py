"""The Boolean text query language, compiled to a Column.

Words and signs for "and" bind tighter than those for "or"; parentheses group; everything between is one term, spaces
included. A query that doesn't parse is one literal term. A blank query matches every row, null texts included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operators of the language; the words count only as whole words, in either case.
_OPERATORS = re.compile(r"(?P<open>\()|(?P<close>\))|(?P<and>&&|\b(?:UND|AND)\b)|(?P<or>\|\||\b(?:ODER|OR)\b)", re.IGNORECASE)


@dataclass(frozen=True)
class Node:
    """A term (op is 'term'), or an operator over its parts."""

    op: str
    text: str = ""
    parts: tuple[Node, ...] = ()


class MalformedQuery(ValueError):
    pass


def tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text) pairs; kinds are term, open, close, and, or."""
    found, at = [], 0
    for m in _OPERATORS.finditer(query):
        found += [("term", query[at : m.start()]), (m.lastgroup, m[0])]
        at = m.end()
    found.append(("term", query[at:]))
    return [(kind, text.strip()) for kind, text in found if kind != "term" or text.strip()]


_BINDS = {"and": 2, "or": 1}


def _reduce(operands: list[Node], op: str) -> None:
    right, left = operands.pop(), operands.pop()
    parts = (left.parts if left.op == op else (left,)) + (right,)
    operands.append(Node(op, parts=parts))


def _parse(query: str) -> Node:
    operands: list[Node] = []
    pending: list[str] = []
    operand_next = True
    for kind, text in tokens(query):
        if operand_next != (kind in ("term", "open")):
            raise MalformedQuery(text)
        if kind == "term":
            operands.append(Node("term", text))
            operand_next = False
        elif kind == "open":
            pending.append("open")
        elif kind == "close":
            while pending and pending[-1] != "open":
                _reduce(operands, pending.pop())
            if not pending:
                raise MalformedQuery(text)
            pending.pop()
            # A closed group is one operand, also where its operator is the one outside.
            operands.append(Node("group", parts=(operands.pop(),)))
        else:
            while pending and pending[-1] != "open" and _BINDS[pending[-1]] >= _BINDS[kind]:
                _reduce(operands, pending.pop())
            pending.append(kind)
            operand_next = True
    if operand_next or "open" in pending:
        raise MalformedQuery(query)
    while pending:
        _reduce(operands, pending.pop())
    return operands[0]


def parse(query: str | None) -> Node | None:
    """The query's tree; None if it is blank, a single literal term if it is malformed."""
    query = (query or "").strip()
    if not query:
        return None
    try:
        return _parse(query)
    except MalformedQuery:
        return Node("term", query)


def _compiled(node: Node, lowered: Column) -> Column:
    if node.op == "term":
        return lowered.contains(F.lit(node.text.lower()))
    parts = [_compiled(part, lowered) for part in node.parts]
    return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)


def matches(text: Column, query: str | None) -> Column:
    """Whether a text matches; a blank query doesn't refer to the text at all, so Spark never reads it."""
    node = parse(query)
    return F.lit(True) if node is None else F.coalesce(_compiled(node, F.lower(text)), F.lit(False))
