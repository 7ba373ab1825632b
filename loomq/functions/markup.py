"""Paragraphs as small HTML for a translator, and back with checks."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.functions.text import escape, has_words

#: Fixed value: stands for a space next to a break, which a translator would drop.
SPACE_MARK = "§§SP§§"
BREAK = "\n"


def paragraph_html(runs: Column) -> Column:
    """A Word paragraph's runs (see sources.office) as HTML; images and links carry their run's number."""

    def shown(run: Column, i: Column) -> Column:
        number = i.cast("string")
        before = (i > 0) & (F.get(runs, i - 1)["text"] == BREAK)
        after = F.coalesce(F.get(runs, i + 1)["text"] == BREAK, F.lit(False))
        text = run["text"]
        text = F.when(before & text.startswith(" "), F.concat(F.lit(SPACE_MARK), F.substring(text, 2, 1 << 30))).otherwise(text)
        text = F.when(after & text.endswith(" "), F.concat(F.regexp_replace(text, " $", ""), F.lit(SPACE_MARK))).otherwise(text)
        out = escape(text)
        for flag, tag in (("underline", "u"), ("italic", "i"), ("bold", "b")):
            out = F.when(run[flag], F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
        linked = F.concat(F.lit('<a data-run="'), number, F.lit('">'), out, F.lit("</a>"))
        image = F.concat(F.lit('<img data-run="'), number, F.lit('"/>'))
        return F.when(run["is_image"], image).when(run["text"] == BREAK, "<br/>").when(run["text"] == "", "").when(run["is_hyperlink"], linked).otherwise(out)

    return F.array_join(F.transform(runs, shown), "")


def slide_html(texts: Column, breaks: Column | None = None) -> Column:
    """A slide paragraph's run texts as numbered spans, runs without words left out; breaks are run positions."""

    def span(text: Column, i: Column) -> Column:
        number = i.cast("string")
        return F.when(has_words(text), F.concat(F.lit('<span data-run="'), number, F.lit('">'), escape(text, quotes=False), F.lit("</span>"))).otherwise("")

    spans = F.transform(texts, span)
    if breaks is None:
        return F.array_join(spans, "")

    def before(at: Column) -> Column:
        own = F.filter(F.transform(breaks, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda b: b["p"] == at)
        return F.array_join(F.transform(own, lambda b: F.concat(F.lit('<br data-break="'), b["k"].cast("string"), F.lit('"/>'))), "")

    return F.concat(F.array_join(F.transform(spans, lambda s, i: F.concat(before(i), s)), ""), before(F.size(texts)))


class _Reader(HTMLParser):
    """The runs of translated HTML, the marks found in it, and text outside of spans."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.link: list[str] = []
        self.marks: dict[str, list[str]] = {"img": [], "a": [], "span": [], "br": []}
        self.runs: list[dict] = []
        self.spans: list[list[str]] = []
        self.stray = ""

    def handle_starttag(self, tag, attrs):
        mark = dict(attrs).get("data-run") or dict(attrs).get("data-break") or ""
        if tag in self.marks:
            self.marks[tag].append(mark)
        if tag == "img":
            if self.runs and self.runs[-1]["text"] != BREAK:
                self._run(BREAK)
            self.runs.append({"text": "", "image": mark, "link": None, "bold": False, "italic": False, "underline": False})
        elif tag == "br":
            self._run(BREAK)
        else:
            self.open.append(tag)
            if tag == "a":
                self.link.append(mark)
            if tag == "span":
                self.spans.append([mark, ""])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ("img", "br"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if tag == "a":
                self.link.pop()

    def handle_data(self, data):
        if "span" in self.open:
            self.spans[-1][1] += data
        else:
            self.stray += data
        self._run(data.replace(SPACE_MARK, " "))

    def _run(self, text: str):
        look = {name: tag in self.open for name, tag in (("bold", "b"), ("italic", "i"), ("underline", "u"))}
        self.runs.append({"text": text, "image": None, "link": self.link[-1] if self.link else None, **look})


def read_markup(markup: str) -> _Reader:
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    return reader


_PARSED = pa.struct(
    [("error", pa.string()), ("break_change", pa.int32())]
    + [("runs", pa.list_(pa.struct([("text", pa.string()), ("image", pa.string()), ("link", pa.string())] + [(c, pa.bool_()) for c in ("bold", "italic", "underline")])))]
)
_PARSED_DDL = "struct<error:string,break_change:int,runs:array<struct<text:string,image:string,link:string,bold:boolean,italic:boolean,underline:boolean>>>"


def _parse_paragraphs(translated: pa.Array, original: pa.Array) -> pa.Array:
    out = []
    for new, old in zip(translated.to_pylist(), original.to_pylist()):
        if new is None or old is None:
            out.append(None)
            continue
        a, b = read_markup(new), read_markup(old)
        lost = [t for t in ("img", "a") if sorted(a.marks[t]) != sorted(b.marks[t])]
        error = f"<{lost[0]}> marks changed" if lost else None
        out.append({"error": error, "break_change": len(a.marks["br"]) - len(b.marks["br"]), "runs": [] if error else a.runs})
    return pa.array(out, _PARSED)


def parse_paragraph(translated: Column, original: Column) -> Column:
    """struct(error, break_change, runs) of translated paragraph HTML, held against the original's.

    Images and links have to come back, each once; breaks may change, which is counted.
    """
    return F.arrow_udf(_parse_paragraphs, _PARSED_DDL)(translated, original)


_SPANS = pa.struct([("error", pa.string()), ("texts", pa.map_(pa.int32(), pa.string()))])


def _parse_spans(translated: pa.Array, original: pa.Array) -> pa.Array:
    out = []
    for new, old in zip(translated.to_pylist(), original.to_pylist()):
        if new is None or old is None:
            out.append(None)
            continue
        a, b = read_markup(new), read_markup(old)
        if a.marks["span"] != b.marks["span"] or a.marks["br"] != b.marks["br"]:
            out.append({"error": "marks changed", "texts": []})
        elif a.stray.strip():
            out.append({"error": "text outside of marks", "texts": []})
        else:
            out.append({"error": None, "texts": [(int(n), text) for n, text in a.spans]})
    return pa.array(out, _SPANS)


def parse_spans(translated: Column, original: Column) -> Column:
    """struct(error, texts by run) of a translated slide paragraph; its marks have to come back in order."""
    return F.arrow_udf(_parse_spans, "struct<error:string,texts:map<int,string>>")(translated, original)


def dominant(looks: DataFrame, keys: Sequence[str], look: str, order: str) -> DataFrame:
    """The most frequent look of a group; among equally frequent ones the one seen first."""
    counts = looks.groupBy(*keys, look).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(look, F.struct("n", (-F.col("first")).alias("f"))).alias(look))
