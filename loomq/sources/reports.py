"""Reports as documents: HTML of candidate groups with what differs in them, an index of reports, Word files of comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.functions.text import escape
from loomq.operators.dedupe import candidate_pairs
from loomq.session import expose_package

#: Unchanged lines that are shown around a change.
CONTEXT = 3
#: Links on one page of an index.
LINKS = 1000
STYLE = "body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:2px 6px;vertical-align:top}.differs,.old{background:#fdd}.new{background:#dfd}"


def _page(title: Column, body: Column) -> Column:
    head = F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), title, F.lit(f"</title><style>{STYLE}</style></head><body>\n<h1>"), title, F.lit("</h1>\n"))
    return F.concat(head, body, F.lit("\n</body></html>\n"))


def candidate_tables(candidates: DataFrame, fields: Mapping[str, str], name: str = "name") -> DataFrame:
    """group_id and table: HTML with a column for each candidate and a row for each field (label -> column), in order.

    A row whose values differ among readable candidates is marked; what is missing is a dash. Errors have a row of their
    own where there are some, and an unreadable candidate's values are dashes. A group is a handful of files.
    """

    def shown(c: str) -> Column:
        value = F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("-"))
        return F.when(F.col("error").isNull(), value).otherwise(F.lit("-"))

    columns = {f"f{n}": shown(c) for n, c in enumerate(fields.values())}
    rows = F.sort_array(F.collect_list(F.struct("idx", escape(F.col(name)).alias("name"), F.col("error").alias("error"), *[v.alias(k) for k, v in columns.items()])))
    grouped = candidates.groupBy("group_id").agg(rows.alias("c"))

    lines = [F.concat(F.lit("<tr><th></th>"), F.array_join(F.transform("c", lambda x: F.concat(F.lit("<th>"), x["name"], F.lit("</th>"))), ""), F.lit("</tr>"))]
    failed = F.concat(F.lit("<tr><th>error</th>"), F.array_join(F.transform("c", lambda x: F.concat(F.lit("<td>"), F.coalesce(escape(x["error"]), F.lit("-")), F.lit("</td>"))), ""), F.lit("</tr>"))
    lines.append(F.when(F.exists("c", lambda x: x["error"].isNotNull()), failed))
    for n, label in enumerate(fields):
        values = F.transform("c", lambda x: x[f"f{n}"])  # noqa: B023 - looked up at once
        readable = F.transform(F.filter("c", lambda x: x["error"].isNull()), lambda x: x[f"f{n}"])  # noqa: B023
        opened = F.when(F.size(F.array_distinct(readable)) > 1, "<td class='differs'>").otherwise("<td>")
        own = F.array_join(F.transform(values, lambda v: F.concat(opened, escape(v), F.lit("</td>"))), "")  # noqa: B023
        lines.append(F.concat(F.lit(f"<tr><th>{label}</th>"), own, F.lit("</tr>")))
    return grouped.select("group_id", F.concat(F.lit("<table>\n"), F.concat_ws("\n", *lines), F.lit("\n</table>")).alias("table"))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def changed_lines(left: list[str], right: list[str], context: int = CONTEXT) -> list[tuple[str, str, str]]:
    """(kind, left line, right line) of what differs, with some equal lines around; kinds are same, old, new and gap."""
    out: list[tuple[str, str, str]] = []
    for n, group in enumerate(SequenceMatcher(None, left, right, autojunk=False).get_grouped_opcodes(context)):
        out += [("gap", "", "")] * bool(n)
        for kind, a, b, c, d in group:
            if kind == "equal":
                out += [("same", x, y) for x, y in zip(left[a:b], right[c:d])]
            else:
                out += [("old", x, "") for x in left[a:b]] + [("new", "", y) for y in right[c:d]]
    return out


def line_changes(left: Column, right: Column) -> Column:
    """An HTML table of the lines that differ between two texts; empty if none does."""

    def rows(a: str | None, b: str | None) -> str:
        shown = {"gap": "<tr><td colspan='2'>…</td></tr>"}
        found = changed_lines((a or "").splitlines(), (b or "").splitlines())
        lines = [shown.get(k) or f"<tr><td class='{k}'>{_escaped(x)}</td><td class='{k}'>{_escaped(y)}</td></tr>" for k, x, y in found]
        return "<table>\n" + "\n".join(lines) + "\n</table>" if lines else ""

    def convert(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([rows(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())

    return F.arrow_udf(convert, "string")(left, right)


def group_reports(candidates: DataFrame, similarities: DataFrame, fields: Mapping[str, str], name: str = "name") -> DataFrame:
    """group_id, name (of the file) and content: one HTML report for each group of candidates.

    similarities: group_id, i, j, similarity (null: unknown). A report has the candidates' table, links to its pairs
    where there are several, and for each pair of readable candidates its similarity and the lines that differ.
    """
    expose_package(candidates.sparkSession)
    named = candidates.select("group_id", "idx", escape(F.col(name)).alias("shown"))
    left, right = (named.select("group_id", F.col("idx").alias(k), F.col("shown").alias(f"name_{k}")) for k in ("i", "j"))
    pairs = candidate_pairs(candidates).join(similarities.select("group_id", "i", "j", "similarity"), ["group_id", "i", "j"], "left").join(left, ["group_id", "i"]).join(right, ["group_id", "j"])
    share = F.coalesce(F.concat(F.format_number(F.col("similarity") * 100, 1), F.lit("%")), F.lit("n/a"))
    anchor = F.concat_ws("-", F.lit("pair"), F.col("i").cast("string"), F.col("j").cast("string"))
    title = F.concat("name_i", F.lit(" &harr; "), "name_j", F.lit(" ("), share, F.lit(")"))
    link = F.concat(F.lit("<li><a href='#"), anchor, F.lit("'>"), title, F.lit("</a></li>"))
    section = F.concat(F.lit("<h2 id='"), anchor, F.lit("'>"), title, F.lit("</h2>\n"), line_changes(F.col("left"), F.col("right")))
    listed = pairs.select("group_id", "i", "j", link.alias("link"), section.alias("section")).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "link", "section"))).alias("p"))
    joined = candidate_tables(candidates, fields, name).join(listed, "group_id", "left")
    links = F.when(F.size("p") > 1, F.concat(F.lit("<ul>\n"), F.array_join(F.transform("p", lambda x: x["link"]), "\n"), F.lit("\n</ul>")))
    body = F.concat_ws("\n", "table", links, F.array_join(F.transform("p", lambda x: x["section"]), "\n"))
    group = escape(F.col("group_id").cast("string"))
    return joined.select("group_id", F.concat(F.lit("group-"), F.regexp_replace(F.col("group_id").cast("string"), r"[^\p{L}\p{N}_-]", "_"), F.lit(".html")).alias("name"), _page(F.concat(F.lit("Group "), group), body).alias("content"))


def index_pages(reports: DataFrame, order: Sequence[str], name: str = "name", title: str = "Reports", links: int = LINKS) -> DataFrame:
    """page (from 0), name and content: HTML pages that link to reports in an order without ties, so many on each."""
    from loomq.operators.prefix import places

    placed = places(reports.select(*order, F.col(name).alias("__name")), [F.col(c) for c in order], "__place").withColumn("page", F.floor((F.col("__place") - 1) / links).cast("int"))
    link = F.concat(F.lit("<li><a href='"), escape(F.col("__name")), F.lit("'>"), escape(F.col("__name")), F.lit("</a></li>"))
    grouped = placed.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__place", link.alias("link")))), lambda x: x["link"]), "\n").alias("list"))
    shown = F.concat(F.lit(f"{title} "), (F.col("page") + 1).cast("string"))
    return grouped.select("page", F.concat(F.lit("index-"), F.col("page").cast("string"), F.lit(".html")).alias("name"), _page(shown, F.concat(F.lit("<ul>\n"), "list", F.lit("\n</ul>"))).alias("content"))


def comparison_word(entries: DataFrame, providers: Sequence[str], head: Mapping[str, str], key: str = "doc_id", order: Sequence[str] = ("page_index", "y0", "place")) -> DataFrame:
    """key, name and content: one Word file for each document with its original texts and every provider's translation.

    entries: key, order, page_index, text and one column a provider. Blocks are numbered within their document and parted
    by lines; line breaks become spaces.
    """
    from loomq.sources.office import word_bytes

    expose_package(entries.sparkSession)
    flat = [F.translate(F.coalesce(F.col(c), F.lit("")), "\n", " ").alias(c) for c in ("text", *providers)]
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], (F.col("page_index") + 1).cast("int").alias("page"), *flat)))
    grouped = entries.groupBy(key).agg(F.transform(rows, lambda r: F.struct(r["page"], *[r[c] for c in ("text", *providers)])).alias("blocks"))
    first = [f"{k}: {v}" for k, v in head.items()]

    def write(column: pa.Array) -> pa.Array:
        files = []
        for blocks in column.to_pylist():
            body = [*first]
            for n, block in enumerate(blocks, 1):
                page, original, *translations = block.values()
                body += ["---", f"{n} (page {page})", original]
                body += [x for p, t in zip(providers, translations) for x in (f"{p}:", t)]
            files.append(word_bytes({"body": body}))
        return pa.array(files, pa.binary())

    named = F.concat(F.lit("comparison-"), F.col(key).cast("string"), F.lit(".docx"))
    return grouped.select(key, named.alias("name"), F.arrow_udf(write, "binary")("blocks").alias("content"))
