"""Writing results: files from executors, logs, and reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomq.session import expose_package


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content", overwrite: bool = False) -> None:
    """One file for each row, written by the executors below a folder that they share.

    A file that is there already is an error unless overwrite is set; a task that runs again writes the same bytes.
    """
    expose_package(df.sparkSession)

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for row in rows:
            path = f"{root}/{row[name]}"
            data = bytes(row[content]) if not isinstance(row[content], str) else row[content].encode("utf-8")
            if not overwrite and system.get_file_info(path).type != fs.FileType.NotFound and system.open_input_file(path).read() != data:
                raise FileExistsError(path)
            with system.open_output_stream(path) as out:
                out.write(data)

    df.select(name, content).foreachPartition(write)


def append_log(df: DataFrame, folder: str) -> None:
    """Rows as lines of JSON, added to what is there: growth and break anomalies, errors, fallbacks."""
    df.write.mode("append").json(folder)


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a Markdown table for each row, in the frame's order."""
    cells = [F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def html_row(columns: list[Column]) -> Column:
    """A row of an HTML table with escaped cells."""
    from loomq.functions.text import escape

    cells = [F.concat(F.lit("<td>"), escape(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def run_report(outcomes: DataFrame) -> DataFrame:
    """The counts of a run and its errors, one row: total, translated, skipped, failed, characters, errors."""
    counted = [F.count_if(F.col("status") == s).alias(s) for s in ("translated", "skipped", "failed")]
    errors = F.array_sort(F.collect_set(F.col("error")))
    return outcomes.agg(F.count(F.lit(1)).alias("total"), *counted, F.coalesce(F.sum("chars_sent"), F.lit(0)).alias("characters"), errors.alias("errors"))


def qa_report(stats: DataFrame, head: dict[str, str], order: str = "doc_id") -> DataFrame:
    """One text for each row of page_stats(): a document's outcome, its overflowing blocks and its errors, line by line."""
    lines = F.concat(
        F.array(*[F.lit(f"{k}: {v}") for k, v in head.items()], F.lit("")),
        F.array(*[F.concat(F.lit(f"  {label}: "), F.col(c).cast("string")) for label, c in (
            ("blocks translated", "translated"), ("blocks skipped", "skipped"), ("blocks failed", "failed"), ("characters sent", "chars_sent"),
            ("blocks that overflow", "overflow_blocks"),
        )], F.lit("")),
        F.when(F.size("errors") > 0, F.concat(F.array(F.lit("failed blocks:")), F.transform("errors", lambda e: F.concat(F.lit("  - "), e)))).otherwise(F.array(F.lit("no failed blocks"))),
    )
    return stats.select(order, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("report"))


def correction_report(regions: DataFrame, keys: list[str], order: str, head: dict[str, str]) -> DataFrame:
    """One JSON text for each image: what a correction drew, in a form that the next correction reads."""
    listed = F.array_sort(F.collect_list(F.struct(order, *[c for c in regions.columns if c not in (*keys, order)])))
    given = [F.lit(v).alias(k) for k, v in head.items()]
    return regions.groupBy(*keys).agg(listed.alias("regions")).select(*keys, F.to_json(F.struct(*given, *keys, "regions")).alias("report"))


def comparison_report(entries: DataFrame, providers: list[str], order: list[str]) -> DataFrame:
    """Markdown of a provider comparison, one text for each entry (page_index, text, one column a provider), in order."""
    from loomq.operators.prefix import places

    placed = places(entries, [F.col(c) for c in order], "paragraph")
    quoted = F.concat(F.lit("> "), F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit("\n> ")))
    cells = [F.concat(F.lit(f"| {p} | "), F.replace(F.replace(F.coalesce(F.col(p), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")), F.lit(" |")) for p in providers]
    head = F.concat(F.lit("## "), F.col("paragraph").cast("string"), F.lit(" (page "), (F.col("page_index") + 1).cast("string"), F.lit(")"))
    body = F.concat_ws("\n", head, F.lit(""), quoted, F.lit(""), F.lit("| provider | translation |"), F.lit("|-|-|"), *cells, F.lit(""))
    return placed.select("paragraph", body.alias("report")).orderBy("paragraph")
