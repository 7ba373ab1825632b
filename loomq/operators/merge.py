"""Ordered merging of documents: selected pages, tables of contents, batches, terms and edits."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.functions.ordering import page_selection
from loomq.functions.text import casefold, stripped
from loomq.operators.prefix import totals_before
from loomq.session import expose_package

#: Documents that one step of a two-level merge takes.
BATCH = 100


def selected_pages(sources: DataFrame) -> DataFrame:
    """One row for each page of a merge: seq, path, source_page (from 0) and output_page (from 0).

    sources: seq, path, spec, n_pages. A wrong specification is an error that names the file. The number of pages
    before a source is a running total over one row a source; the pages themselves need no sort.
    """
    chosen = page_selection(F.col("spec"), F.col("n_pages"))
    pages = F.when(F.col("c.error").isNull(), F.col("c.pages")).otherwise(F.raise_error(F.concat_ws(": ", "path", F.col("c.error"))).cast("array<int>"))
    listed = sources.withColumn("c", chosen).withColumn("pages", pages).withColumn("n_selected", F.size("pages").cast("long"))
    placed = totals_before(listed.drop("c"), "n_selected", "seq")
    one = placed.select("seq", "path", "offset", F.posexplode("pages").alias("place", "source_page"))
    return one.select("seq", "path", F.col("source_page").cast("long").alias("source_page"), (F.col("offset") + F.col("place")).cast("long").alias("output_page"))


def contents(sources: DataFrame, toc: DataFrame) -> DataFrame:
    """The merged table of contents: seq, level, title, page (from 1).

    toc: seq, entry, level, title, page (from 1). A source without one gets an entry with its name, and its
    specification if it is only a part; a source without pages gets none.
    """
    chosen = page_selection(F.col("spec"), F.col("n_pages"))
    sized = totals_before(sources.withColumn("c", chosen).withColumn("n_selected", F.size("c.pages").cast("long")), "n_selected", "seq")
    own = sized.join(toc.select("seq", "entry", "level", "title", F.col("page").alias("at")), "seq")
    kept = own.select("seq", F.col("entry").cast("long").alias("entry"), "level", "title", (F.col("at") + F.col("offset")).cast("long").alias("page"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    every = F.col("c.pages") == F.sequence(F.lit(0), F.greatest(F.col("n_pages").cast("int"), F.lit(1)) - 1)
    label = F.when(every, name).otherwise(F.concat(name, F.lit(" ("), F.col("spec"), F.lit(")")))
    bare = sized.join(toc.select("seq").distinct(), "seq", "left_anti").filter("n_selected > 0")
    added = bare.select("seq", F.lit(0).cast("long").alias("entry"), F.lit(1).alias("level"), label.alias("title"), (F.col("offset") + 1).cast("long").alias("page"))
    return kept.unionByName(added).select("seq", "entry", "level", "title", "page")


def merge_stats(sources: DataFrame) -> DataFrame:
    """segments, files_processed (distinct paths), pages_written and batches of a two-level merge (0 if one will do)."""
    sized = sources.withColumn("n", F.size(page_selection(F.col("spec"), F.col("n_pages"))["pages"]))
    n = F.count(F.lit(1))
    return sized.agg(
        n.alias("segments"), F.countDistinct("path").alias("files_processed"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pages_written"),
        F.when(n <= BATCH, F.lit(0)).otherwise(F.ceil(n / BATCH)).cast("long").alias("batches"),
    )


def source_errors(sources: DataFrame) -> DataFrame:
    """All errors of a merge's sources at once instead of the first: seq, path and errors."""
    chosen = page_selection(F.col("spec"), F.col("n_pages"))
    errors = F.array_compact(F.array(F.when(stripped(F.coalesce(F.col("path"), F.lit(""))) == "", F.lit("no file")), F.when(~F.col("exists"), F.lit("file is missing")), chosen["error"]))
    return sources.select("seq", "path", errors.alias("errors")).filter(F.size("errors") > 0)


def first_spellings(terms: DataFrame, term: str, order: str) -> DataFrame:
    """Each term once, case aside, with the spelling that comes first; blank ones are left out.

    Spellings are reduced to their first place before they are folded, so folding sees each once. An order of a number
    type keeps that reduction in a hash aggregation.
    """
    own = terms.select(stripped(F.col(term)).alias(term), F.col(order).alias(order)).filter(F.col(term) != "")
    spelt = own.groupBy(term).agg(F.min(order).alias(order))
    first = spelt.groupBy(casefold(F.col(term)).alias("key")).agg(F.min(F.struct(order, term)).alias("m"))
    return first.select("key", F.col(f"m.{term}").alias(term), F.col(f"m.{order}").alias(order))


def added_terms(existing: DataFrame, new: DataFrame, term: str, order: str) -> DataFrame:
    """Existing terms as they are, duplicates included, then the new ones that aren't there yet, each once."""
    old = existing.select(stripped(F.col(term)).alias(term), F.lit(0).alias("side"), F.col(order).alias(order)).filter(F.col(term) != "")
    fresh = first_spellings(new, term, order).join(old.select(casefold(F.col(term)).alias("key")).distinct(), "key", "left_anti")
    return old.unionByName(fresh.select(term, F.lit(1).alias("side"), order)).orderBy("side", order).select(term)


def apply_edits(records: DataFrame, edits: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Records with the edits' values; an edit of null counts, a missing edit doesn't; unknown keys are ignored.

    edits has, for each column c, the column has_c that says whether there is an edit of it.
    """
    marked = edits.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], *[F.col(f"has_{c}") for c in columns])
    joined = records.join(marked, list(keys), "left")
    changed = {c: F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in records.columns])


#: A name before its extension, and the extension; a name that only begins with a dot has none.
_NAME = r"(?s)^(.+?)(\.[^.]+)?$"
_NUMBER = re.compile(r"(?s)(.*) \(([2-9]|[1-9][0-9]+)\)")


def safe_name(name: Column, extension: str = "") -> Column:
    """A name without path separators and with the extension; a blank or null one is unbenannt."""
    clean = stripped(F.translate(F.coalesce(name, F.lit("")), "/\\", "__"))
    named = F.when(clean == "", F.lit(f"unbenannt{extension}")).otherwise(clean)
    if not extension:
        return named
    return F.when(F.endswith(F.lower(named), F.lit(extension.lower())), named).otherwise(F.concat(named, F.lit(extension)))


def _split_name(name: str) -> tuple[str, str]:
    found = re.fullmatch(_NAME, name)
    return (found[1], found[2] or "") if found else (name, "")


class FreeNames:
    """Names that are given out one after the other, each the first of its row's that is free.

    A row tries its name, then ' (2)', ' (3)' and so on before the extension. All numbers below the next one to try are
    in use, so a name that is wanted a million times costs one entry.
    """

    def __init__(self):
        self.used: set[str] = set()
        self.after: dict[str, int] = {}

    def in_use(self, name: str) -> bool:
        if name in self.used or self.after.get(name, 1) > 1:
            return True
        stem, suffix = _split_name(name)
        numbered = _NUMBER.fullmatch(stem)
        return numbered is not None and self.after.get(numbered[1] + suffix, 1) > int(numbered[2])

    def give(self, name: str) -> str:
        stem, suffix = _split_name(name)
        n = self.after.get(name, 1)
        while True:
            candidate = name if n == 1 else f"{stem} ({n}){suffix}"
            n += 1
            if not self.in_use(candidate):
                self.after[name] = n
                return candidate


def free_names(wanted: DataFrame, name: str, order: str, taken: DataFrame | None = None, extension: str = "") -> DataFrame:
    """The rows with destination, a name that no other row gets and that isn't taken.

    In the order given, a row gets the first free one of its name, ' (2)', ' (3)' and so on before its extension. Names
    that could meet are those that are equal but for such numbers; they are dealt to one task, which reads them sorted
    and keeps distinct names only, never the rows.
    """
    expose_package(wanted.sparkSession)
    columns = wanted.columns
    rows = wanted.withColumn("__clean", safe_name(F.col(name), extension)).withColumn("__wanted", F.lit(True))
    if taken is not None:
        blocked = taken.select(safe_name(F.col(name), extension).alias("__clean"), F.lit(False).alias("__wanted"))
        rows = rows.unionByName(blocked, allowMissingColumns=True)
    parts = [F.regexp_extract("__clean", _NAME, k) for k in (1, 2)]
    root = F.concat_ws("\0", F.regexp_replace(parts[0], r"( \([0-9]+\))+$", ""), parts[1])
    # At first they are dealt by the hash, so that a task's roots follow each other without a sort over all rows.
    sorted_ = rows.withColumn("__root", root).repartition("__root").sortWithinPartitions("__root", "__wanted", order)
    kept = sorted_.drop("__root")
    fields = kept.select(*columns, F.col("__clean").alias("destination"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, root = FreeNames(), None
        for batch in batches:
            is_wanted, given = batch.column("__wanted"), []
            for clean, want, own in zip(batch.column("__clean").to_pylist(), is_wanted.to_pylist(), batch.column("__root").to_pylist()):
                if own != root:
                    names, root = FreeNames(), own
                if want:
                    given.append(names.give(clean))
                else:
                    names.used.add(clean)
            left = batch.filter(is_wanted).select(columns)
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(given, pa.string())], names=[*columns, "destination"])

    return sorted_.mapInArrow(assign, fields.schema)


def translated_name(path: Column, language: Column) -> Column:
    """A file's name with the target language before its extension: its letters and digits, TRANSLATED without any."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    tag = F.regexp_replace(F.upper(F.coalesce(language, F.lit(""))), r"[^\p{L}\p{N}]", "")
    shown = F.when(tag == "", F.lit("TRANSLATED")).otherwise(tag)
    return F.concat(F.regexp_extract(name, _NAME, 1), F.lit("_"), shown, F.regexp_extract(name, _NAME, 2))
