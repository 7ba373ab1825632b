"""Scalar text functions: term masking, HTML and plain text, normalisation, small parsers. All but entities are built in."""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: the characters that count as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends, where trim() by itself takes spaces only."""
    return F.trim(text, F.lit(WHITE_SPACE))


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn's lambdas look at it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


@lru_cache(maxsize=1)
def _foldings() -> dict[str, str]:
    """What full case folding changes in a text that is in lower case already, by Unicode's own table."""
    every = map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    return {c: c.casefold() for c in every if c.lower() == c != c.casefold()}


def casefold(text: Column) -> Column:
    """Full case folding: equal for texts that differ in case only, with ß as ss.

    Nearly every text is done by lower() and two replacements; only one with a rarer letter goes through the whole table.
    """
    rare = {c: f for c, f in _foldings().items() if c not in "ßς"}
    low = F.replace(F.translate(F.lower(text), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    one = {c: f for c, f in rare.items() if len(f) == 1}
    more = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in rare.items() if len(f) > 1])
    whole = F.aggregate(more, F.translate(low, "".join(one), "".join(one.values())), lambda t, e: F.replace(t, e["c"], e["f"]))
    plain = F.octet_length(low) == F.length(low)  # ASCII alone has nothing rare
    return F.when(plain, low).when(low.rlike(f"[{_ranges(rare)}]"), whole).otherwise(low)


def _ranges(chars: Iterable[str]) -> str:
    """The body of a regular expression's class, with neighbours as ranges."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


# --- terms that stay as they are ---------------------------------------------------------------------------------

#: Fixed value: what stands for the n-th protected term.
PLACEHOLDER = "§§{}§§"


def term_pattern(terms: Sequence[str], ascii_words: bool = False) -> str | None:
    """Whole words, longest first, in any case; None without terms. With ascii_words other letters bound a word, too."""
    kept = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    quoted = ["".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in t) for t in kept]
    if not kept:
        return None
    if ascii_words:  # \b itself knows all letters
        edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        return rf"(?iu){edge}(?:{'|'.join(quoted)}){edge}"
    return rf"(?iU)\b(?:{'|'.join(quoted)})\b"


def _all_caps(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def protect_terms(text: Column, terms: Sequence[str], ascii_words: bool = False) -> Column:
    """struct(text, placeholders): occurrences in capitals are replaced by numbered placeholders, others stay."""
    pattern = term_pattern(terms, ascii_words)
    none = F.expr("cast(map() as map<string,string>)")
    if pattern is None:
        return F.struct(text.alias("text"), F.when(text.isNotNull(), none).alias("placeholders"))
    first, last = PLACEHOLDER.split("{}")
    read = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def located(r: Column) -> Column:
        """Where the occurrences in capitals are, and the text as pieces, one up to the end of each occurrence."""
        places = F.filter(F.transform(r["found"], lambda w, i: F.when(_all_caps(w), i)), lambda i: i.isNotNull())
        pieces = F.zip_with(r["between"], r["found"], lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.struct(places.alias("at"), pieces.alias("pieces"), r["found"].alias("found"), r["between"].alias("between"))

    def masked(r: Column) -> Column:
        """Each stretch between two masked occurrences is joined once, so the work is linear in the text."""

        def stretch(at: Column, n: Column) -> Column:
            start = F.when(n > 0, F.get(r["at"], n - 1) + 1).otherwise(0)
            plain = F.array_join(F.slice(r["pieces"], start + 1, at - start), "")
            return F.concat(plain, F.get(r["between"], at), F.lit(first), n.cast("string"), F.lit(last))

        done = F.when(F.size(r["at"]) > 0, F.element_at(r["at"], -1) + 1).otherwise(0)
        rest = F.array_join(F.slice(r["pieces"], done + 1, F.size(r["pieces"])), "")
        keys = F.transform(r["at"], lambda _, n: F.concat(F.lit(first), n.cast("string"), F.lit(last)))
        caps = F.transform(r["at"], lambda i: F.get(r["found"], i))
        shown = F.concat(F.array_join(F.transform(r["at"], stretch), ""), rest)
        return F.struct(shown.alias("text"), F.map_from_arrays(keys, caps).alias("placeholders"))

    empty = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("map<string,string>").alias("placeholders"))
    return F.when(text.isNull(), empty).otherwise(bound(bound(read, located), masked))


def restore_terms(text: Column, placeholders: Column) -> Column:
    return F.aggregate(F.map_entries(placeholders), text, lambda t, e: F.replace(t, e["key"], e["value"]))


# --- HTML and plain text -----------------------------------------------------------------------------------------


#: The references that the queries on pages resolve, as their SQL does.
PAGE_NAMES = ("copy", "middot", "quot", "amp")


def _unescaped(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else html.unescape(x) for x in column.to_pylist()], pa.string())


def _named(column: pa.Array, names: Sequence[str]) -> pa.Array:
    reference = re.compile("&(" + "|".join(map(re.escape, names)) + ");")
    return pa.array([None if x is None else reference.sub(lambda m: html.entities.html5[f"{m[1]};"], x) for x in column.to_pylist()], pa.string())


def unescape(text: Column, names: Sequence[str] | None = None) -> Column:
    """Character references as characters, by HTML's own table, in Arrow batches.

    As browsers do, this takes some names without their semicolon too, even before further letters. With names only
    these are resolved, and only where the semicolon is there.
    """
    if names is None:
        return F.arrow_udf(_unescaped, "string")(text)
    return F.arrow_udf(lambda column: _named(column, names), "string")(text)


def escape(text: Column, quotes: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def without_tags(markup: Column) -> Column:
    """Paragraph bounds as blank lines, line breaks as new lines, other tags gone; character references stay."""
    text = F.regexp_replace(markup, r"(?i)</p>\s*<p>", "\n\n")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(text, r"<[^>]+>", "")


def html_to_plain(markup: Column, names: Sequence[str] | None = None) -> Column:
    return unescape(without_tags(markup), names)


def html_to_line(markup: Column, names: Sequence[str] | None = None) -> Column:
    """One line: tags count as spaces, character references are resolved, white space is collapsed."""
    return collapsed(unescape(F.regexp_replace(markup, r"<[^>]+>", " "), names))


def html_preview(markup: Column, length: int = 80, names: Sequence[str] | None = None) -> Column:
    """The beginning of a paragraph's text on one line; tags leave no space behind."""
    return F.substring(collapsed(unescape(F.regexp_replace(markup, r"<[^>]+>", ""), names)), 1, length)


def paragraphs(text: Column) -> Column:
    """Lines joined by a space up to the next blank line, as an array; runs of spaces are one."""
    lines = F.array_join(F.transform(F.split(text, "\n"), stripped), "\n")
    parts = F.filter(F.split(lines, "\n\n+"), lambda p: F.regexp_replace(p, "\n", "") != "")
    return F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^\n+|\n+$", ""), "\n", " "), " {2,}", " "))


def plain_to_html(text: Column) -> Column:
    return F.array_join(F.transform(paragraphs(text), lambda p: F.concat(F.lit("<p>"), escape(p), F.lit("</p>"))), "")


def spans_to_html(spans: Column) -> Column:
    """Spans struct(text, bold, italic, underline, kind) as paragraphs; kind is text, paragraph or line."""
    mark = "\u001e"

    def tagged(inner: Column, flag: Column, tag: str) -> Column:
        return F.when(flag, F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)

    def part(s: Column) -> Column:
        shown = tagged(tagged(tagged(escape(s["text"]), s["underline"], "u"), s["italic"], "i"), s["bold"], "b")
        return F.when(s["kind"] == "paragraph", F.lit(mark)).when(s["kind"] == "line", F.lit("<br/>")).otherwise(shown)

    parts = F.filter(F.split(F.array_join(F.transform(spans, part), ""), mark), lambda p: stripped(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")


def needs_unicode_font(text: Column) -> Column:
    return text.rlike(r"[^\x{00}-\x{FF}]")


def without_private_glyphs(text: Column) -> Column:
    """Private-use characters, which no font shows, as a box."""
    return F.regexp_replace(text, r"\p{Co}", "□")


# --- predicates --------------------------------------------------------------------------------------------------

#: Fixed value: characters that make a token decoration.
DECORATION = "©®™~\\|*•§¶†‡°@()[]{}_‘’“”\".,"


def is_decoration(token: Column) -> Column:
    return F.translate(token, DECORATION, "") == ""


def has_words(text: Column) -> Column:
    """Whether a run of text has a letter and isn't an address."""
    return F.coalesce(text.rlike(r"\p{L}") & ~stripped(text).rlike(r"(?i)^(https?://|www\.|mailto:)"), F.lit(False))


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def repetition_key(text: Column) -> Column:
    """Equal for lines that differ in numbers, white space and case only."""
    return casefold(collapsed(F.regexp_replace(text, r"(?U)\d+", "#")))


# --- names of documents ------------------------------------------------------------------------------------------


def stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:(?<=[^/])\.[^./]*)?$", 1)


def document_number(path: Column) -> Column:
    """The digits before the first space of a file's name; null if it has none."""
    return F.nullif(F.regexp_extract(stripped(stem(path)), r"^([0-9]+)\s+", 1), F.lit(""))


def term_of_file(path: Column) -> Column:
    """A file's name without its extension and leading number."""
    return stripped(F.regexp_replace(stripped(stem(path)), r"^[0-9]+\s+", ""))


def is_variant(path: Column) -> Column:
    return stem(path).rlike(r"(?i)\s*\(LS\)\s*$")


def title_of_file(path: Column) -> Column:
    """term_of_file() without the variant's mark."""
    return stripped(F.regexp_replace(term_of_file(path), r"(?i)\s*\(LS\)\s*$", ""))


def developer(text: Column) -> Column:
    """What follows 'Developer:' in the first line that has it, up to 'QSI ICO:'; empty if there is none."""
    lines = F.filter(F.split(text, "\r\n|\r|\n"), lambda x: F.lower(x).contains("developer:"))
    found = F.regexp_extract(F.get(lines, F.lit(0)), r"(?i)Developer:\s*(.*?)\s*(?:QSI ICO:.*)?$", 1)
    return F.coalesce(stripped(found), F.lit(""))


def labelled(texts: Column, label: str) -> Column:
    """What follows a label in the first of some texts that begin with it."""
    first = F.get(F.filter(texts, lambda t: F.lower(t).startswith(label.lower())), F.lit(0))
    return stripped(F.substring(first, len(label) + 1, 1 << 30))


def header_names(headers: Column) -> Column:
    """struct(developer, title) of the first header with 'developer:'; empty values are null."""
    first = F.get(F.filter(headers, lambda t: F.lower(t).contains("developer:")), F.lit(0))
    names = (r"(?i)Developer:\s*(.*?)(?=QSI ICO:|$)", "developer"), (r"(?i)QSI ICO:\s*(.*)$", "title")
    return F.struct(*[F.nullif(stripped(F.regexp_extract(first, p, 1)), F.lit("")).alias(n) for p, n in names])


def written_date(texts: Column) -> Column:
    """The first text that is a date such as 'June 18, 2026'."""
    return F.get(F.filter(texts, lambda t: t.rlike(r"^[A-Za-z]+ [0-9]{1,2},\s*[0-9]{4}$")), F.lit(0))


# --- small parsers -----------------------------------------------------------------------------------------------


def folder_id(text: Column) -> Column:
    """The id in a folder's address, or a bare id; anything else is an error."""
    tries = [F.nullif(F.regexp_extract(stripped(text), p, 1), F.lit("")) for p in (r"/folders/([A-Za-z0-9_-]+)", r"[?&]id=([A-Za-z0-9_-]+)", r"^([A-Za-z0-9_-]+)$")]
    return F.coalesce(*tries, F.raise_error(F.concat(F.lit("not a folder: "), text)).cast("string"))


def version_parts(text: Column) -> Column:
    """Whole numbers of a dotted version with an optional v; null if it isn't one."""
    plain = F.regexp_replace(stripped(text), "^[vV]", "")
    return F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(plain, r"\."), lambda x: x.cast("int")))


def is_newer(candidate: Column, current: Column) -> Column:
    """Whether a version is newer; where one isn't a version, any other text is."""
    a, b = version_parts(candidate), version_parts(current)
    return F.when(a.isNull() | b.isNull(), candidate != current).otherwise(a > b)


#: Units of a size in bytes.
_UNITS = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9}


def sizes_sum(text: Column) -> Column:
    """The sum in bytes of all sizes such as '1.5 MB' in a text."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)[0-9]+(?:\.[0-9]+)? ?(?:kB|MB|GB|B)\b"), F.lit(0))
    units = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])

    def size(x: Column) -> Column:
        return F.regexp_extract(x, r"^[0-9.]+", 0).cast("double") * units[F.upper(F.regexp_extract(x, "[A-Za-z]+$", 0))]

    return F.aggregate(found, F.lit(0.0), lambda a, x: a + size(x)).cast("long")


def cuda_version(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"CUDA Version:\s*([0-9]+\.[0-9]+)", 1), F.lit(""))


def without_code_fence(text: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"^```[A-Za-z0-9_-]*\s*", ""), r"\s*```$", ""))


def masked_preview(secret: Column, shown: int = 8) -> Column:
    """The beginning of a secret, the rest as an ellipsis."""
    return F.when(F.length(secret) <= shown, secret).otherwise(F.concat(F.substring(secret, 1, shown), F.lit("…")))


# --- colours and fonts -------------------------------------------------------------------------------------------


def unpacked_colour(packed: Column) -> Column:
    """Red, green and blue of a packed whole number."""
    return F.struct(*[F.shiftright(packed, n).bitwiseAND(255).alias(c) for n, c in ((16, "r"), (8, "g"), (0, "b"))])


def contrasting_colour(c: Column) -> Column:
    """Black on light grounds and white on dark ones, as red, green and blue."""
    light = c["r"] * 0.299 + c["g"] * 0.587 + c["b"] * 0.114 > 128
    return F.struct(*[F.when(light, 0).otherwise(255).alias(n) for n in "rgb"])


def colour_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[n] - b[n]) * (a[n] - b[n]) for n in "gb"), (a["r"] - b["r"]) * (a["r"] - b["r"])))


def mixed_colour(a: Column, b: Column, share: Column) -> Column:
    return F.struct(*[(a[n] + (b[n] - a[n]) * share).cast("int").alias(n) for n in "rgb"])


# Parts of names that tell a font's family.
SERIF = (
    "times", "georgia", "garamond", "cambria", "palatino", "minion", "caslon", "baskerville", "constantia", "cochin", "didot", "plantin", "bookman",
    "book antiqua", "century", "goudy", "sabon", "serif",
)
MONOSPACE = ("courier", "consolas", "menlo", "monaco", "mono", "typewriter", "lucida console", "andale mono")


def font_family(name: Column) -> Column:
    def any_of(words: Sequence[str]) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(name).contains(w))

    return F.when(any_of(SERIF), "serif").when(any_of(MONOSPACE), "monospace").otherwise("sans-serif")


def message(own: Column, fallback: Column, key: Column) -> Column:
    """A message in a language, else in the fallback language, else its key."""
    return F.coalesce(own, fallback, key)


def blank(text: Column) -> Column:
    return stripped(F.coalesce(text, F.lit(""))) == ""


