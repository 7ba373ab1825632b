"""Finding dates in texts and filtering by them."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomq.functions.text import bound

# The names of the preset formats and of the months.
ISO, GERMAN, SLASH, ENGLISH = "iso", "de", "slash", "en_month"
FORMATS = (ISO, GERMAN, SLASH, ENGLISH)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NAMES = "|".join(MONTHS)
# The patterns of the presets, in Java's dialect with Unicode classes.
_ISO = r"(?U)\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
_GERMAN = r"(?U)\b(\d{1,2})\.(\d{1,2})\.(\d{2,4})\b"
_SLASH = r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
_ENGLISH = rf"(?iU)\b(?:({_NAMES})\s+(\d{{1,2}}),?\s+(\d{{4}})|(\d{{1,2}})\s+({_NAMES})\s+(\d{{4}}))\b"


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date of numbers or their digits, or null where there is no such day."""
    padded = [F.lpad(part.cast("string"), n, "0") for part, n in ((year, 4), (month, 2), (day, 2))]
    return F.concat_ws("-", *padded).try_cast("date")


def _whole(m: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(m, pattern, group).try_cast("int")


def _full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def _month_number(name: Column, short: bool = False) -> Column:
    names = [m[:3] if short else m for m in MONTHS]
    return F.array_position(F.array(*map(F.lit, names)), F.lower(name)).cast("int")


def _all(text: Column, pattern: str, build) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_compact(F.transform(found, build))


def _parts(m: Column, separator: str, build) -> Column:
    """A date from the pieces of what was found, which is split once."""
    return bound(F.split(m, separator), lambda p: build(*[F.get(p, k) for k in range(3)]))


def iso_dates(text: Column) -> Column:
    return _all(text, _ISO, lambda m: _parts(m, "-", lambda y, mo, d: _date(y, mo, d)))


def german_dates(text: Column) -> Column:
    """Day.month.year; a year below 100 is in this century."""
    return _all(text, _GERMAN, lambda m: _parts(m, r"\.", lambda d, mo, y: _date(_full_year(y.try_cast("int")), mo, d)))


def slash_dates(text: Column) -> Column:
    """Day first; month first only where that isn't a date."""
    return _all(text, _SLASH, lambda m: _parts(m, "/", lambda a, b, y: F.coalesce(_date(y, b, a), _date(y, a, b))))


def english_dates(text: Column) -> Column:
    """Month day, year and day month year with the full names of the months."""

    def build(a: Column, b: Column, year: Column) -> Column:
        month = _month_number(a)
        return _date(year, F.coalesce(F.nullif(month, F.lit(0)), _month_number(b)), F.when(month > 0, b).otherwise(a))

    return _all(text, _ENGLISH, lambda m: _parts(m, r"(?U),?\s+", build))


_FINDERS = {ISO: iso_dates, GERMAN: german_dates, SLASH: slash_dates, ENGLISH: english_dates}

# The tokens of a free pattern with the field and what each matches.
_TOKENS = {
    "YYYY": ("year", r"\d{4}"),
    "MMMM": ("month", _NAMES),
    "MMM": ("month", "|".join(m[:3] for m in MONTHS)),
    "YY": ("year", r"\d{2}"),
    "MM": ("month", r"\d{2}"),
    "DD": ("day", r"\d{2}"),
    "M": ("month", r"\d{1,2}"),
    "D": ("day", r"\d{1,2}"),
}
_TOKEN = re.compile("|".join(sorted(_TOKENS, key=len, reverse=True)))


@dataclass(frozen=True)
class CustomPattern:
    """A free pattern as a Java regular expression and the token of each group."""

    regex: str
    groups: tuple[str, ...]


def compile_custom(pattern: str) -> CustomPattern | None:
    """None if the pattern has no token, or two of the same field."""
    groups = tuple(_TOKEN.findall(pattern))
    fields = [_TOKENS[t][0] for t in groups]
    if not groups or len(set(fields)) < len(fields):
        return None
    literals = _TOKEN.split(pattern)
    body = "".join(_quoted(a) + f"({_TOKENS[t][1]})" for a, t in zip(literals, groups)) + _quoted(literals[-1])
    return CustomPattern(rf"(?iU)\b{body}\b", groups)


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in literal)


def custom_dates(text: Column, pattern: str) -> Column:
    """Dates by a free pattern; none if it doesn't compile or lacks the year, month or day."""
    compiled = compile_custom(pattern)
    at = {_TOKENS[t][0]: (k + 1, t) for k, t in enumerate(compiled.groups)} if compiled else {}
    if len(at) < 3:
        return F.when(text.isNotNull(), F.expr("cast(array() as array<date>)"))

    def build(m: Column) -> Column:
        year = _whole(m, compiled.regex, at["year"][0])
        k, token = at["month"]
        named = _month_number(F.regexp_extract(m, compiled.regex, k), short=token == "MMM")
        month = named if token in ("MMMM", "MMM") else _whole(m, compiled.regex, k)
        return _date(_full_year(year) if at["year"][1] == "YY" else year, month, _whole(m, compiled.regex, at["day"][0]))

    return _all(text, compiled.regex, build)


def find_dates(text: Column, formats: Iterable[str] = FORMATS, custom: str | None = None) -> Column:
    """All dates of a text in the given formats; a null text gives null."""
    found = [_FINDERS[f](text) for f in FORMATS if f in set(formats)]
    if custom:
        found.append(custom_dates(text, custom))
    return F.concat(*found) if found else F.when(text.isNotNull(), F.expr("cast(array() as array<date>)"))


@dataclass(frozen=True)
class DateRange:
    """Days from start to end, both included; None leaves a side open."""

    start: datetime.date | None = None
    end: datetime.date | None = None

    def __post_init__(self):
        if self.start and self.end and self.start > self.end:
            raise ValueError("the range ends before it starts")

    @classmethod
    def on(cls, day: datetime.date) -> DateRange:
        return cls(day, day)

    @property
    def bounded(self) -> bool:
        return self.start is not None or self.end is not None

    def contains(self, day: Column) -> Column:
        inside = day.isNotNull()
        if self.start is not None:
            inside &= day >= F.lit(self.start)
        if self.end is not None:
            inside &= day <= F.lit(self.end)
        return F.coalesce(inside, F.lit(False))


def matches_document_date(text: Column, days: DateRange, formats: Iterable[str] = FORMATS, custom: str | None = None) -> Column:
    """Whether some date of the text is in range; a null text has none."""
    return F.coalesce(F.exists(find_dates(text, formats, custom), days.contains), F.lit(False))


def matches_file_date(modified: Column, days: DateRange) -> Column:
    """Whether a time stamp's day in the session's time zone is in range; null never is."""
    return days.contains(F.to_date(modified))


@dataclass(frozen=True)
class DateFilter:
    """A validated date filter of a search: by the file's day or by dates in a document's regions."""

    days: DateRange
    source: str = "file"
    regions: tuple[str, ...] = ()
    formats: tuple[str, ...] = FORMATS
    custom: str | None = None

    def __post_init__(self):
        if self.source not in ("file", "document"):
            raise ValueError(f"unknown source of dates: {self.source}")
        if self.source == "document":
            if not self.regions:
                raise ValueError("a document's dates need a region")
            if not self.formats and not (self.custom and compile_custom(self.custom)):
                raise ValueError("a document's dates need a format")

    def predicate(self, modified: Column, region_text: Column | None = None) -> Column:
        if not self.days.bounded:
            return F.lit(True)
        if self.source == "file":
            return matches_file_date(modified, self.days)
        return matches_document_date(region_text, self.days, self.formats, self.custom)
