import datetime

import pytest

from loomq.functions import dates

D = datetime.date


@pytest.mark.parametrize(
    ("text", "formats", "expected"),
    [
        ("Ausstellungsdatum: 2026-09-01.", ["iso"], [D(2026, 9, 1)]),
        ("Invalid: 2026-13-40.", ["iso"], []),
        ("Datum: 1.9.26", ["de"], [D(2026, 9, 1)]),
        ("Am 31.02.2026 und 28.2.2026", ["de"], [D(2026, 2, 28)]),
        ("01/09/2026", ["slash"], [D(2026, 9, 1)]),
        ("01/13/2026", ["slash"], [D(2026, 1, 13)]),
        ("September 1, 2026", ["en_month"], [D(2026, 9, 1)]),
        ("1 september 2026", ["en_month"], [D(2026, 9, 1)]),
        ("September 1 2026", ["en_month"], [D(2026, 9, 1)]),
        ("2026-09-01 and 2.9.2026", ["iso", "de"], [D(2026, 9, 1), D(2026, 9, 2)]),
        ("nothing", list(dates.FORMATS), []),
    ],
)
def test_presets(value, text, formats, expected):
    assert sorted(value(lambda t: dates.find_dates(t, formats), text)) == expected


@pytest.mark.parametrize(
    ("text", "pattern", "expected"),
    [
        ("Filed Sep 4, 26.", "MMM D, YY", [D(2026, 9, 4)]),
        ("September 4, 2026", "MMMM DD, YYYY", []),
        ("September 04, 2026", "MMMM DD, YYYY", [D(2026, 9, 4)]),
        ("September 2026", "MMMM YYYY", []),
        ("04|09|2026", "DD|MM|YYYY", [D(2026, 9, 4)]),
        ("04x09x2026", "YYYY-YYYY", []),
    ],
)
def test_custom(value, text, pattern, expected):
    assert value(lambda t: dates.custom_dates(t, pattern), text) == expected


@pytest.mark.parametrize("pattern", ["YYYY-YYYY", "MM/M", "DD.D", "", "none here"])
def test_invalid_patterns(pattern):
    assert dates.compile_custom(pattern) is None


def test_ranges(value):
    day = dates.DateRange.on(D(2026, 9, 1))
    assert value(lambda t: dates.matches_document_date(t, day, ["iso"]), "x 2026-09-01") is True
    assert value(lambda t: dates.matches_document_date(t, day, ["iso"]), (None, "string")) is False
    assert value(lambda t: dates.matches_file_date(t, day), (None, "timestamp")) is False
    year = dates.DateRange(D(2026, 1, 1), D(2026, 12, 31))
    assert value(lambda t: dates.matches_file_date(t, year), ("2020-01-01 10:00:00", "timestamp")) is False
    assert value(lambda t: dates.matches_file_date(t, year), ("2026-12-31 23:59:59", "timestamp")) is True
    with pytest.raises(ValueError):
        dates.DateRange(D(2026, 2, 1), D(2026, 1, 1))
    with pytest.raises(ValueError):
        dates.DateFilter(day, "document")
    with pytest.raises(ValueError):
        dates.DateFilter(day, "document", ("header",), ())
