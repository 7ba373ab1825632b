import html

import pytest
from pyspark.sql import functions as F

from loomq.functions import markup, text
from loomq.sources import settings


def test_protect_terms(value):
    got = value(lambda t: text.protect_terms(t, ["Creation"]), "The creation of this system took years. Follow CREATION for updates.")
    assert got["text"] == "The creation of this system took years. Follow §§0§§ for updates."
    assert got["placeholders"] == {"§§0§§": "CREATION"}
    assert value(lambda t: text.protect_terms(t, ["StellarRussia"]), "StellarRussia stellarrussia")["placeholders"] == {}
    got = value(lambda t: text.protect_terms(t, ["wisdom"]), "WISDOM … wisdom … <b>WISDOM</b>")
    assert got["text"] == "§§0§§ … wisdom … <b>§§1§§</b>"
    got = value(lambda t: text.protect_terms(t, ["AB", "AB CD"]), "AB CD and AB")
    assert got["placeholders"] == {"§§0§§": "AB CD", "§§1§§": "AB"}
    assert value(lambda t: text.protect_terms(t, []), "x")["placeholders"] == {}


@pytest.mark.parametrize("source", ["", "no term", "WISDOM", "a WISDOM b WISDOM c Foo, Inc. FOO, INC. end", "WISDOMX"])
def test_protect_round_trip(value, source):
    def both(t):
        m = text.protect_terms(t, ["wisdom", "Foo, Inc."])
        return text.restore_terms(m["text"], m["placeholders"])

    assert value(both, source) == source


def test_protect_caps_count_bounds_words_as_its_sql(spark, tmp_path):
    """To the SQL a letter beyond ASCII bounds a word; to the function it doesn't, unless it is told so."""
    from __spark_entry__ import queries

    spark.createDataFrame([(1, "DES! DESÈOUM ÉDES DESX _DES des TOKEN")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries()["protect_caps_count"](spark, str(tmp_path)).first()["n_protected"] == 4
    masked = spark.read.parquet(str(tmp_path / "documents.parquet")).select(text.protect_terms(F.col("text"), ["the", "Token", "DES"]).alias("m"))
    assert masked.first()["m"]["placeholders"] == {"§§0§§": "DES", "§§1§§": "TOKEN"}


def test_html(value):
    assert value(text.html_to_plain, "<p>a &amp; <b>b</b></p> <p>c<br/>d &lt;x&gt;</p>") == "a & b\n\nc\nd <x>"
    assert value(text.html_to_line, "<p>a</p><p>b &amp;\n c</p>") == "a b & c"
    assert value(text.plain_to_html, "one\n two  three\n\n\nfour <&>\"'") == f"<p>one two three</p><p>four {html.escape(chr(60) + '&>' + chr(34) + chr(39))}</p>"
    assert value(text.html_preview, "<p>a <b>b</b>\n&amp; c</p><p>d</p>" + "x" * 99) == ("a b & cd" + "x" * 99)[:80]
    spans = "array(struct('a<' as text, true as bold, false as italic, true as underline, 'text' as kind), named_struct('text', '', 'bold', false, 'italic', false, 'underline', false, 'kind', 'paragraph'), named_struct('text', 'b', 'bold', false, 'italic', true, 'underline', false, 'kind', 'text'), named_struct('text', '', 'bold', false, 'italic', false, 'underline', false, 'kind', 'line'), named_struct('text', 'c', 'bold', false, 'italic', false, 'underline', false, 'kind', 'text'))"
    assert value(lambda: text.spans_to_html(F.expr(spans))) == "<p><b><u>a&lt;</u></b></p><p><i>b</i><br/>c</p>"


@pytest.mark.parametrize("query", ["html_to_plain", "html_lines", "html_previews"])
def test_pages_resolve_what_their_sql_does(spark, tmp_path, query):
    """References that a tag has cut off stay, which HTML's table would resolve without their semicolon."""
    import hashlib

    from __spark_entry__ import queries

    spark.createDataFrame([(1, "<b>a&amp;&amp</b>p &copy;&amp;quot; &lt; &#65;")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries()[query](spark, str(tmp_path)).first()[1]
    shown = "a&&ampp ©&quot; &lt; &#65;" if query != "html_lines" else "a&&amp p ©&quot; &lt; &#65;"
    assert got == (shown if query == "html_previews" else hashlib.md5(shown.encode()).hexdigest())
    assert html.unescape("&ampp") == "&p"  # as the functions do by themselves


def test_predicates(value):
    assert value(text.needs_unicode_font, "café") is False and value(text.needs_unicode_font, "Ж") is True
    assert value(text.without_private_glyphs, "ab") == "a□b"
    assert value(text.is_decoration, "•") is True and value(text.is_decoration, "a•") is False
    for t, expected in (("word", True), ("https://x.org", False), (" www.x", False), ("12", False), (None, False)):
        assert value(text.has_words, (t, "string")) is expected
    assert value(text.repetition_key, " Page  3 OF 14 ") == "page # of #"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("Developer: StellarRussia\nQSI ICO: AUREXIS", "StellarRussia"), ("Developer: The Korolev DirectiveQSI ICO: INERTIARA", "The Korolev Directive"), ("nothing", ""), ("", ""),
        ("x\ndeveloper: A\nDeveloper: B", "A"),
    ],
)
def test_developer(value, source, expected):
    assert value(text.developer, source) == expected


def test_names(value):
    assert value(text.document_number, "in/1526 VIRELICON.docx") == "1526" and value(text.document_number, "VIRELICON.docx") is None
    assert value(text.term_of_file, "in/1526 VIRELICON.pdf") == "VIRELICON" and value(text.term_of_file, "X Y.pdf") == "X Y"
    assert value(text.title_of_file, "in/12 WOUNDS (ls).docx") == "WOUNDS" and value(text.is_variant, "12 WOUNDS (LS) .docx") is True
    got = value(lambda: text.header_names(F.array(F.lit("x"), F.lit("Developer: A QSI ICO: B"), F.lit("developer: C"))))
    assert (got["developer"], got["title"]) == ("A", "B")
    assert value(lambda: text.labelled(F.array(F.lit("a"), F.lit("domain: x.org ")), "Domain:")) == "x.org"
    assert value(lambda: text.written_date(F.array(F.lit("a 1, 2026 b"), F.lit("June 18, 2026")))) == "June 18, 2026"


def test_parsers(value):
    for address in ("https://d.example/drive/folders/Abc_1-2?x=1", "https://d.example/open?id=Abc_1-2", "Abc_1-2"):
        assert value(text.folder_id, address) == "Abc_1-2"
    with pytest.raises(Exception, match="not a folder"):
        value(text.folder_id, "https://x.example/ y")
    assert value(text.is_newer, "v1.10.0", "1.9") is True and value(text.is_newer, "1.2", "1.2") is False and value(text.is_newer, "beta", "1.2") is True
    assert value(text.sizes_sum, "Downloading a (1.5 MB) and b (20 kB)") == 1_520_000
    assert value(text.cuda_version, "| CUDA Version: 12.4 |") == "12.4"
    assert value(text.without_code_fence, "```html\n<p>x</p>\n```") == "<p>x</p>"
    assert value(text.masked_preview, "abcdefghijk") == "abcdefgh…"
    assert value(text.font_family, "TimesNewRoman") == "serif" and value(text.font_family, "Courier") == "monospace" and value(text.font_family, "Arial") == "sans-serif"
    assert value(lambda: text.unpacked_colour(F.lit(0x0A0B0C))).asDict() == {"r": 10, "g": 11, "b": 12}


RUN = "struct({!r} as text, {} as is_image, {} as is_hyperlink, {} as bold, false as italic, false as underline)"


def test_word_markup(value):
    runs = "array(" + ",".join([RUN.format("a & ", "false", "false", "true"), RUN.format("\n", "false", "false", "false"), RUN.format(" b", "false", "true", "false"), RUN.format("", "true", "false", "false")]) + ")"
    shown = value(lambda: markup.paragraph_html(F.expr(runs)))
    assert shown == '<b>a &amp;§§SP§§</b><br/><a data-run="2">§§SP§§b</a><img data-run="3"/>'
    got = value(markup.parse_paragraph, shown, shown)
    assert got["error"] is None and got["break_change"] == 0
    assert [(r["text"], r["bold"], r["link"], r["image"]) for r in got["runs"]] == [("a & ", True, None, None), ("\n", False, None, None), (" b", False, "2", None), ("\n", False, None, None), ("", False, None, "3")]
    assert value(markup.parse_paragraph, "<b>x</b>", shown)["error"]


def test_slide_markup(value):
    shown = value(lambda: markup.slide_html(F.array(F.lit("Hi <x>"), F.lit("12"), F.lit("there"))))
    assert shown == '<span data-run="0">Hi &lt;x&gt;</span><span data-run="2">there</span>'
    got = value(markup.parse_spans, shown.replace("there", "da"), shown)
    assert got["texts"] == {0: "Hi <x>", 2: "da"}
    assert value(markup.parse_spans, shown + " stray", shown)["error"] == "text outside of marks"
    assert value(markup.parse_spans, '<span data-run="2">a</span>', shown)["error"] == "marks changed"


def test_dominant(spark):
    rows = [(1, "a", 0), (1, "b", 1), (1, "b", 2), (1, "a", 3), (2, "c", 0)]
    got = {r["k"]: r["look"] for r in markup.dominant(spark.createDataFrame(rows, "k int, look string, o int"), ["k"], "look", "o").collect()}
    assert got == {1: "a", 2: "c"}


def test_terms_file(tmp_path):
    file = tmp_path / "terms.csv"
    file.write_bytes('﻿Begriff;Kommentar\nClavis;x\n\n CLAVIS ;y\nArboretum;z\n'.encode())
    assert settings.terms_file(file) == ["Clavis", "Arboretum"]
    file.write_bytes('"Foo, Inc.",company\nBär,x\n'.encode("cp1252"))
    assert settings.terms_file(file) == ["Foo, Inc.", "Bär"]
    file.write_text("Wisdom\nwisdom\nFoo\n")
    assert settings.terms_file(file) == ["Wisdom", "Foo"]
    assert settings.merge_terms("Arboretum\nClavis", ["clavis", "VIRELICON", "Arboretum", "Acme"]) == "Arboretum\nClavis\nVIRELICON\nAcme"


def test_settings(spark, tmp_path):
    settings.save_json(tmp_path / "m.json", {"2": {"status": "approved", "files": [{"filename": "a", "mtime": "t", "sha256": "s"}], "excluded": ["b"]}})
    rows = settings.load_manifest(spark, tmp_path / "m.json")
    assert rows.count() == 2 and settings.manifest_content(rows) == settings.load_json(tmp_path / "m.json")
    table = settings.regions_table(spark, [{"text": "a", "x": 1, "y": 2, "width": 3, "height": 4}, {"text": "b", "x": 1, "y": 2, "width": 3, "height": 4, "orig_x": 0}])
    assert [r["render_box"] is not None for r in table.orderBy("region_index").collect()] == [False, True]
    with pytest.raises(ValueError, match="width"):
        settings.regions_table(spark, [{"text": "a", "x": 1, "y": 2, "height": 4}])


def test_casefold(spark, value):
    for t in ("Straße STRASSE", "ΣΊΣΥΦΟΣ ς", "ŉ ǰ ﬃ ẞ İ ı ſ", "Ꭰ ꭰ", "", "plain", "µm"):
        assert value(text.casefold, t) == t.casefold()
    assert value(text.casefold, (None, "string")) is None
    letters = [chr(c) for c in range(0x20, 0x2FA20) if chr(c).isalpha() and not 0x3400 <= c < 0xA000 and not 0xAC00 <= c < 0xD7A4 and not 0x20000 <= c]
    df = spark.createDataFrame([(c, c.casefold()) for c in letters], "c string, f string")
    assert [r["c"] for r in df.filter(text.casefold(F.col("c")) != F.col("f")).collect()] == []


def test_protect_many_terms(value):
    source = " ".join(f"w{i} WISDOM wisdom" for i in range(20_000))
    got = value(lambda t: text.protect_terms(t, ["Wisdom"]), source)
    assert len(got["placeholders"]) == 20_000 and got["text"].endswith("w19999 §§19999§§ wisdom")
