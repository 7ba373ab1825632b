import pytest
from pyspark.sql import functions as F

from loomq.operators import dedupe
from loomq.sources import office, reports, sinks

CANDIDATE = "group_id int, idx int, name string, body string, error string, developer string, paragraph_count int"


@pytest.fixture()
def candidates(spark):
    text = "\n".join(f"line {i}" for i in range(20))
    rows = [
        (1, 0, "a<b>.docx", text, None, "X & Co", 20), (1, 1, "b.docx", text.replace("line 10", "line <ten>"), None, "", 20), (1, 2, "c.docx", text + "\nmore", None, "X & Co", 21),
        (2, 0, "d.docx", "same", None, "Y", 1), (2, 1, "e.docx", "same", None, "Y", 1), (3, 0, "f.docx", None, "broken", None, None), (3, 1, "g.docx", "x", None, "Z", 1),
    ]
    return spark.createDataFrame(rows, CANDIDATE)


def test_changed_lines():
    left, right = [f"l{i}" for i in range(12)], [f"l{i}" if i != 6 else "new" for i in range(12)]
    assert reports.changed_lines(left, right, 1) == [("same", "l5", "l5"), ("old", "l6", ""), ("new", "", "new"), ("same", "l7", "l7")]
    assert reports.changed_lines(left, left) == [] and reports.changed_lines([], ["a"]) == [("new", "", "a")]
    apart = reports.changed_lines([str(i) for i in range(30)], [str(i) if i not in (2, 25) else "x" for i in range(30)])
    assert [k for k, _, _ in apart].count("gap") == 1


def test_tables(candidates):
    got = {r["group_id"]: r["table"] for r in reports.candidate_tables(candidates, {"Developer": "developer", "Paragraphs": "paragraph_count"}).collect()}
    assert "<th>a&lt;b&gt;.docx</th><th>b.docx</th>" in got[1] and "<tr><th>Developer</th><td class='differs'>X &amp; Co</td><td class='differs'>-</td>" in got[1]
    assert "differs" not in got[2] and "error" not in got[2]
    assert "<tr><th>error</th><td>broken</td><td>-</td></tr>" in got[3] and "<tr><th>Developer</th><td>-</td><td>Z</td></tr>" in got[3]


def test_group_reports_as_files(spark, candidates, tmp_path):
    similarities = dedupe.pair_similarities(candidates)
    made = reports.group_reports(candidates, similarities, {"Developer": "developer"})
    sinks.write_files(made, str(tmp_path / "out"))
    first, second, third = ((tmp_path / f"out/group-{n}.html").read_text() for n in (1, 2, 3))
    assert first.count("<h2 id=") == 3 and first.count("<li><a href='#pair-") == 3 and "<td class='new'>line &lt;ten&gt;</td>" in first
    ratio = candidates.filter("group_id = 1 and idx < 2").select("body").collect()
    from difflib import SequenceMatcher

    assert f"a&lt;b&gt;.docx &harr; b.docx ({SequenceMatcher(None, ratio[0][0], ratio[1][0]).ratio() * 100:.1f}%)" in first
    assert "(100.0%)</h2>" in second and "<ul>" not in second and second.count("<table>") == 1
    assert "<h2" not in third and "broken" in third


def test_index(spark, candidates):
    made = spark.range(25).select(F.format_string("r%02d.html", "id").alias("name"))
    pages = {r["page"]: r for r in reports.index_pages(made, ["name"], links=10).collect()}
    assert sorted(pages) == [0, 1, 2] and [pages[n]["content"].count("<li>") for n in range(3)] == [10, 10, 5]
    assert pages[2]["name"] == "index-2.html" and "<a href='r20.html'>r20.html</a>" in pages[2]["content"]
    assert reports.index_pages(made.filter("false"), ["name"]).count() == 0


def test_comparison_as_word(spark):
    rows = [(7, 1, 5, 0, "second\nline", "ZWEI", None), (7, 0, 5, 1, "first", "EINS", "UNO"), (8, 0, 0, 0, "other", "x", "y")]
    entries = spark.createDataFrame(rows, "doc_id int, page_index int, y0 int, place int, text string, deepl string, google string")
    made = reports.comparison_word(entries, ["deepl", "google"], {"source": "a.pdf"})
    files = made.select(F.col("name").alias("path"), "content")
    found = office.read_word(files).filter("path = 'comparison-7.docx' and part = 'body'").orderBy("para_index")
    texts = [r["t"] for r in found.select(office.paragraph_text(F.col("runs")).alias("t")).collect()]
    assert [t for t in texts if t] == ["source: a.pdf", "1 (page 1)", "first", "deepl:", "EINS", "google:", "UNO", "2 (page 2)", "second line", "deepl:", "ZWEI", "google:"]
