import hashlib
import random
from difflib import SequenceMatcher
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from loomq.operators import cost, dedupe, manifest, merge, translate

SCAN = "number string, filename string, mtime string, sha256 string"
MANIFEST = SCAN.replace("number string,", "number string, status string,") + ", role string"


def test_manifest(spark):
    scan = spark.createDataFrame(
        [("1", "a", "t1", "s1"), ("2", "b", "t2", "sX"), ("3", "c", "t3", "s3"), ("4", "d1", "t", "s"), ("4", "d2", "t", "s"), ("5", "e", "t", "s"), ("6", "f", "t9", "s6"), ("6", "extra", "t", "s"), ("6", "out", "t", "s")], SCAN
    )
    known = spark.createDataFrame(
        [("1", "approved", "a", "t1", "other", "approved"), ("2", "approved", "b", "old", "s2", "approved"), ("3", "approved", "c", "old", "s3", "approved"), ("3", "approved", "gone", "t", "s", "approved"),
         ("6", "approved", "f", "t9", "s6", "approved"), ("6", "approved", "out", None, None, "excluded"), ("9", "approved", "z", "t", "s", "approved")], MANIFEST
    )
    found = manifest.diff(scan, known)
    got = {(r["number"], r["filename"]): r["bucket"] for r in found.collect()}
    assert got == {("1", "a"): "unchanged", ("2", "b"): "changed", ("3", "c"): "unchanged", ("3", "gone"): "missing", ("4", "d1"): "new_duplicate", ("4", "d2"): "new_duplicate", ("5", "e"): "auto_approved", ("6", "f"): "unchanged", ("6", "extra"): "changed"}
    assert manifest.issues(found).count() == 5
    updated = manifest.approve_new(known, scan, found)
    assert updated.filter("number = '5' and role = 'approved'").count() == 1 and updated.count() == known.count() + 1
    by_hand = manifest.approve(known, scan, "4", ["d1"]).filter("number = '4'").collect()
    assert {r["filename"]: r["role"] for r in by_hand} == {"d1": "approved", "d2": "excluded"}
    chosen = manifest.select_documents(by_hand and manifest.approve(known, scan, "4", ["d1"]), limit=3).collect()
    assert [r["number"] for r in chosen] == ["1", "2", "3"]


def test_needed_hashes(spark):
    scan = spark.createDataFrame([("1", "a", "t1"), ("2", "b", "t2"), ("3", "new", "t")], "number string, filename string, mtime string")
    known = spark.createDataFrame([("1", "approved", "a", "t1", "s1", "approved"), ("2", "approved", "b", "old", hashlib.sha256(b"b").hexdigest(), "approved")], MANIFEST)
    asked = []

    def read(files):
        asked.extend(r["filename"] for r in files.collect())
        return files.withColumn("content", F.col("filename").cast("binary"))

    hashed = manifest.needed_hashes(scan, known, read)
    assert asked == ["b"] and {r["filename"]: r["bucket"] for r in manifest.diff(hashed, known).collect()} == {"a": "unchanged", "b": "unchanged", "new": "auto_approved"}
    classes = spark.createDataFrame([("4", "x")], "group_id string, class string")
    found = spark.createDataFrame([("4", "d1", "new_duplicate"), ("4", "d2", "new_duplicate"), ("1", "a", "changed")], "number string, filename string, bucket string")
    assert [tuple(r) for r in manifest.suggestions(found, classes).collect()] == [("4", 2, "x")]


def _group(spark, sims, **facts):
    n = 3
    rows = [("g", facts.get("developer", ["x"] * n)[i], facts.get("domain", ["d"] * n)[i], facts.get("date", [None] * n)[i], facts.get("count", [5] * n)[i]) for i in range(n)]
    candidates = spark.createDataFrame(rows, "group_id string, developer string, domain string, date string, paragraph_count int")
    similarities = spark.createDataFrame([("g", s) for s in sims], "group_id string, similarity double")
    return dedupe.classify_groups(candidates, similarities).first()["class"]


def test_classify(spark):
    assert _group(spark, [0.95, 0.99]) == dedupe.SYNCED
    assert _group(spark, [0.95, 0.4]) == dedupe.UNCLEAR
    assert _group(spark, [0.95, 0.4], developer=["x", "y", "x"]) == dedupe.INDEPENDENT
    assert _group(spark, [0.95, 0.6], count=[5, 6, 5]) == dedupe.VERSIONS
    assert _group(spark, [0.95], date=["a", "b", ""]) == dedupe.VERSIONS
    assert _group(spark, []) == dedupe.UNCLEAR


def test_pair_similarity(spark):
    r = random.Random(3)
    bodies = ["".join(r.choice("abcd ") for _ in range(300)) for _ in range(4)] + [("abcd" * 80), ("abcx" * 80)]
    rows = [("g", i, b, None) for i, b in enumerate(bodies)] + [("g", 9, "x", "broken")]
    got = {(x["i"], x["j"]): x["similarity"] for x in dedupe.pair_similarities(spark.createDataFrame(rows, "group_id string, idx int, body string, error string")).collect()}
    assert got == {(i, j): SequenceMatcher(None, bodies[i], bodies[j]).ratio() for i in range(6) for j in range(i + 1, 6)}


def test_source_selection(spark):
    rows = [("A", ["1 A.docx"]), ("mnemosyne", ["2 M (LS).docx", "2 M.docx"]), ("WOUNDS", ["3 W (LS).docx", "3 W.docx"]), ("OTHER", ["4 O (LS).docx", "4 O.docx"]), ("WOUNDS", ["5 a.docx", "5 b.docx"])]
    got = dedupe.resolve_source(spark.createDataFrame(rows, "title string, paths array<string>")).collect()
    assert [r["source"] for r in got] == ["1 A.docx", "2 M (LS).docx", "3 W.docx", None, None]
    assert [r["error"] is None for r in got] == [True, True, True, False, False]
    with pytest.raises(Exception, match="no leading number"):
        dedupe.discover(spark.createDataFrame([("in/x.docx",)], "path string")).collect()


def test_costs(value, spark):
    assert value(lambda: cost.cost(F.lit(600_000), F.lit(400_000), F.lit(500_000), F.lit(20.0))) == pytest.approx(10.0)
    live = [F.lit(990_000), F.lit(True), F.lit(990_000), F.lit(1_000_000)]
    assert value(lambda: cost.live_cost(live[0], live[1], live[2], live[3], F.lit(0), F.lit(500_000), F.lit(20.0))) == pytest.approx(19.6)
    assert value(lambda: cost.live_cost(F.lit(9), F.lit(True), F.lit(5), F.lit(None).cast("long"), F.lit(0), F.lit(0), F.lit(20.0))) == 0.0
    assert cost.price_table(spark).count() == 4


def test_budget_skips(spark):
    sizes = [60, 50, 30, 20, 10]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "run int, i int, n int")
    got = [(r["admitted"], r["used"]) for r in cost.within_budget(df, ["run"], "i", "n", 100).orderBy("i").collect()]
    assert got == [(True, 60), (False, 60), (True, 90), (False, 90), (True, 100)]


def test_budget_of_a_long_run(spark):
    df = spark.range(300_000).select(F.lit(1).alias("run"), F.col("id").alias("i"), (F.col("id") % 7).alias("n"))
    assert cost.within_budget(df, ["run"], "i", "n", 1000).filter("admitted").agg(F.max("used")).first()[0] == 1000
    ties = spark.createDataFrame([(1, 0, 5), (1, 0, 5), (1, 0, None)], "run int, i int, n int")
    assert sorted(r["used"] for r in cost.within_budget(ties, [], "i", "n", 9).collect()) == [0, 5, 5]


def test_merge(spark):
    sources = spark.createDataFrame([(0, "a.pdf", "", 5), (1, "b.pdf", "3-1", 3), (2, "in/a.pdf", "2", 2), (3, "e.pdf", "", 0)], "seq int, path string, spec string, n_pages int")
    pages = [(r["seq"], r["source_page"], r["output_page"]) for r in merge.selected_pages(sources).orderBy("output_page").collect()]
    assert pages == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (1, 2, 5), (1, 1, 6), (1, 0, 7), (2, 1, 8)]
    toc = spark.createDataFrame([(0, i, 1, f"A Chapter {i + 1}", i + 1) for i in range(5)], "seq int, entry int, level int, title string, page int")
    got = [(r["title"], r["page"]) for r in merge.contents(sources, toc).orderBy("page").collect()]
    assert got == [(f"A Chapter {i + 1}", i + 1) for i in range(5)] + [("b.pdf (3-1)", 6), ("a.pdf (2)", 9)]
    assert merge.merge_stats(sources).first().asDict() == {"segments": 4, "files_processed": 4, "pages_written": 9, "batches": 0}
    bad = sources.withColumn("spec", F.lit("9")).withColumn("exists", F.lit(False))
    assert {len(r["errors"]) for r in merge.source_errors(bad).collect()} == {2}
    with pytest.raises(Exception, match="out of range|no pages"):
        merge.selected_pages(bad).collect()


def test_edits_and_terms(spark):
    records = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "c", 3)], "i int, text string, size int")
    edits = spark.createDataFrame([(1, None, True, 9, False), (7, "x", True, 1, True)], "i int, text string, has_text boolean, size int, has_size boolean")
    assert [(r["text"], r["size"]) for r in merge.apply_edits(records, edits, ["i"], ["text", "size"]).orderBy("i").collect()] == [("a", 1), (None, 2), ("c", 3)]
    terms = spark.createDataFrame([(0, "Clavis"), (1, "CLAVIS"), (2, " clavis "), (3, "Arboretum"), (4, " ")], "o int, term string")
    folded = spark.createDataFrame([(1, "STRASSE"), (0, "Straße")], "o int, term string")
    assert [r["term"] for r in merge.first_spellings(folded, "term", "o").collect()] == ["Straße"]
    assert [r["term"] for r in merge.first_spellings(terms, "term", "o").orderBy("o").collect()] == ["Clavis", "Arboretum"]
    new = spark.createDataFrame([(0, "clavis"), (1, "VIRELICON"), (2, "virelicon"), (3, "Acme")], "o int, term string")
    assert [r["term"] for r in merge.added_terms(terms, new, "term", "o").collect()] == ["Clavis", "CLAVIS", "clavis", "Arboretum", "VIRELICON", "Acme"]


def in_turn(wanted, taken=()):
    """Brute force: each name in turn takes the first of its forms that is free."""
    used, out = set(taken), []
    for name in wanted:
        path = PurePosixPath(name)
        n = 1
        while (candidate := name if n == 1 else f"{path.stem} ({n}){path.suffix}") in used:
            n += 1
        used.add(candidate)
        out.append(candidate)
    return out


def given(spark, wanted, taken=(), **options):
    df = spark.createDataFrame(list(enumerate(wanted)), "o int, name string")
    blocked = spark.createDataFrame([(t,) for t in taken], "name string") if taken else None
    return [r["destination"] for r in merge.free_names(df, "name", "o", blocked, **options).orderBy("o").collect()]


def test_free_names(spark):
    assert given(spark, ["a.pdf", "a.pdf", "b/c", "a.pdf"]) == ["a.pdf", "a (2).pdf", "b_c", "a (3).pdf"]
    assert given(spark, ["a.pdf", "a.pdf", "a (2).pdf"]) == ["a.pdf", "a (2).pdf", "a (2) (2).pdf"]
    assert given(spark, ["b.pdf"], ["b.pdf", "b (2).pdf"]) == ["b (3).pdf"]
    assert given(spark, ["x", None, " ", "Y.PDF"], extension=".pdf") == ["x.pdf", "unbenannt.pdf", "unbenannt (2).pdf", "Y.PDF"]
    r = random.Random(8)
    forms = [f"{stem}{number}{suffix}" for stem in ("a", "b.c", ".d") for number in ("", " (1)", " (2)", " (3)", " (2) (2)", " (02)") for suffix in (".pdf", "")]
    wanted, taken = [r.choice(forms) for _ in range(400)], r.sample(forms, 8)
    got = given(spark, wanted, taken)
    assert got == in_turn(wanted, taken) and len(set(got)) == len(got) and not set(got) & set(taken)


def test_translated_name(value):
    for language, expected in (("de", "t_DE.pdf"), ("pt-br", "t_PTBR.pdf"), (" ", "t_TRANSLATED.pdf"), (None, "t_TRANSLATED.pdf")):
        assert value(lambda lang: merge.translated_name(F.lit("in/t.pdf"), lang), (language, "string")) == expected


def test_translation(spark):
    rows = [(1, 0, "Hello WISDOM", True), (1, 1, " ", True), (1, 2, "skip", False), (1, 3, "x [[fail]]", True), (2, 0, None, True)]
    units = spark.createDataFrame(rows, "doc_id int, unit_index int, text string, translatable boolean")
    done = translate.translate_units(units, "echo", "DE", terms=["wisdom"])
    got = [(r["status"], r["translated"], r["chars_sent"]) for r in done.orderBy("doc_id", "unit_index").collect()]
    assert got == [("translated", "[DE] Hello WISDOM", 11), ("skipped", None, 0), ("skipped", None, 0), ("failed", None, 0), ("skipped", None, 0)]
    stats = translate.outcome_stats(done, ["doc_id"]).filter("doc_id = 1").first()
    assert (stats["units"], stats["translated"], stats["skipped"], stats["failed"], stats["chars_sent"]) == (4, 1, 2, 1, 11)
    tight = translate.translate_units(units, "echo", "DE", run=["doc_id"], budget=11).orderBy("doc_id", "unit_index").collect()
    assert tight[0]["status"] == "failed" and tight[0]["error"] == "over budget" and tight[3]["status"] == "failed"
    with pytest.raises(translate.UnknownProvider, match="echo"):
        translate.translate_units(units, "nobody", "DE")
    documents = spark.createDataFrame([(1, None), (2, "boom")], "doc_id int, error string")
    batch = translate.batch_stats(done, documents).first()
    assert (batch["documents_planned"], batch["documents_failed"], batch["units_translated"]) == (2, 1, 1)
    compared = translate.compare_providers(units.filter("doc_id = 1 and unit_index in (0, 3)"), ["echo"], "DE", "unit_index").orderBy("unit_index").collect()
    assert compared[0]["echo"] == "[DE] Hello WISDOM" and compared[1]["echo"].startswith("[ValueError")
    a = translate.analysis(spark, units, "deepl", 0).first()
    assert (a["characters"], a["estimate"], a["warnings"]) == (22, 0.0, ["warning.live_quota_unavailable"])
