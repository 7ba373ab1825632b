import random

from loomq.llm import licenses as li
from loomq.llm.decontamination import words_of


def test_exact_occurrences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = li.Index(li.TEMPLATES)
    out = {r["doc_id"]: r for r in li.licenses(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        words = words_of(r["text"].encode())
        exact = {n for n, t in zip(index.names, index.words) if any(words[i : i + len(t)] == t for i in range(len(words) - len(t) + 1))}
        found = set(filter(None, out[r["doc_id"]]["licenses"].split(",")))
        assert exact <= found
        for span in filter(None, out[r["doc_id"]]["spans"].split(",")):
            name, a, b, share = span.split(":")
            if float(share) == 1:
                assert words_of(r["text"][int(a) : int(b)].encode()) == index.words[index.names.index(name)]


def test_changed_templates():
    r, index = random.Random(8), li.Index(li.TEMPLATES)
    for n, (name, template) in enumerate(zip(index.names, index.words)):
        if len(template) < 25:
            continue
        changed = [w for w in template if r.random() > 0.04]
        text = [b"before%d" % i for i in range(n)] + changed + [b"after"] * 9
        found = [m for m in li.matches(index, text, 0.8) if m[2] == n]
        assert len(found) == 1 and found[0][3] >= 0.9, name
        assert abs(found[0][0] - n) <= 2 and abs(found[0][1] - (n + len(changed) - 1)) <= 2
        assert not [m for m in li.matches(index, template[: len(template) // 2], 0.8) if m[2] == n]


def test_neighbours_and_ties():
    index = li.Index(li.TEMPLATES)
    found = li.matches(index, words_of(b"All rights reserved. All rights reserved! x all rights reserved"), 0.8)
    assert [m[:2] for m in found] == [(0, 2), (3, 5), (7, 9)]


def test_one_word_changed_anywhere():
    index = li.Index(li.TEMPLATES)
    for t, template in enumerate(index.words):
        allowed = len(template) - index.least[t]
        for p in range(len(template)) if allowed else ():
            for text in (template[:p] + [b"zzz"] + template[p + 1 :], template[:p] + template[p + 1 :]):
                found = [m for m in li.matches(index, [b"x", *text, b"y"], 0.8) if m[2] == t]
                assert len(found) == 1 and found[0][3] == (len(template) - 1) / len(template)
    for text in (b"Licensed under the MIT License", b"Distributed under the MIT License."):
        assert [index.names[m[2]] for m in li.matches(index, words_of(text), 0.8)] == ["mit"]


def test_as_many_words_changed_as_the_coverage_allows():
    r, index = random.Random(3), li.Index(li.TEMPLATES)
    for t, template in enumerate(index.words):
        for _ in range(20):
            gone = set(r.sample(range(len(template)), min(len(template) - index.least[t], li.BAND)))
            text = [w for p, w in enumerate(template) if p not in gone]
            covered = max(li.align(template, text, d)[0] for d in range(-li.BAND, 1))
            if covered >= 0.8 * len(template):
                assert [m for m in li.matches(index, text, 0.8) if m[2] == t]


def test_a_weaker_match_beside_a_better_one():
    index = li.Index(li.TEMPLATES)
    found = li.matches(index, words_of(b"Licensed under the MIT License. Released under the MIT License."), 0.8)
    assert [(m[0], m[1], round(m[3], 1)) for m in found] == [(1, 4, 0.8), (5, 9, 1.0)]


def test_parts_of_a_text():
    """Every run of PART words of a long template is found, also with words changed around it, at its place."""
    r, index = random.Random(12), li.Index(li.TEMPLATES)
    for t, template in enumerate(index.words):
        for _ in range(12 if len(template) >= 2 * li.PART else 0):
            n = r.randint(li.PART, max(li.PART, index.least[t] - 1))
            if n >= index.least[t]:
                continue
            p = r.randrange(len(template) - n + 1)
            before, after = [b"w%d" % r.randrange(99) for _ in range(r.randrange(9))], [b"v%d" % r.randrange(99) for _ in range(r.randrange(9))]
            text = before + template[p : p + n] + after
            whole = li.matches(index, text, 0.8)
            found = li.parts(index, text, whole) + whole
            at = (len(before), len(before) + n - 1)
            # another template's whole or better match may stand for it
            assert any(a <= at[0] and at[1] <= b for a, b, own, share in found if own == t or share >= n / len(template)), (index.names[t], p, n)


def test_extension_is_the_best_alignment():
    """Against the full matrix, without a band and without an early end."""
    r = random.Random(9)
    for _ in range(400):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(1, 9))] for _ in range(2))
        best, rows = (0, 0), [[(li.GAP * j, 0) for j in range(len(b) + 1)]]
        for i, x in enumerate(a, 1):
            row = [(li.GAP * i, 0)]
            for j, y in enumerate(b, 1):
                cell = max((rows[-1][j][0] + li.GAP, rows[-1][j][1]), (row[-1][0] + li.GAP, row[-1][1]))
                through = (rows[-1][j - 1][0] + (li.MATCH if x == y else li.MISMATCH), rows[-1][j - 1][1] + (x == y))
                row.append(max(cell, through))
                if x == y and row[-1] == through:
                    best = max(best, through)
            rows.append(row)
        assert li.extend(a, b, drop=10**6)[0] == best[1]


def test_a_paragraph_of_a_long_license(spark, tmp_path):
    r = random.Random(2)
    long = " ".join(f"term{r.randrange(4000)}" for _ in range(6_000))
    (tmp_path / "LONG-1").write_text(long)
    templates = li.TEMPLATES | li.template_files(str(tmp_path))
    words = long.split()
    part = words[3000:3400]
    part[50:52], part[200:200] = ["changed"], ["two", "more"]
    df = spark.createDataFrame([(1, "intro " + " ".join(part) + " outro"), (2, long), (3, "no license")], "doc_id long, text string")
    out = {x["doc_id"]: x for x in li.licenses(df, templates).collect()}
    name, a, b, share = out[1]["partial"].split(":")
    assert name == "LONG-1-text" and (int(a), int(b)) == (6, 6 + len(" ".join(part))) and float(share) == round(398 / 6000, 3) and out[1]["n_matches"] == 0
    assert out[2]["licenses"] == "LONG-1-text" and out[2]["best_coverage"] == 1 and out[2]["partial"] == "" and out[3]["best_coverage"] == 0


def test_whole_texts_and_paragraphs(spark):
    index = li.Index(li.TEMPLATES)
    for name in ("mit-text", "bsd-3-clause-text", "isc-text", "zlib-text", "unlicense-text"):
        found = {index.names[m[2]]: m[3] for m in li.matches(index, words_of(li.TEMPLATES[name].encode()), 0.8)}
        assert found[name] == 1.0
    half = words_of(li.TEMPLATES["zlib-text"].encode())[:70]
    text = [b"x", *half, b"y"]
    whole = li.matches(index, text, 0.8)
    assert [(m[0], m[1], index.names[m[2]]) for m in li.parts(index, text, whole)] == [(1, 70, "zlib-text")] and not whole


def test_odd(odd, empty):
    out = li.licenses(odd).collect()
    assert len(out) == odd.count() and all(r["n_matches"] == 0 and r["spans"] == "" for r in out)
    assert li.licenses(empty).count() == 0
