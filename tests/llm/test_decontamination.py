import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest

from loomq.llm import decontamination as d

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if items := windows.get(tuple(w[i : i + n])):
                    found |= items
                    hit.update(range(i, i + n))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 2_000])
def test_against_brute_force(spark, block_bytes):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, known = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    assert got(d.decontaminate(docs, items, block_bytes=block_bytes)) == brute(rows, known)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 13])
def test_windows_of_repeating_words(width):
    """Items and texts over few words, so that cuts and windows occur over and over, also with few letters to give out."""
    r = random.Random(width)
    for letters in (d.LETTERS, 12):
        for _ in range(120):
            line = lambda n: " ".join(r.choice("abc") + r.choice(["", "", "x"]) for _ in range(r.randrange(n)))
            items = [(str(k), line(40)) for k in range(r.randrange(8))]
            texts = [(k, line(90) if r.random() < 0.6 or not items else f"{line(9)} {r.choice(items)[1]} {line(9)}") for k in range(6)]
            windows = d.Windows([(k, t.encode()) for k, t in items], width, letters)
            out = []
            for k, t in texts:
                spans, found = windows.scan(d.words_of(t.encode()))
                assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:]))
                n = sum(b - a + 1 for a, b in spans)
                out.append((k, len(words(t)), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(words(t))))
            assert sorted(out, key=str) == brute(texts, items, width)


def test_memory_of_a_large_benchmark():
    """4 MB of a benchmark in a process of its own: the automaton stays within 30 bytes for each of the text."""
    code = """
import random, resource, sys, time
from loomq.llm.decontamination import Windows, words_of
r = random.Random(1)
stock = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(60_000)]
items = [(str(i), " ".join(r.choices(stock, k=120)).encode()) for i in range(int(sys.argv[1]) * 1_000_000 // 840)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
w = Windows(items, 13)
assert w.scan(words_of(b"x " + items[5][1] + b" y"))[1] == {"5"}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / sum(len(t) for _, t in items))
"""
    out = subprocess.run([sys.executable, "-c", code, "4"], capture_output=True, text=True, check=True, cwd=Path(d.__file__).parents[2])
    assert float(out.stdout) < 30


def test_odd_rows(spark, odd, empty):
    items = [(1, "A b"), (2, "gamma1"), (3, ""), (4, None), (None, "a"), (2, "gamma1"), (5, "x")]
    known = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, n_words string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    usable = [i for i in items if i[0] is not None and i[1] is not None]
    assert got(d.decontaminate(odd, known)) == brute(rows, usable)
    assert d.decontaminate(empty, known).count() == 0
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in d.decontaminate(odd, known.filter("false")).collect())


def test_filter_agrees(spark, odd):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = {r["doc_id"] for r in d.decontaminate(docs, items).filter("not contaminated").collect()}
    for size in (d.BLOCK_BYTES, 2_000):
        kept = d.drop_contaminated(docs, items, block_bytes=size)
        assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == docs.columns
    assert d.drop_contaminated(odd, items).count() == odd.count()


def test_spans_map_to_the_text(spark):
    df = spark.createDataFrame([(1, "Ünïq: The QUICK, brown-fox! é end")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown FOX")], "item_id long, text string")
    r = d.benchmark_hits(df, items).first()
    assert "Ünïq: The QUICK, brown-fox! é end"[r["char_start"][0] : r["char_end"][0]] == "QUICK, brown-fox" and r["items"] == ["7"]


@pytest.mark.parametrize("many", [0, 1, 3])
@pytest.mark.parametrize("width", [1, 2, 3, 5, 13])
def test_index_of_surroundings(width, many, monkeypatch):
    """The same texts where cuts are indexed as where they aren't."""
    monkeypatch.setattr(d, "MANY", many)
    test_windows_of_repeating_words(width)


def test_phrase_that_many_items_share():
    """100,000 items begin alike: an occurrence of the phrase without an item costs little, one with an item finds it."""
    import time

    phrase = "answer the following multiple choice question about"
    items = [(str(i), f"{phrase} topic{i} and its part{i % 977} of kind{i % 31} with one more word{i} here".encode()) for i in range(100_000)]
    windows = d.Windows(items, 13)
    none = d.words_of(f"{phrase} nothing at all we know of it and ".encode() * 5_000)
    began = time.perf_counter()
    assert windows.scan(none) == ([], set())
    took = time.perf_counter() - began
    assert took / 5_000 < 0.0001
    some = d.words_of(f"x {phrase} topic77 and its part77 of kind15 with one more word77 here {phrase} topic5 and nothing".encode())
    assert windows.scan(some) == ([[1, 18]], {"77"})


def test_window_that_many_items_share():
    """All of a thousand items are found, and a text that repeats them looks at them once."""
    shared = " ".join(f"w{i}" for i in range(13))
    windows = d.Windows([(str(i), f"{shared} own{i} more{i}".encode()) for i in range(1000)], 13)
    spans, found = windows.scan(d.words_of((shared + " z ").encode() * 2000))
    assert len(found) == 1000 and len(spans) == 2000 and all(b - a == 12 for a, b in spans)
