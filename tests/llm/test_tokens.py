import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomq.llm import packing, token_counts

BYTES, WORDS = Tokenizer.from_file(token_counts.VOCABULARY), Tokenizer.from_file(packing.VOCABULARY)
TEXT = st.text(st.one_of(st.sampled_from("abc  \t\n\r\x0b\x1c\x85\xa0'strelvmd123²ªº_-!?éßİſŸ<|>"), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(text):
    for t in (text, text + "<|endoftext|>" + text):
        assert token_counts.counter(token_counts.VOCABULARY).count(t) == len(BYTES.encode(t, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_equal_the_library(text):
    for t in (text, text + "<|startoftext|>" + text):
        got = np.frombuffer(packing.word_ids(packing.VOCABULARY).ids(t), "<u2").tolist()
        assert got == WORDS.encode(t, add_special_tokens=False).ids


def test_token_counts(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    for doc_id, text in rows:
        n = len(BYTES.encode(text, add_special_tokens=False).ids)
        assert (got[doc_id]["n_bytes"], got[doc_id]["n_tokens"], got[doc_id]["over_limit"]) == (len(text.encode()), n, n > 1024)
    out = token_counts.token_counts(odd).collect()
    assert len(out) == odd.count() and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert token_counts.token_counts(empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=60))
def test_packing_holds_every_item_once(lengths):
    cover = {}
    for window in packing.pack_lengths(lengths):
        total = sum(n for _, _, n in window)
        assert 0 < total <= 2048 and total & (total - 1) == 0
        for item, start, n in window:
            assert n > 0
            cover.setdefault(item, []).append((start, n))
    for item, length in enumerate(lengths):
        at = 0
        for start, n in sorted(cover.get(item, [])):
            assert start == at
            at += n
        assert at == length


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(1, 90))
def test_closest_fill(stock, capacity):
    sums = {0: True}
    for length, n in stock.items():
        for _ in range(n):
            sums |= {s + length: True for s in list(sums) if s + length <= capacity}
    total, taken = packing.closest_fill(stock, capacity)
    assert total == max(sums) == sum(k * n for k, n in taken) and all(n <= stock[k] for k, n in taken)


def _check(pieces, rows):
    """Every document's identifiers lie in exactly one piece, and sequences have no gaps."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    for doc_id, text in rows:
        ids = [*WORDS.encode(text or "", add_special_tokens=False).ids, 1]
        own = by_doc[(doc_id, len(ids))]
        starts = sorted(p["start"] for p in own)
        if len(set(starts)) == len(starts):
            assert b"".join(p["ids"] for p in sorted(own, key=lambda p: p["start"])) == np.array(ids, "<u2").tobytes()
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part)
    return by_sequence


def test_pack(docs, rows, odd, empty):
    for bucket in (packing.BUCKET_DOCUMENTS, 30):
        sequences = _check(packing.pack(docs, bucket_documents=bucket).collect(), rows)
    short = [s for s in sequences.values() if sum(p["length"] for p in s) < 2048]
    assert all(bin(sum(p["length"] for p in s)).count("1") == 1 for s in short)
    _check(packing.pack(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(empty).count() == 0
    assert "ids" not in packing.pack(docs, with_ids=False).columns


@pytest.mark.parametrize("word", ["the", "tokenization", "éclair", "zzzzqqqq", "日本語"])
def test_merges(word):
    counter = token_counts.counter(token_counts.VOCABULARY)
    assert len(word.encode()) - counter.merges(word.encode()) == len(BYTES.encode(word).ids)


def test_other_special_strings(tmp_path):
    """A vocabulary whose special strings have nothing in common with the given ones."""
    import json

    for path, added in ((token_counts.VOCABULARY, ["[SEP]", "[PAD]"]), (packing.VOCABULARY, ["@@", "¶"])):
        spec = json.load(open(path, encoding="utf-8"))
        spec["added_tokens"] = [dict(id=i, content=c, single_word=False, lstrip=False, rstrip=False, normalized=False, special=True) for i, c in zip((5, 6), added)]
        other = str(tmp_path / "other.json")
        json.dump(spec, open(other, "w"))
        library = Tokenizer.from_file(other)
        for text in (f"one {added[0]}two{added[1]} {added[0]}", "plain <|endoftext|> text", added[1]):
            wanted = library.encode(text, add_special_tokens=False).ids
            if path == token_counts.VOCABULARY:
                assert token_counts.MergeCounter(other).count(text) == len(wanted)
            else:
                assert np.frombuffer(packing.WordIds(other).ids(text), "<u2").tolist() == wanted


def test_copies_and_long_texts_are_spread(spark):
    """Rows that are equal in every column fall into all buckets; of a text's full windows no identifiers move."""
    rows = [(None, "the same words again")] * 3_000 + [(7, "a longer text " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack(df, bucket_documents=100).collect()
    buckets = {}
    for p in pieces:
        buckets[p["sequence_id"] >> 40] = buckets.get(p["sequence_id"] >> 40, 0) + 1
    assert len(buckets) == 31 and max(buckets.values()) < 200
    assert sum(p["length"] for p in pieces if p["doc_id"] == 7) == 60_001
    by_sequence = _check(pieces, [(7, "a longer text " * 20_000)] + [(None, "the same words again")])
    assert sum(len(s) == 1 and s[0]["length"] == 2048 and s[0]["doc_id"] == 7 for s in by_sequence.values()) >= 29


def test_dealing_in_any_order(rows):
    """A task that sees its rows in another order deals the same pieces to the same buckets, copies included."""
    pieces = [(k, 0, (t or "").encode()[:60]) for k, t in rows[:80]] + [(7, 0, b"same")] * 50 + [(None, 0, b"same")] * 5 + [(0, 0, b"same")] * 5

    def dealt(order):
        deal = packing.Dealer(64)
        return sorted((str(p), deal(*p)) for p in order)

    assert dealt(pieces) == dealt(pieces[::-1]) == dealt(pieces[50:] + pieces[:50])
    assert len({b for p, b in dealt(pieces) if p == str((7, 0, b"same"))}) > 20


def test_shuffled_input_read_twice(spark, docs):
    """The same rows in partitions of another inner order give the same pieces of the same sequences."""
    fixed = docs.repartition(3, "doc_id")
    one = packing.pack(fixed.sortWithinPartitions("doc_id"), bucket_documents=50).collect()
    other = packing.pack(fixed.sortWithinPartitions("text"), bucket_documents=50).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_buckets_of_long_texts(spark):
    """Long texts get buckets of a bounded size in bytes, however few documents there are."""
    df = spark.range(40).selectExpr("id AS doc_id", "repeat('some words to pack here ', 400) AS text")
    pieces = packing.pack(df, bucket_bytes=50_000).collect()
    assert len({p["sequence_id"] >> 40 for p in pieces}) >= 6 and {p["doc_id"] for p in pieces} == set(range(40))
