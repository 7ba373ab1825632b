import math
from collections import Counter

import numpy as np

from loomq.llm import backoff as b
from loomq.llm.decontamination import words_of


def brute(rows, least=2, alpha=0.4):
    docs = [(i, words_of((t or "").encode())) for i, t in rows]
    counts = [Counter(tuple(w[i - k : i + 1]) for _, w in docs for i in range(k, len(w))) for k in range(3)]
    total = sum(counts[0].values())
    out = []
    for doc_id, w in docs:
        score, short = 0.0, 0
        for i in range(len(w)):
            for k in range(min(i, 2), -1, -1):
                n = counts[k][tuple(w[i - k : i + 1])]
                if k == 0 or n >= least:
                    score += math.log(n / (counts[k - 1][tuple(w[i - k : i])] if k else total)) + (min(i, 2) - k) * math.log(alpha)
                    short += min(i, 2) - k
                    break
        out.append((doc_id, len(w), short, round(score, 4)))
    return sorted(out, key=str)


def test_against_brute_force(docs, rows, odd, empty):
    for df, known in ((docs, rows), (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        for blocks in ({}, {"block_bytes": 60_000, "partition_bytes": 90_000}):
            got = sorted(((r["doc_id"], r["n_words"], r["n_backoffs"], r["log_score"]) for r in b.backoff_scores(df, **blocks).collect()), key=str)
            assert [x[:3] for x in got] == [x[:3] for x in brute(known)]
            assert all(abs(x[3] - y[3]) < 2e-4 for x, y in zip(got, brute(known)))
    assert b.backoff_scores(empty).count() == 0


def test_packing_numbers():
    for values in ([], [0], [255, 256, 1 << 40], [(1 << 64) - 1, 0]):
        array = np.array(values, np.uint64)
        assert b._unpacked(b._packed(array)).tolist() == values


def test_width_of_hashes():
    assert b.hash_bits(0, 3) <= b.hash_bits(10**9, 3) < b.hash_bits(10**12, 3) <= 64 == b.hash_bits(10**14, 3)
    texts = [b"a b c d a b c", b"", b"x"]
    wide, narrow = (b.block_grams(texts, 3, bits)[2] for bits in (64, 40))
    assert all((w >> np.uint64(24) == n).all() for w, n in zip(wide, narrow))


def test_partitions_are_ranges():
    r = np.random.default_rng(5)
    for bits, parts in ((40, 1), (40, 7), (58, 63), (64, 1000)):
        hashes = np.sort(r.integers(0, (1 << bits) - 1, 4000, np.uint64))
        part = b.part_of(hashes, parts, bits)
        assert (np.diff(part.astype(np.int64)) >= 0).all() and part.max() < parts
        for p, h in zip(part.tolist(), hashes.tolist()):
            assert b.first_of(p, parts, bits) <= h and (p + 1 == parts or h < b.first_of(p + 1, parts, bits))


def test_equal_rows_fall_into_many_blocks(spark):
    """Rows that are equal in id and text go by the partition they lie in, and the scores are those of all rows."""
    df = spark.range(4000).selectExpr("IF(id % 10 = 0, id, 7) AS doc_id", "IF(id % 10 = 0, concat('w', id % 13, ' common words'), 'the same few words again') AS text").repartition(8)
    blocks = df.filter("doc_id = 7").select(b.block_of(50).alias("block")).groupBy("block").count().collect()
    assert len(blocks) >= 5 and max(r["count"] for r in blocks) < 1500
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_backoffs"]) for r in b.backoff_scores(df, block_bytes=2_000, partition_bytes=9_000).collect()), key=str)
    assert got == [x[:3] for x in brute(rows)]
