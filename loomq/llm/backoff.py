"""Language-model scores by stupid backoff over the corpus's own n-gram counts.

The computation is a join of exploded n-grams with count tables that are partitioned by the n-grams' hash, in blocks
instead of rows. Documents are dealt into blocks. A block explodes its n-grams once and sends, to each partition of the
hash range, its distinct n-grams with their number in the block, as one sorted and packed row. A partition adds up what
all blocks sent, which is its part of the count tables, and returns to each block the corpus counts of that block's
n-grams in the same order. The block, which has the same documents through the same shuffle, looks its n-grams up and
sums the scores of each document. A very frequent n-gram costs one entry a block, however often it occurs.

Blocks and partitions are sized by bytes of text. A block sends a partition at most one row and at least one n-gram a
row, so the rows never outnumber those of a join of single n-grams. Hashes are as wide as the corpus needs for a wrong
look-up to have a chance of at most one in 2**28, 64 bits at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.llm.common import documents_of, hold, record_batch
from loomq.llm.decontamination import words_of
from loomq.session import expose_package, materialize

ORDER, BACKOFF, LEAST_COUNT = 3, 0.4, 2
#: Mean bytes of text of a block, and of what one partition of the count tables holds the n-grams of.
BLOCK_BYTES, PARTITION_BYTES = 10_000_000, 12_000_000
#: Parts in which a block's n-grams are sorted, so that the sort needs a part of the memory.
PASSES = 6
#: Bits of a hash beyond those that number the corpus's n-grams.
SPARE_BITS = 28
#: Words whose hashes a worker keeps.
KEPT_WORDS = 200_000

_SENT = "part long, block long, n long, grams binary, counts binary"
_SENT_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_BACK = "part long, block long, counts binary"
_BACK_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("counts", pa.binary())])
_SCORED = "doc_id long, n_words long, n_backoffs long, n_unigrams long, logs double"
_SCORED_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_backoffs", "n_unigrams")] + [("logs", pa.float64())])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS and len(word) <= 64:
            self[word] = value
        return value


_hashes = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_bits(size: int, order: int) -> int:
    """The width of the hashes for so many bytes of text, which have at most a word for every two."""
    return min(64, max(40, (order * (size + 1) // 2).bit_length() + SPARE_BITS))


def block_grams(texts: list[bytes], order: int, bits: int = 64) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """Words of each text, each word's place in its text (from the order on the same), and for each order the hash of the n-gram that ends there.

    Places with fewer words before them than an order needs hold that order's n-gram of lower order, which is ignored.
    """
    hold("backoff", _hashes.clear)
    sizes, parts = [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    starts = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) if sizes else np.zeros(0, np.int64)
    place = np.minimum(np.arange(len(words)) - starts, order).astype(np.int8)  # no more than the order matters
    del parts, starts
    grams = [_mixed(words + np.uint64(0x9E3779B97F4A7C15))]
    for k in range(1, order):
        longer = grams[-1].copy()
        longer[1:] = _mixed(grams[-1][:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:] * np.uint64(0xCA5A826395121157) + np.uint64(k))
        grams.append(longer)
    if bits < 64:
        for g in grams:
            g >>= np.uint64(64 - bits)
    return sizes, place, grams


def part_of(grams: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The partition of each hash; partitions are ranges of it."""
    return ((grams >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


def first_of(part: int, parts: int, bits: int) -> int:
    """The least hash of a partition."""
    return -(-(part << 32) // parts) << (bits - 32)


def _ranges(parts: int) -> list[tuple[int, int]]:
    """First and last partition of a few ranges, in which a block's n-grams are sorted one after the other."""
    n = min(PASSES, parts)
    return [(i * parts // n, (i + 1) * parts // n) for i in range(n)]


def _in_range(place: np.ndarray, grams: list[np.ndarray], low: int, high: int, parts: int, bits: int) -> list[np.ndarray]:
    """Where, for each order, a real n-gram's hash lies in the partitions from low on, high excluded."""
    found = []
    for k, g in enumerate(grams):
        keep = place >= k
        if low:
            keep &= g >= np.uint64(first_of(low, parts, bits))
        if high < parts:
            keep &= g < np.uint64(first_of(high, parts, bits))
        found.append(np.flatnonzero(keep).astype(np.int32))
    return found


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their low bytes, each compressed on its own; the high planes are nearly constant."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    parts = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, i]).tobytes()) for i in range(width)]
    return b"".join([bytes([width]), *[len(p).to_bytes(4, "little") for p in parts], *parts])


def _unpacked(data: bytes) -> np.ndarray:
    width, columns = data[0], []
    at = 1 + 4 * width
    for i in range(width):
        end = at + int.from_bytes(data[1 + 4 * i : 5 + 4 * i], "little")
        columns.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at:end]), np.uint8))
        at = end
    wide = np.zeros((len(columns[0]), 8), np.uint8)
    for i, column in enumerate(columns):
        wide[:, i] = column
    return wide.view("<u8").ravel()


def _block_texts(rows: pa.Table) -> tuple[pa.Table, list[bytes]]:
    return rows, [x or b"" for x in rows.column("text").cast(pa.binary()).to_pylist()]


def block_of(blocks: int) -> Column:
    """The block of a row: by its id, its text, and the partition that it is read in.

    However many rows are equal, no block gets more of them than a partition has; and the rows of a partition are the
    same whenever it is computed again, in whatever order.
    """
    return F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))


def backoff_scores(
    df: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """The stupid-backoff score of every text under the n-gram counts of all of them.

    Words are runs of ASCII letters, digits and any other characters, A-Z lower-cased. A word's score is the count of
    the longest n-gram ending at it, of at most order words, over the count of that n-gram without the word, times
    backoff for each order it fell short of; n-grams of two words and more count as unseen below least_count; a single
    word is divided by the number of words. Counts take every row, repeated ones included.

    One row for each row: doc_id, n_words, n_backoffs (orders fallen short of), log_score (sum of natural logarithms)
    and mean_log_score (0 without words), both rounded to 4 places. Texts that are null or have no words score 0.
    """
    docs = documents_of(df, id_col, text_col)
    expose_package(df.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, parts, bits = max(1, -(-size // block_bytes)), max(1, -(-size // partition_bytes)), hash_bits(size, order)
    dealt = docs.withColumn("block", block_of(blocks))

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        _, place, grams = block_grams(_block_texts(rows)[1], order, bits)
        out: list[list] = [[] for _ in _SENT_ARROW]
        for low, high in _ranges(parts):
            at = _in_range(place, grams, low, high, parts, bits)
            found, counts = np.unique(np.concatenate([g[i] for g, i in zip(grams, at)]), return_counts=True)
            part = part_of(found, parts, bits)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(found)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    own = int(part[a])
                    steps = np.diff(found[a:b], prepend=np.uint64(first_of(own, parts, bits)))
                    for column, value in zip(out, (own, key[0].as_py(), b - a, _packed(steps), _packed(counts[a:b]))):
                        column.append(value)
        return pa.Table.from_batches([record_batch(_SENT_ARROW, out)])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        first = np.uint64(first_of(key[0].as_py(), parts, bits))
        grams = np.concatenate([np.cumsum(_unpacked(x), dtype=np.uint64) + first for x in rows.column("grams").to_pylist()])
        counts = np.concatenate([_unpacked(x) for x in rows.column("counts").to_pylist()])
        found, inverse = np.unique(grams, return_inverse=True)
        del grams
        totals = np.zeros(len(found), np.uint64)
        np.add.at(totals, inverse, counts)
        ends = np.cumsum(rows.column("n").to_pylist()).tolist()
        back = [_packed(totals[inverse[a:b]]) for a, b in zip([0, *ends], ends)]
        return pa.Table.from_batches([record_batch(_BACK_ARROW, [rows.column("part").combine_chunks(), rows.column("block").combine_chunks(), back])])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, texts = _block_texts(left)
        sizes, place, grams = block_grams(texts, order, bits)
        right = right.sort_by("part")
        answered, given = right.column("part").to_numpy(), right.column("counts").to_pylist()
        totals = [np.zeros(len(place)) for _ in grams]
        for low, high in _ranges(parts):
            at = _in_range(place, grams, low, high, parts, bits)
            _, inverse = np.unique(np.concatenate([g[i] for g, i in zip(grams, at)]), return_inverse=True)
            if len(inverse):
                counts = np.concatenate(list(map(_unpacked, given[slice(*np.searchsorted(answered, (low, high)))])))
                if len(counts) != int(inverse.max()) + 1:
                    raise RuntimeError("a block's rows are others than those that were counted: the input changed between two reads")
                ends = np.cumsum([0, *map(len, at)])
                for total, i, a, b in zip(totals, at, ends, ends[1:]):
                    total[i] = counts[inverse[a:b]]
        del grams
        logs, used, open_ = np.zeros(len(place)), np.zeros(len(place), np.int8), np.ones(len(place), bool)
        reach = np.minimum(place, order - 1)
        for k in range(order - 1, 0, -1):
            seen = open_ & (totals[k] >= least_count)
            history = np.concatenate([[1.0], totals[k - 1][:-1]])
            logs[seen] = np.log(totals[k][seen] / history[seen])
            used[seen] = k
            open_ &= ~seen
        logs[open_] = np.log(totals[0][open_])
        short = reach - used
        logs += short * math.log(backoff)
        ends = np.cumsum(sizes)
        sums = [np.add.reduceat(np.concatenate([x, [0]]), np.concatenate([[0], ends[:-1]]).astype(np.int64)) if len(x) else np.zeros(len(sizes), x.dtype) for x in (short, open_.astype(np.int64), logs)]
        empty = np.array(sizes) == 0
        short_sum, single_sum, log_sum = (np.where(empty, 0, x) for x in sums)
        return pa.Table.from_batches([record_batch(_SCORED_ARROW, [rows.column("doc_id").combine_chunks(), sizes, short_sum, single_sum, log_sum])])

    sent = dealt.groupBy("block").applyInArrow(send, _SENT)
    back = sent.groupBy("part").applyInArrow(add, _BACK)
    scored = materialize(dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, _SCORED))
    words = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    score_of = F.col("logs") - F.col("n_unigrams") * F.lit(math.log(max(words, 1)))
    mean = F.when(F.col("n_words") > 0, score_of / F.col("n_words")).otherwise(0.0)
    return scored.select("doc_id", "n_words", "n_backoffs", F.round(score_of, 4).alias("log_score"), F.round(mean, 4).alias("mean_log_score"))


#: DuckDB SQL for backoff_scores() with its defaults.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one AS (SELECT c, count(*) AS n FROM t GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM t WHERE i > 1 GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM t WHERE i > 2 GROUP BY a, b, c),
total AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.doc_id, CASE WHEN n3.n >= 2 THEN 0 WHEN n2.n >= 2 THEN least(t.i - 1, 2) - 1 ELSE least(t.i - 1, 2) END AS short,
             CASE WHEN n3.n >= 2 THEN ln(n3.n / h2.n) WHEN n2.n >= 2 THEN ln(n2.n / h1.n) ELSE ln(n1.n / total.n) END AS l
      FROM t JOIN one n1 ON n1.c = t.c LEFT JOIN two n2 ON t.i > 1 AND n2.b = t.b AND n2.c = t.c
      LEFT JOIN three n3 ON t.i > 2 AND n3.a = t.a AND n3.b = t.b AND n3.c = t.c
      LEFT JOIN one h1 ON t.i > 1 AND h1.c = t.b LEFT JOIN two h2 ON t.i > 2 AND h2.b = t.a AND h2.c = t.b, total),
g AS (SELECT doc_id, count(*) AS n_words, sum(short) AS n_backoffs, sum(l + short * ln(0.4)) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_backoffs, 0) AS BIGINT) AS n_backoffs,
       round(coalesce(score, 0.0), 4) AS log_score, round(coalesce(score / n_words, 0.0), 4) AS mean_log_score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
