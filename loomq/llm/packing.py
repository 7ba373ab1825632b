"""Packing documents into windows by the minimum-bin-slack method.

Documents are tokenized and cut at every full window, which is final where it is cut; what remains of each is shorter than
a window. Only the remainders' identifiers move: they are dealt by hash into buckets of a bounded mean size, and every
bucket is packed on its own. A window is seeded with the
longest remainder left; a bitset subset-sum dynamic programme over the multiset of remaining lengths finds the total
closest to the capacity, and backtracking through the stored bitsets gives how often each length is taken. The same
choice is repeated while the multiset allows it. A slack that is left is closed by cutting one more remainder. The last
window of a bucket is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomq.llm.common import char_class, documents_of, hold, record_batch, texts
from loomq.llm.token_counts import byte_symbols, shared_part
from loomq.session import expose_package

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WINDOW = 2048
END_ID = 1
#: Mean number of documents, and of bytes of text, in a bucket that is packed by one task: the first that is reached.
BUCKET_DOCUMENTS, BUCKET_BYTES = 4096, 32_000_000
#: Words whose identifiers a worker keeps.
KEPT_WORDS = 400_000

_L, _N = char_class("L"), char_class("N")
#: Characters that need the general path: all from U+0300 on, and those that only Python takes for white space.
_OTHER = re.compile("[\x1c-\x1f\u0300-\U0010ffff]")
# The pre-tokenizer's pattern for texts below U+0300, its classes spelt out.
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\t-\\r \\x85\\xa0{_L}{_N}]+")

_CUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("bucket", pa.int64())])
_CUT_COLUMNS = "doc_id long, start long, length long, crc long, doc_tokens long, ids binary, bucket long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


class WordIds(dict):
    """Text between white space -> its identifiers as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.mark = shared_part(specials)
        shown = {b: c for c, b in byte_symbols().items()}
        self.shown = [shown[b] for b in range(256)]

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, word: str) -> bytes:
        """Of one pre-tokenized word, by the library's model alone: nothing is left to normalize or split."""
        shown = word if word.isascii() and word.isprintable() else "".join([self.shown[b] for b in word.encode("utf-8")])
        return array("H", [token.id for token in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        parts = _LATIN.findall(word)
        alone = len(parts) == 1 and parts[0] == word
        ids = self.piece(word) if alone else b"".join([self[part] for part in parts])
        if len(word) <= 32 and len(self) < (KEPT_WORDS if alone else KEPT_WORDS // 2):
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Of a whole text; characters that normalization could join and special strings take the library's own path."""
        if (self.special is not None and self.mark in text and self.special.search(text)) or _OTHER.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def closest_fill(stock: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """The total closest to the capacity from below that a multiset {length: count} can make, and the counts taken.

    Bit s of a bitset says that some choice sums to s. Lengths are added from the longest on; a bitset is kept before
    each, which is what backtracking needs. The programme ends early once the capacity itself is reached.
    """
    mask, bits = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(stock, reverse=True):
        if length > capacity:
            continue
        before, most, sums = bits, min(stock[length], capacity // length), bits
        done = 0
        while done < most:  # doubling: after it, bits hold every count from 0 to most
            more = min(max(1, done + 1), most - done)
            sums = bits << (more * length) & mask
            bits |= sums
            done += more
        steps.append((length, most, before))
        if bits >> capacity & 1:
            break
    total = bits.bit_length() - 1
    taken, left = [], total
    for length, most, before in reversed(steps):
        k = next(k for k in range(most + 1) if left >= k * length and before >> (left - k * length) & 1)
        if k:
            taken.append((length, k))
            left -= k * length
    return total, taken


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) that hold every item, each of at most window tokens.

    All windows are full but for those that hold the last rest, whose sizes are powers of two where the window is one.
    Empty items are left out.
    """
    pool: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item in range(len(lengths) - 1, -1, -1):
        start, size = 0, lengths[item]
        while size > 0:  # longer items are cut at every full window
            pool[min(size, window)].append((item, start))
            start, size = start + window, size - window
    stock = {length: len(items) for length, items in pool.items()}
    total, packed = sum(length * n for length, n in stock.items()), []

    def take(length: int) -> tuple[int, int]:
        stock[length] -= 1
        if not stock[length]:
            del stock[length]
        return pool[length].pop()

    def put(length: int, item: int, start: int) -> None:
        pool[length].append((item, start))
        stock[length] = stock.get(length, 0) + 1

    while total >= window:
        seed = max(stock)
        rest = {k: n - (k == seed) for k, n in stock.items() if n > (k == seed)}
        filled, chosen = closest_fill(rest, window - seed)
        counts = defaultdict(int, {seed: 1})
        for length, k in chosen:
            counts[length] += k
        slack = window - seed - filled
        times = 1 if slack else min(stock[length] // k for length, k in counts.items())
        for _ in range(times):
            made = [(*take(length), length) for length in sorted(counts, reverse=True) for _ in range(counts[length])]
            if slack:  # every item left is longer than the slack, or it would have been taken
                longest = max(stock)
                item, start = take(longest)
                made.append((item, start, slack))
                put(longest - slack, item, start + slack)
            packed.append(made)
        total -= times * window
    power = 1 << (window - 1).bit_length()
    while total:  # the rest, cut at the powers of two that sum to it
        while power > total:
            power //= 2
        made, room = [], power
        while room:
            longest = max(stock)
            item, start = take(longest)
            made.append((item, start, min(longest, room)))
            if longest > room:
                put(longest - room, item, start + room)
            room -= made[-1][2]
        packed.append(made)
        total -= power
    return packed


def checksum(ids: bytes) -> int:
    """The crc32 of 16-bit identifiers as 32-bit ones."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


class Dealer:
    """Buckets of a task's pieces: by what a piece is, the task, and the number of pieces alike before it.

    Pieces alike can stand for each other, so the order in which a task sees its rows changes nothing.
    """

    def __init__(self, buckets: int):
        context = TaskContext.get()
        self.buckets, self.task, self.seen = buckets, context.partitionId() if context else 0, Counter()

    def __call__(self, doc_id: int | None, start: int, ids: bytes) -> int:
        own = hashlib.blake2b(ids, digest_size=16, person=b"%d" % (hash((doc_id is None, doc_id or 0, start)) % 10**15)).digest()
        alike = self.seen[own]
        self.seen[own] = alike + 1
        return zlib.crc32(b"%d %d" % (self.task, alike), zlib.crc32(own)) % self.buckets


def pack(
    df: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, bucket_documents: int = BUCKET_DOCUMENTS, bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """Every document's identifiers plus an end identifier, packed into sequences of at most window identifiers.

    A row is a piece: doc_id, start (identifiers of its document before it), length, ids_crc32 (of its identifiers as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id and offset, and with with_ids also ids, the
    identifiers as little-endian unsigned 16-bit numbers. A null or empty text is a document of the end identifier only.
    Repeated rows are documents of their own; null ids are kept. An empty table gives no rows. One shuffle deals the
    remainders, each shorter than a window, into buckets whose number grows with the table; rows alike are told apart by
    their number, so that no value of any column can fill a bucket. Of a full window only its place and checksum move, and with with_ids
    its identifiers. A piece's bucket follows from what it is, its task, and how many like it the task has seen, so a task
    that is run again with its rows in another order deals the same pieces to the same buckets.
    """
    docs = documents_of(df, id_col, text_col)
    expose_package(df.sparkSession)
    whole = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-whole["rows"] // bucket_documents), -(-whole["bytes"] // bucket_bytes))

    schema = _PIECES.append(pa.field("ids", pa.binary())) if with_ids else _PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("packing", word_ids.cache_clear)
        model, end, deal = word_ids(vocabulary), array("H", [end_id]).tobytes(), Dealer(buckets)
        for batch in batches:
            out: list[list] = [[] for _ in _CUT]
            for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = model.ids(text) + end
                for start in range(0, len(ids), 2 * window):
                    own = ids[start : start + 2 * window]
                    full = len(own) == 2 * window
                    row = (key, start // 2, len(own) // 2, checksum(own) if full else None, len(ids) // 2, None if full and not with_ids else own, deal(key, start, own))
                    for column, value in zip(out, row):
                        column.append(value)
            yield record_batch(_CUT, out)

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending"), ("crc", "ascending"), ("ids", "ascending")])
        keys, starts, sizes, crcs, ids, whole = (rows.column(c).to_pylist() for c in ("doc_id", "start", "length", "crc", "ids", "doc_tokens"))
        out: list[list] = [[] for _ in schema]
        base, rests = key[0].as_py() << 40, [k for k, crc in enumerate(crcs) if crc is None]
        full = [[(k, 0, sizes[k])] for k, crc in enumerate(crcs) if crc is not None]
        packed = [[(rests[item], start, length) for item, start, length in sequence] for sequence in pack_lengths([sizes[k] for k in rests], window)]
        for n, sequence in enumerate(full + packed):
            offset = 0
            for k, start, length in sequence:
                own = None if ids[k] is None else ids[k][2 * start : 2 * (start + length)]
                row = (keys[k], starts[k] + start, length, crcs[k] if crcs[k] is not None else checksum(own), whole[k], base + n, offset, own)
                for column, value in zip(out, row):
                    column.append(value)
                offset += length
        return pa.Table.from_batches([record_batch(schema, out)])

    if word_ids(vocabulary).tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("identifiers must fit 16 bits")
    dealt = docs.mapInArrow(cut, _CUT_COLUMNS)
    return dealt.groupBy("bucket").applyInArrow(fill, PIECES + ", ids binary" * with_ids)
