"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Texts are normalised to words. Every word of the benchmark gets a character of its own, so item words are a short string,
a document is a string with one character a word, and the automaton scans it once. A match's place is a word number,
which maps to the word's span in the original text.

The automaton doesn't hold every window of an item, which would be as many nodes as all windows have words. It holds cuts
of a third of a window, so near to each other that every window has one of them whole. Where a cut matches, the words
around it say which windows with this cut occur there. For the automaton a word is two characters, since a node's
children are searched one by one; only runs of words that the benchmark has are scanned.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomq.llm.common import documents_of, hold, map_batches, raw_texts, record_batch
from loomq.session import expose_package, store

WINDOW_WORDS = 13
#: Benchmark text that one automaton may hold, about 20 bytes of memory for each; a larger benchmark is scanned in several
#: blocks of this size.
BLOCK_BYTES = 40_000_000
#: Distinct words of a benchmark that can have a character each; items with more are held by several automata.
LETTERS = 1_100_000

# Fixed value: what counts as a word, on UTF-8 bytes, where every byte of a non-ASCII character is from 0x80 on.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_spans long"
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_hit", "n_items")]
    + [("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("n_spans", pa.int64())]
)
_HITS = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))]
    + [("char_start", pa.list_(pa.int64())), ("char_end", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)
HITS = (
    "doc_id long, row long, n_words long, first array<long>, last array<long>, "
    "char_start array<long>, char_end array<long>, items array<string>"
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; bytes.lower() changes A-Z alone."""
    return _WORD.findall(text.lower())


def _letter(n: int) -> str:
    """The n-th character that may stand for a word; 0 stands for every other word, surrogates are left out."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 1 + 0x800)


def _shared(a: str, b: str) -> int:
    """How many characters two strings have in common at their start."""
    if b.startswith(a):
        return len(a)
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


#: Surroundings of a cut from which on they are found by an index instead of one after the other.
MANY = 16


class Automaton:
    """The windows of some items: cuts of them as patterns, and for each cut what stands around it.

    A cut that many items share, such as a phrase that introduces questions, has its surroundings in an index: by every
    way in which the words that a window needs besides the cut can lie on both sides of it.
    """

    def __init__(self, width: int):
        self.width, self.cut = width, (width + 2) // 3
        self.letters: dict[bytes, str] = {}
        self.size: list[int] = []  # words of each pattern
        self.whole: dict[int, list[int]] = {}  # items of less than a window's words, by pattern
        # For each cut its surroundings: the words before it, backwards, those after it, and the items that have them.
        self.around: dict[int, dict[tuple[str, str], list[int]]] = {}
        self.place: dict[str, int] = {}

    def add(self, item: int, words: list[bytes]) -> None:
        width, cut = self.width, self.cut
        coded = "".join([self.letters.setdefault(w, _letter(len(self.letters))) for w in words])
        if len(coded) < width:
            self.whole.setdefault(self._pattern(coded), []).append(item)
            return
        for i in range(0, len(coded) - cut + 1, width - cut + 1):
            key = (coded[max(0, i + cut - width) : i][::-1], coded[i + cut : i + width])
            items = self.around.setdefault(self._pattern(coded[i : i + cut]), {}).setdefault(key, [])
            if not items or items[-1] != item:
                items.append(item)

    def _pattern(self, coded: str) -> int:
        n = self.place.setdefault(coded, len(self.place))
        if n == len(self.size):
            self.size.append(len(coded))
        return n

    def ready(self) -> None:
        root = math.isqrt(len(self.letters)) + 1
        self.pairs = {ord(c): chr(1 + n // root) + chr(1 + root + n % root) for n, c in enumerate(self.letters.values())}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for pattern, n in self.place.items():
            self.automaton.add_word(pattern.translate(self.pairs), n)
        self.place = {}
        self._index()
        if self.size:
            self.runs = re.compile(f"[^\0]{{{min(self.size)},}}")
            self.automaton.make_automaton()

    def _index(self) -> None:
        """Sorted hashes of (cut, words before, words after) for cuts with many surroundings, and whose they are."""
        more, hashes, owners = self.width - self.cut, array("q"), array("l")
        self.many = {n for n, around in self.around.items() if len(around) > MANY}
        self.entries: list[tuple[str, str, list[int]]] = []
        for n in sorted(self.many):
            for (left, right), items in self.around.pop(n).items():
                for a in range(max(0, more - len(right)), min(more, len(left)) + 1):
                    hashes.append(hash((n, left[:a], right[: more - a])))
                    owners.append(len(self.entries))
                self.entries.append((left, right, items))
        keys = np.frombuffer(hashes, np.int64) if hashes else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], np.array(owners, np.int64)[order]

    def _of_many(self, n: int, first: int, last: int, before: str, after: str, spans: list[list[int]], found: set[int], seen: set[tuple]) -> None:
        """Windows around an occurrence of such a cut; items are looked at once a text for the same words."""
        more = self.width - self.cut
        wanted = [(n, before[:a], after[: more - a]) for a in range(more + 1)]
        probes = np.fromiter(map(hash, wanted), np.int64, more + 1)
        begin, end = np.searchsorted(self.keys, probes).tolist(), np.searchsorted(self.keys, probes, "right").tolist()
        for a, (key, lo, hi) in enumerate(zip(wanted, begin, end)):
            if lo == hi:
                continue
            if key not in seen:
                own = [items for left, right, items in (self.entries[k] for k in self.owners[lo:hi].tolist()) if left[:a] == key[1] and right[: more - a] == key[2] and len(key[1]) + len(key[2]) == more]
                if not own:
                    continue
                seen.add(key)
                for items in own:
                    found.update(items)
            spans.append([first - a, last + more - a])

    def scan(self, words: list[bytes], spans: list[list[int]], found: set[int]) -> None:
        if not self.size:
            return
        seen: set[tuple] = set()
        coded = "".join(map(self.letters.get, words, repeat("\0")))
        more = self.width - self.cut
        for run in self.runs.finditer(coded):
            start = run.start()
            for end, n in self.automaton.iter(run[0].translate(self.pairs)):
                last = start + end // 2
                first = last - self.size[n] + 1
                if n in self.whole:
                    spans.append([first, last])
                    found.update(self.whole[n])
                if n in self.around or n in self.many:
                    before, after = coded[max(0, first - more) : first][::-1], coded[last + 1 : last + 1 + more]
                    if n in self.many:
                        self._of_many(n, first, last, before, after, spans, found, seen)
                        continue
                    for (left, right), items in self.around[n].items():
                        a, b = _shared(left, before), _shared(right, after)
                        if a + b >= more:
                            spans.append([first - a, last + b])
                            found.update(items)


class Windows:
    """The automaton over the windows of some items; several only where their distinct words outnumber the characters."""

    def __init__(self, items: list[tuple[str, bytes]], width: int, letters: int = LETTERS):
        self.names = [item for item, _ in items]
        self.automata = [Automaton(width)]
        for n, (_, text) in enumerate(items):
            words = words_of(text)
            if len(self.automata[-1].letters) + len(words) > letters and self.automata[-1].size:
                self.automata.append(Automaton(width))
            if words:
                self.automata[-1].add(n, words)
        for automaton in self.automata:
            automaton.ready()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [first, last] word numbers inside windows, and the items of these windows."""
        spans: list[list[int]] = []
        found: set[int] = set()
        for automaton in self.automata:
            automaton.scan(words, spans, found)
        return merge_spans(spans), {self.names[n] for n in found}


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return merged


def char_spans(text: bytes, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Spans of word numbers as code-point offsets of the original text, end exclusive."""
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out, at, done = [], 0, 0
    for first, last in spans:
        cut = []
        for byte in (places[first][0], places[last][1]):
            at += len(text[done:byte].decode("utf-8", "replace"))
            done = byte
            cut.append(at)
        out.append((cut[0], cut[1]))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size. Only one block at a time is on the driver."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = items.filter("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [(r["item"], r["text"].encode("utf-8")) for r in part.toLocalIterator()]


_automata: dict[str, Windows] = {}


def _automaton(key: str, items: list[tuple[str, bytes]], width: int) -> Windows:
    hold("decontamination", _automata.clear)
    if key not in _automata:
        _automata.clear()
        _automata[key] = Windows(items, width)
    return _automata[key]


def _key(items: list[tuple[str, bytes]], width: int) -> str:
    digest = hashlib.sha256(b"%d" % width)
    for item, text in items:
        digest.update(b"%d:%s:%d:%s" % (len(item.encode()), item.encode(), len(text), text))
    return digest.hexdigest()


def benchmark_hits(
    df: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Where each document repeats the benchmark: word spans first..last, their character spans, and the items.

    One row for each row of df; row is null unless the benchmark takes several blocks. A null text has no words.
    Items without an id or a text are left out; an item without words has no window. An empty benchmark hits nothing.
    A benchmark of one block is scanned in one pass without a shuffle. A larger one is scanned block by block over rows
    that have been numbered once, and each row's hits come together by its number.
    """
    docs = documents_of(df, id_col, text_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes, width)
    several = len(blocks) > 1
    if several:
        docs = store(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")

    def batch_of(block):
        sent, key = block

        def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
            windows, data = _automaton(key, sent.value, width), raw_texts(rows)
            out: list[list] = [[] for _ in _HITS.names[2:]]
            for text in data:
                words = words_of(text)
                spans, items = windows.scan(words)
                places = char_spans(text, spans)
                row = (len(words), [s[0] for s in spans], [s[1] for s in spans], [p[0] for p in places], [p[1] for p in places], sorted(items))
                for column, value in zip(out, row):
                    column.append(value)
            number = rows.column("row") if several else pa.nulls(len(data), pa.int64())
            return record_batch(_HITS, [rows.column("doc_id"), number, *out])

        return batch

    parts = [map_batches(docs, batch_of(block), HITS) for block in blocks]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    if not several:
        return hits
    return hits.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("first")).alias("first"),
        F.flatten(F.collect_list("last")).alias("last"), F.flatten(F.collect_list("char_start")).alias("char_start"),
        F.flatten(F.collect_list("char_end")).alias("char_end"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, width: int) -> list[tuple]:
    """Each block of the benchmark, sent to the executors, with its key."""
    context = benchmark.sparkSession.sparkContext
    return [(context.broadcast(items), _key(items, width)) for items in benchmark_blocks(benchmark, item_col, text_col, block_bytes)]


def decontaminate(df: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """One row per document: words, words hit, items, the items' digest and the verdict.

    contaminated: some word is hit and share * n_hit >= n_words, i.e. a twentieth of the words by default. See
    benchmark_hits() for nulls, empty texts and tables. Item ids are sorted as strings; the digest of no items is that
    of the empty text.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in _ARROW.names[1:]]
        columns = [rows.column(c).to_pylist() for c in ("n_words", "first", "last", "items")]
        for n_words, first, last, items in zip(*columns):
            spans = merge_spans([list(s) for s in zip(first, last)])
            n_hit = sum(b - a + 1 for a, b in spans)
            digest = hashlib.sha256(",".join(sorted(items)).encode("utf-8")).hexdigest()
            row = (n_words, n_hit, len(items), digest, n_hit > 0 and share * n_hit >= n_words, len(spans))
            for column, value in zip(out, row):
                column.append(value)
        return record_batch(_ARROW, [rows.column("doc_id"), *out])

    return map_batches(benchmark_hits(df, benchmark, **options), batch, SCHEMA)


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, share: int = 20, width: int = WINDOW_WORDS, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of df, all columns unchanged, that decontaminate() doesn't call contaminated; a null text stays.

    With a benchmark of one block this is a filter. With a larger one the rows are numbered and written once, and the
    contaminated numbers are taken out.
    """
    expose_package(df.sparkSession)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes, width)
    if len(blocks) > 1:
        numbered = store(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")
        options = dict(id_col="__row", text_col=text_col, item_col=item_col, item_text_col=item_text_col, block_bytes=block_bytes)
        found = decontaminate(numbered, benchmark, share, width=width, **options).filter("contaminated").select(F.col("doc_id").alias("__row"))
        return numbered.join(found, "__row", "left_anti").drop("__row")
    sent, key = blocks[0]

    def clean(column: pa.Array) -> pa.Array:
        windows, out = _automaton(key, sent.value, width), []
        for x in column.cast(pa.binary()).to_pylist():
            words = words_of(x or b"")
            n = sum(b - a + 1 for a, b in windows.scan(words)[0])
            out.append(not (n and share * n >= len(words)))
        return pa.array(out, pa.bool_())

    return df.filter(F.arrow_udf(clean, "boolean")(F.col(f"`{text_col}`").cast("string")))


#: DuckDB SQL for decontaminate() with its defaults.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i:i + least(len(w), 13) - 1] AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM k),
g AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
h AS (SELECT g.doc_id, g.i, g.n, k.item_id FROM g JOIN k ON k.n = g.n AND k.g = g.g),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h),
o AS (SELECT doc_id, count(*) AS n_hit, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM p) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
