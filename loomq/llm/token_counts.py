"""Token counts by heap-and-linked-list byte-pair merging.

A word's tokens are its initial symbols (bytes) minus the merges that happen: the adjacent pair of the lowest rank is
popped from a heap again and again, its left node takes the joined symbol and its right node leaves the linked list.
No token identifiers are produced. Counts of words already seen are kept per worker in a bounded table, so a text costs
one look-up for most of its words.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from loomq.llm.common import BEYOND, char_class, documents_of, hold, map_batches, raw_texts, record_batch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Words whose counts a worker keeps; rarer ones beyond it are counted anew each time.
KEPT_WORDS = 600_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

# The pre-tokenizer's pattern, over all of Unicode and, for texts below U+0300, with its classes spelt out.
_GENERAL = regex.compile(public_tokenizers.PATTERN)
_L, _N, _S = char_class("L"), char_class("N"), "\\t-\\r \\x85\\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies, by the published rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def shared_part(specials: list[str]) -> str:
    """Two characters that all special strings have in common, which a text without them needn't be searched for."""
    first = specials[0] if specials else ""
    return next((first[i : i + 2] for i in range(len(first) - 1) if all(first[i : i + 2] in s for s in specials)), "")


class MergeCounter(dict):
    """Word -> number of tokens; a missing word is counted by merging."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] is not None or model["end_of_word_suffix"]:
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        symbol = {chars: b for chars, b in byte_symbols().items()}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = symbol.setdefault(left + right, len(symbol))
            self.joined.setdefault((symbol[left], symbol[right]), (rank, made))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.mark = shared_part(specials)

    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8")
        count = len(data) - self.merges(data)
        if len(self) < KEPT_WORDS and len(data) <= 64:
            self[word] = count
        return count

    def merges(self, data: bytes) -> int:
        """How many merges a word's bytes undergo."""
        joined, n = self.joined, len(data)
        symbols, after, before = list(data), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(joined[pair][0], i, pair) for i, pair in enumerate(zip(data, data[1:])) if pair in joined]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = joined[pair][1], -1
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (found := joined.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (found[0], i, (symbols[i], symbols[k])))
            if (h := before[i]) >= 0 and (found := joined.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (found[0], h, (symbols[h], symbols[i])))
        return done

    def count(self, text: str) -> int:
        if self.specials is not None and self.mark in text and self.specials.search(text):
            parts = self.specials.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        words = _GENERAL.findall(text) if BEYOND.search(text) else _LATIN.findall(text)
        return sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(df: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether it is over a limit of tokens.

    One row comes back for each row, repeated rows and null ids included. A null or empty text has 0 bytes and 0
    tokens. Special strings in a text count as one token each, as the tokenizer does by default. Any length works; the
    plan has no shuffle.
    """

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        hold("token counts", counter.cache_clear)
        model, data = counter(vocabulary), raw_texts(rows)
        n = [model.count(x.decode("utf-8", "replace")) for x in data]
        return record_batch(_ARROW, [rows.column("doc_id"), [len(x) for x in data], n, [x > limit for x in n]])

    return map_batches(documents_of(df, id_col, text_col), batch, SCHEMA)
