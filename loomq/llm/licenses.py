"""License scans: fingerprints of templates in an inverted index pick candidates, banded alignment measures them.

Templates are normalised to words. There are two kinds of matches.

A whole one covers the reported share of its template, so it leaves few words out, and of any one place more than may be
left out it matches one. So many places, those of the template's rarest words, are its anchors, and an inverted index
leads from a word to its anchors. A hit is a candidate if enough of the template's words lie near it, and an alignment of
all its words in a band around its diagonal gives the matched share and the span. None is missed for want of a hit.

A partial one is a part of a long template, such as a paragraph of a license. Of a template's fingerprints, the hashes of
a few words in a row, winnowing keeps the least of every window, and every run of words as long as a window and a
fingerprint together has one that is kept. The document's fingerprints are looked up in an inverted index of the kept
ones, and from a hit a banded alignment goes on to both sides as long as it gains. No run of PART words is missed.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from loomq.llm.common import documents_of, hold, map_batches, raw_texts, record_batch
from loomq.llm.decontamination import char_spans, words_of

#: Half the band, and the least share that is reported as a whole match.
BAND, COVERAGE = 12, 0.8
#: Words of a fingerprint, fingerprints of a window, words that make a part, and how far an alignment's score may fall.
GRAM, WINNOW, PART, DROP = 6, 7, 12, 16
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -2, -1
#: Words whose hashes a worker keeps.
KEPT_WORDS = 300_000

#: Well-known notices, by the name that is reported.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of "
        "source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of "
    "source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_DISCLAIMED = (
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Whole texts of short licenses, without their copyright lines.
TEMPLATES |= {
    "0bsd-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_NO_WARRANTY}",
    "bsd-2-clause-text": _BSD_2 + _AS_IS,
    "bsd-3-clause-text": (
        f"{_BSD_2}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        f"specific prior written permission. {_AS_IS}"
    ),
    "isc-text": f"{TEMPLATES['isc']} {_NO_WARRANTY}",
    "mit-text": (
        f'{TEMPLATES["mit-permission"]} THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        f"MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. {_DISCLAIMED}"
    ),
    "unlicense-text": (
        f"{TEMPLATES['unlicense']} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and "
        "all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/"
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
        "in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def template_files(folder: str) -> dict[str, str]:
    """Templates from a folder's files on the driver, such as the long licenses that systems come with, by file name."""
    return {f"{p.name}-text": p.read_text(encoding="utf-8", errors="replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


SCHEMA = "doc_id long, n_words long, n_matches long, n_matched_words long, licenses string, spans string, best_coverage double, n_partial long, partial string"
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_matches", "n_matched_words")] + [("licenses", pa.string()), ("spans", pa.string()), ("best_coverage", pa.float64())]
    + [("n_partial", pa.int64()), ("partial", pa.string())]
)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 3)
        if len(self) < KEPT_WORDS and len(word) <= 64:
            self[word] = value
        return value


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    """The hash of every GRAM words in a row."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(GRAM):
        mixed = (mixed ^ hashes[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def winnowed(hashes: np.ndarray) -> list[int]:
    """Places of the fingerprints that are kept: of every window the last of its least ones, all of a short template's."""
    if len(hashes) <= WINNOW:
        return list(range(len(hashes)))
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], WINNOW)
    return sorted({len(hashes) - 1 - (i + int(k)) for i, k in enumerate(windows.argmin(axis=1))})


def least_matched(n_words: int, coverage: float) -> int:
    """The fewest matched words of a template that reach the coverage, one at least."""
    return next((k for k in range(1, n_words + 1) if k >= coverage * n_words), n_words)


class Index:
    """The templates' anchors for a coverage; a template without words can't be found and is an error."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.words = [words_of(templates[n].encode("utf-8")) for n in self.names]
        if not all(self.words):
            raise ValueError(f"template {self.names[self.words.index([])]!r} has no words")
        self.counts = [Counter(words) for words in self.words]
        self.least = [least_matched(len(words), coverage) for words in self.words]
        uses = Counter(w for words in self.words for w in words)
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            rarest = sorted(range(len(words)), key=lambda p: (uses[words[p]], -len(words[p]), p))
            for p in sorted(rarest[: len(words) - self.least[t] + 1]):
                places[_hashes[words[p]]].append((t, p))
        self.places = dict(places)
        #: A quick test by the low bits, which nearly all words of a text fail.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(np.array(sorted(places), np.uint64) & np.uint64(0xFFFF)).astype(np.int64)] = True
        kept: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            if len(words) >= 2 * PART:
                grams = gram_hashes(word_hashes(words))
                for p in winnowed(grams):
                    kept[int(grams[p])].append((t, p))
        self.grams = dict(kept)
        self.maybe_gram = np.zeros(1 << 20, bool)
        self.maybe_gram[(np.array(sorted(kept), np.uint64) & np.uint64(0xFFFFF)).astype(np.int64)] = True
        spelt = repr([(n, templates[n]) for n in self.names]) + f"{coverage}"
        self.digest = hashlib.sha256(spelt.encode()).hexdigest()

    def hits(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template that has hits among a text's word hashes their (place in the text, diagonal), a diagonal being
        the place in the text less that in the template."""
        likely = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in likely.tolist():
            for t, p in self.places.get(int(hashes[at]), ()):
                found[t].append((at, at - p))
        return found

    def gram_hits(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template with a kept fingerprint in the text their (place in the text, place in the template)."""
        grams = gram_hashes(hashes)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in np.flatnonzero(self.maybe_gram[(grams & np.uint64(0xFFFFF)).astype(np.int64)]).tolist():
            for t, p in self.grams.get(int(grams[at]), ()):
                found[t].append((at, p))
        return found

    def possible(self, t: int, text: list[bytes], diagonal: int) -> bool:
        """Whether the band around a diagonal holds enough of a template's words, in any order."""
        counts = self.counts[t]
        near = Counter(w for w in text[max(0, diagonal - BAND) : max(0, diagonal + len(self.words[t]) + BAND)] if w in counts)
        return sum(min(n, counts[w]) for w, n in near.items()) >= self.least[t]


def align(template: list[bytes], text: list[bytes], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and last matched place in the text) of the best alignment of a whole template in a band.

    The text before and after it is free. Words left out at the template's ends cost as others do: if they didn't, a
    changed word next to an end would cost the words beyond it too.
    """
    width, never = 2 * band + 1, -(10**9)
    before, moves = [0] * (width + 1), []
    for i, word in enumerate(template):
        row, move = [never] * (width + 1), bytearray(width)
        left = never
        for d in range(width):
            j = i + diagonal + d - band
            if j >= len(text):
                break
            if j < 0:
                row[d] = left = GAP * (i + 1)
                move[d] = 2
                continue
            through = before[d] + (MATCH if text[j] == word else MISMATCH)
            skip, add = before[d + 1] + GAP, left + GAP
            score = max(through, skip, add)
            row[d] = left = score
            # 1 goes on through a pair of words, 2 skips a word of the template, 3 one of the text
            move[d] = 1 if score == through else 2 if score == skip else 3
        before = row
        moves.append(move)
    best = max(before[:width])
    if best <= 0:
        return 0, 0, -1
    i, d = len(template) - 1, before.index(best)
    matched, first, last = 0, None, None
    while i >= 0 and 0 <= d < width and moves[i][d]:
        j, step = i + diagonal + d - band, moves[i][d]
        if step == 1:
            if text[j] == template[i]:
                matched += 1
                first = j
                last = j if last is None else last
            i -= 1
        elif step == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, first if first is not None else 0, last if last is not None else -1


def matches(index: Index, words: list[bytes], coverage: float, hashes: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
    """(first, last, template, coverage) of what is reported, by place.

    A hit is aligned until it lies in a match of its template or its diagonal has been tried in vain. Words of a match
    are taken out for its template, so that one right before or after another is found too.
    """
    found = []
    for t, hits in index.hits(word_hashes(words) if hashes is None else hashes).items():
        left, template = words, index.words[t]
        vain: set[int] = set()
        for at, diagonal in hits:
            while left[at] and diagonal not in vain:
                matched, first, last = align(template, left, diagonal) if index.possible(t, left, diagonal) else (0, 0, -1)
                if matched and matched >= coverage * len(template):
                    found.append((first, last, t, matched / len(template)))
                    left = list(words) if left is words else left
                    left[first : last + 1] = [b""] * (last - first + 1)
                else:
                    vain.add(diagonal)
    return sorted(found)


def extend(template: list[bytes], text: list[bytes], band: int = BAND, drop: int = DROP) -> tuple[int, int, int]:
    """(matched words, words of the template, words of the text) of the best alignment that begins where both begin.

    Rows are the template's words, columns the text's within the band around the diagonal. It ends at a match, and the
    search ends where all of a row is more than drop below the best.
    """
    never = -(10**9)
    # A cell is (score, matched words); ties go to more matches, then to the shorter way.
    best, row = (0, 0, 0, 0), [(GAP * d, 0) if d >= 0 else (never, 0) for d in range(-band, band + 1)]
    for i, word in enumerate(template):
        new, left = [], (never, 0)
        for d in range(2 * band + 1):
            j = i + d - band
            if j < -1 or j >= len(text):
                cell = (never, 0)
            else:
                skip = row[d + 1] if d < 2 * band else (never, 0)
                cell = max((skip[0] + GAP, skip[1]), (left[0] + GAP, left[1]))
                if j >= 0:
                    same = text[j] == word
                    through = (row[d][0] + (MATCH if same else MISMATCH), row[d][1] + same)
                    cell = max(cell, through)
                    if same and cell == through and cell[:2] > best[:2]:
                        best = (*cell, i + 1, j + 1)
            new.append(cell)
            left = cell
        row = new
        if max(row)[0] < best[0] - drop:
            break
    return best[1], best[2], best[3]


def parts(index: Index, words: list[bytes], whole: list[tuple[int, int, int, float]], hashes: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
    """(first, last, template, coverage) of the parts of templates outside of whole matches, by place.

    A part has at least PART matched words. One that lies inside another template's match of a higher coverage is left
    out, as is one inside a whole match of any.
    """
    covered = [(a, b) for a, b, _, _ in whole]
    found = []
    for t, hits in index.gram_hits(word_hashes(words) if hashes is None else hashes).items():
        template, done = index.words[t], [(a, b) for a, b, own, _ in whole if own == t]
        for at, p in hits:
            if any(a <= at and at + GRAM - 1 <= b for a, b in (*done[-2:], *covered)):
                continue
            if words[at : at + GRAM] != template[p : p + GRAM]:
                continue  # equal hashes of other words
            after = extend(template[p:], words[at : at + len(template) - p + BAND])
            before = extend(template[:p][::-1], words[max(0, at - p - BAND) : at][::-1])
            matched, first, last = before[0] + after[0], at - before[2], at + after[2] - 1
            done.append((first, last))
            if matched >= PART and not any(a <= first and last <= b for a, b in covered):
                found.append((first, last, t, matched / len(template)))
    kept, best = [], {}
    for first, last, t, share in found:  # a template's ways over the same words
        if share > best.get((t, first), (0, 0.0))[1]:
            best[t, first] = (last, share)
    listed = [(first, last, t, share) for (t, first), (last, share) in best.items()]
    for x in listed:
        if not any(y[0] <= x[0] and x[1] <= y[1] and (y[3], -y[2]) > (x[3], -x[2]) for y in listed):
            kept.append(x)
    return sorted(kept)


_indexes: dict[str, Index] = {}


def _release() -> None:
    _indexes.clear()
    _hashes.clear()


def licenses(df: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, matches, words inside them, names, spans and best coverage, and parts.

    licenses holds the names found, sorted and comma-joined; spans joins name:start:end:coverage by start, in code
    points with exclusive ends. partial joins the same of parts of templates, which aren't among the matches. A text
    without matches, null and empty ones too, has empty strings and coverage 0. Repeated rows and null ids are kept. The
    plan has no shuffle; the templates are a parameter and travel with it.
    """
    known = TEMPLATES if templates is None else templates
    digest = Index(known, coverage).digest

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        hold("licenses", _release)
        if digest not in _indexes:
            _indexes.clear()
            _indexes[digest] = Index(known, coverage)
        index, out = _indexes[digest], [[] for _ in _ARROW.names[1:]]

        def shown(text: bytes, found: list) -> str:
            places = _char_spans(text, [[a, b] for a, b, _, _ in found])
            return ",".join(f"{index.names[t]}:{a}:{b}:{share:.3f}" for (a, b), (_, _, t, share) in zip(places, found))

        for text in raw_texts(rows):
            words = words_of(text)
            hashes = word_hashes(words)
            found = matches(index, words, coverage, hashes)
            partial = parts(index, words, found, hashes)
            covered = set().union(*(range(a, b + 1) for a, b, _, _ in found)) if found else ()
            names = sorted({index.names[t] for _, _, t, _ in found})
            best = max((x[3] for x in found + partial), default=0.0)
            row = (len(words), len(found), len(covered), ",".join(names), shown(text, found), best, len(partial), shown(text, partial))
            for column, value in zip(out, row):
                column.append(value)
        return record_batch(_ARROW, [rows.column("doc_id"), *out])

    return map_batches(documents_of(df, id_col, text_col), batch, SCHEMA)


def _char_spans(text: bytes, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Code-point offsets of spans of words that may overlap, by those of the single words at their ends."""
    ends = sorted({w for span in spans for w in span})
    single = dict(zip(ends, char_spans(text, [[w, w] for w in ends])))
    return [(single[a][0], single[b][1]) for a, b in spans]
