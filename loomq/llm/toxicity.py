"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters, marks) and scanned once by an Aho-Corasick
automaton. The lexicon is learned from a bounded sample of labelled rows: words and word beginnings that toxic texts have
far more often than others, each weighted by its log odds. Longer beginnings, and pairs of a term's word with the word
before or after it, that clean texts use as often are exception phrases: a term inside one doesn't count. The matched
weight, as a sum and normalised by the text's length, is turned into a score by a logistic regression.

Some foldings would harm ordinary words: a sign at a word's end (win10), a marked letter below U+0300 (schön), letters
that stand alone (a b c). Those are done only where the folded word begins with a term of the lexicon.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomq.llm.common import documents_of, fold, hold, map_batches, record_batch, texts

#: Bounds of the labelled sample: rows, and characters of a row that may be in it.
SAMPLE, SAMPLE_CHARS = 6_000, 30_000
#: A term has so many characters, so many toxic texts of the sample at least, and such log odds and evidence at least.
TERM_CHARS, TERM_SUPPORT, TERM_ODDS, TERM_EVIDENCE = range(3, 13), 5, 1.5, 40.0
#: Uses in one text that count as evidence.
USES_OF_A_TEXT = 3
#: An exception phrase within a word has at most so many more characters than its term; every one so many clean texts.
EXCEPTION_CHARS, EXCEPTION_SUPPORT = 8, 3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_matches long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_matches", pa.int64())])

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
_HOMOGLYPHS = dict(zip("аеорсухкмтнвіјѕԁɡαορνικτυ", "aeopcyxkmthbijsdgaopviktu"))
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}
# Runs are taken whole and entered at their beginning only, so that a text of nothing else is read once.
_SIGNS_BEFORE = re.compile(r"(?<![013457@$!|])[013457@$!|]++(?=[^\W\d_])")
_SIGNS_AFTER = re.compile(r"(?<![^\W\d_])([^\W\d_]++)([013457@$|]++)(?=$|[\s.,;:!?)\"'])")
_ODD = re.compile("[\u0261\u0300-\U0010ffff]")
_WORDS = re.compile(r"[^\W\d_]+")
_MARKED = {c: unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].isascii()}
#: Letters that stand alone and are taken for one word if they are so many at least.
SPELT = 4


def _folded_char(c: str) -> str:
    if c in _HOMOGLYPHS:
        return _HOMOGLYPHS[c]
    parts = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) not in ("Mn", "Cf"))
    return "".join(_HOMOGLYPHS.get(x, x) for x in parts.lower())


def words_of(text: str, is_term: Callable[[str], bool] | None = None) -> list[str]:
    """The folded words of a text; is_term says whether a word begins with a term, which decides doubtful foldings."""
    text = text.lower()
    if _ODD.search(text):
        text = unicodedata.normalize("NFC", text)
        text = "".join([c if c < "\u0300" and c != "\u0261" else _folded_char(c) for c in text])
    signs = lambda run: "".join(map(_SIGNS.__getitem__, run))

    def before(m: re.Match) -> str:
        """Signs inside of a word, or digits and such at its beginning."""
        at = text[m.start() - 1 : m.start()]
        return signs(m[0]) if at.isalpha() or ((not at or at.isspace()) and "!" not in m[0] and "|" not in m[0]) else m[0]

    text = _SIGNS_BEFORE.sub(before, text)
    if is_term is None:
        return _WORDS.findall(text)

    def after(m: re.Match) -> str:
        word = m[1] + signs(m[2])
        return word if is_term(word) else m[0]

    words = _WORDS.findall(_SIGNS_AFTER.sub(after, text))
    doubtful = [i for i, w in enumerate(words) if len(w) == 1 or not w.isascii()]
    return _settled(words, doubtful, is_term) if doubtful else words


def _settled(words: list[str], doubtful: list[int], is_term: Callable[[str], bool]) -> list[str]:
    """Words with marked letters without their marks, and letters in a row as one word, where a term comes of it."""
    alone: list[list[int]] = []
    for i in doubtful:
        if len(words[i]) > 1:
            plain = words[i].translate(_MARKED)
            if plain != words[i] and is_term(plain):
                words[i] = plain
        elif alone and alone[-1][1] == i:
            alone[-1][1] = i + 1
        else:
            alone.append([i, i + 1])
    for first, end in alone:
        if end - first >= SPELT and is_term(word := "".join(words[first:end]).translate(_MARKED)):
            words[first:end] = [word] + [""] * (end - first - 1)
    return [w for w in words if w]


class Lexicon:
    """Terms with weights, exceptions, and the logistic regression over what they match."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], coefficients: list[float]):
        self.terms, self.exceptions, self.coefficients = terms, exceptions, coefficients
        self.digest = hashlib.sha256(repr((sorted(terms.items()), sorted(exceptions), coefficients)).encode()).hexdigest()
        self.starts = {t[: TERM_CHARS[0]] for t in terms}
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def begins(self, word: str) -> str | None:
        """The term that a word begins with; a term of a whole word ends in a space. No term begins another."""
        own = word + " "
        if own[: TERM_CHARS[0]] not in self.starts:
            return None
        return next((own[:k] for k in range(TERM_CHARS[0], min(TERM_CHARS[-1] + 1, len(own)) + 1) if own[:k] in self.terms), own if own in self.terms else None)

    def matches(self, words: list[str]) -> tuple[int, float]:
        """How many words begin with a term, and their weight; one inside an exception phrase doesn't count."""
        if not self.terms:
            return 0, 0.0
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self.automaton.add_word(" " + phrase, (len(phrase) + 1, 0.0))
            for term, weight in self.terms.items():
                self.automaton.add_word(" " + term, (len(term) + 1, weight))
            self.automaton.make_automaton()
        found, excepted = [], []
        for end, (length, weight) in self.automaton.iter(" " + " ".join(words) + " "):
            (found if weight else excepted).append((end - length + 1, end, weight))
        if excepted and found:
            excepted.sort()
            reach, at, kept = -1, 0, []
            for start, end, weight in sorted(found):
                while at < len(excepted) and excepted[at][0] <= start:
                    reach = max(reach, excepted[at][1])
                    at += 1
                if reach < end:
                    kept.append((start, end, weight))
            found = kept
        return len(found), sum(w for _, _, w in found)

    def features(self, text: str) -> tuple[int, list[float]]:
        words = words_of(text, self.begins)
        n, weight = self.matches(words)
        per_word = math.log1p(100.0 * weight / (len(words) + 20.0))
        return n, [1.0, math.log1p(weight), per_word, weight / n if n else 0.0, math.log1p(n)]

    def score(self, text: str) -> tuple[int, float]:
        n, x = self.features(text)
        z = sum(a * b for a, b in zip(x, self.coefficients))
        return n, 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def learn(labelled: list[tuple[str, int]]) -> Lexicon:
    """A lexicon from (text, 0 or 1) pairs, the same for the same pairs in any order. Without toxic texts it is empty."""
    labelled = sorted({(hashlib.sha256(t.encode("utf-8", "replace")).hexdigest(), t, y) for t, y in labelled})
    total = Counter(y for _, _, y in labelled)
    if not total[1]:
        return Lexicon({}, [], [-8.0, 0.0, 0.0, 0.0, 0.0])
    spelt = [words_of(t) for _, t, _ in labelled]
    counted = [Counter(words) for words in spelt]
    size = [sum(sum(c.values()) for c, (_, _, y) in zip(counted, labelled) if y == k) + 1 for k in (0, 1)]
    support = Counter()
    for c, (_, _, y) in zip(counted, labelled):
        if y:
            support.update({b for w in c for b in _beginnings(w)})
    hopeful = {b for b, n in support.items() if n >= TERM_SUPPORT}
    known: dict[str, list[str]] = {}  # of each word, since words repeat
    uses = (Counter(), Counter())
    for c, (_, _, y) in zip(counted, labelled):
        own = Counter()
        for w, n in c.items():
            if w not in known:
                known[w] = [b for b in _beginnings(w) if b in hopeful]
            for b in known[w]:
                own[b] += n
        for b, n in own.items():
            uses[y][b] += min(n, USES_OF_A_TEXT)
    odds = {b: math.log((uses[1][b] + 0.5) / size[1]) - math.log((uses[0][b] + 0.5) / size[0]) for b in hopeful}
    evidence = {b: _evidence(uses[0][b], uses[1][b], *size) for b in hopeful if odds[b] >= TERM_ODDS}
    terms: dict[str, float] = {}
    for b in sorted((b for b, g in evidence.items() if g >= TERM_EVIDENCE), key=lambda b: (-round(evidence[b], 6), b.endswith(" "), -len(b), b)):
        if not any(b.startswith(t) or t.startswith(b) for t in terms):
            terms[b] = odds[b]
    exceptions = _exceptions(terms, spelt, labelled, size)
    lexicon = Lexicon(terms, exceptions, [0.0] * 5)
    x = np.array([lexicon.features(t)[1] for _, t, _ in labelled])
    return Lexicon(terms, exceptions, _logistic(x, np.array([y for _, _, y in labelled], float)))


def _beginnings(word: str) -> list[str]:
    """What a term may be of a word: its beginnings, and the whole word with a space behind."""
    found = [word[:k] for k in TERM_CHARS if k <= len(word)]
    return [*found, word + " "] if len(word) >= TERM_CHARS[0] else found


def _evidence(clean: int, toxic: int, n_clean: int, n_toxic: int) -> float:
    """The log-likelihood ratio of uses in toxic against clean words."""
    share = (clean + toxic) / (n_clean + n_toxic)
    return 2 * sum(k * math.log(k / (n * share)) for k, n in ((clean, n_clean), (toxic, n_toxic)) if k)


def _exceptions(terms: dict[str, float], spelt: list[list[str]], labelled: list, size: list[int]) -> list[str]:
    """Phrases around a term that clean texts use at least as often as toxic ones: a longer beginning of its word, or its
    word with the one before or after."""
    begins, uses, clean_texts = Lexicon(terms, [], []).begins, (Counter(), Counter()), Counter()
    for words, (_, _, y) in zip(spelt, labelled):
        own = Counter()
        known = {w: begins(w) for w in set(words)}
        for i, w in enumerate(words):
            if (term := known[w]) is None:
                continue
            own.update([w[: len(term) + EXCEPTION_CHARS]] if len(w) > len(term) else [])
            own.update([f"{words[i - 1]} {w} "] if i else [])
            own.update([f"{w} {words[i + 1]} "] if i + 1 < len(words) else [])
        for phrase, n in own.items():
            uses[y][phrase] += min(n, USES_OF_A_TEXT)
            clean_texts[phrase] += not y
    return sorted(p for p, n in clean_texts.items() if n >= EXCEPTION_SUPPORT and uses[1][p] / size[1] <= uses[0][p] / size[0])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> list[float]:
    """Newton's method for a ridge-penalised logistic regression."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - penalty * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-9:
            break
    return [float(b) for b in beta]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts from the folds that may be learned from, by a hash of the id.

    One text is collected for each drawn label, the least one where an id repeats, so never more than rows.
    """
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    own = own.filter((fold("doc_id", 5) != 0) & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    drawn = own.withColumn("draw", F.xxhash64("doc_id")).distinct().orderBy("draw", "doc_id", "label").limit(rows)
    texts_of = documents_of(docs, id_col, text_col).filter(F.length("text") <= SAMPLE_CHARS)
    found = texts_of.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # drawn has a fixed number of rows
    return [(r["text"], r["label"]) for r in found.collect()]


_lexicons: dict[str, Lexicon] = {}


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A score from 0 to 1 for every text, higher where the label 1 is likelier.

    The lexicon is learned from at most SAMPLE labelled rows whose crc32(doc_id) mod 5 isn't 0; a score sees the text
    only. A null or empty text has no words and gets the score of a text without matches. One row comes back for each
    row; a null id counts as the empty text in the folds. Without labels every score is near 0. Apart from the fit,
    whose broadcast is bounded by SAMPLE rows, the plan has no shuffle.
    """
    lexicon = learn(training_rows(df, labels, id_col, text_col, label_col))
    sent, digest = df.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon)), lexicon.digest

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        hold("toxicity", _lexicons.clear)
        if digest not in _lexicons:
            _lexicons.clear()
            _lexicons[digest] = pickle.loads(sent.value)
        scored = [_lexicons[digest].score(text) for text in texts(rows)]
        scores = [s for _, s in scored]
        return record_batch(_ARROW, [rows.column("doc_id"), rows.column("held_out"), scores, [int(s >= 0.5) for s in scores], [n for n, _ in scored]])

    docs = documents_of(df, id_col, text_col).withColumn("held_out", fold("doc_id", 5) == 0)
    return map_batches(docs, batch, SCHEMA)
