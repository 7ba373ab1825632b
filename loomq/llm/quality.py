"""Quality rules with line sequence labelling.

Every line of a text gets features; a linear-chain conditional random field over two labels, content and boilerplate, is
decoded by the Viterbi algorithm. The share of a text's word characters on content lines decides whether it is kept,
after a base rule on length and repetition.

The field is trained on a bounded sample of labelled texts. Only texts have labels, not lines: a line starts with its
text's label, and after each fit the lines of bad texts take their decoded labels where at least one line stays
boilerplate, so that good lines inside bad texts aren't learned as boilerplate.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomq.llm.common import documents_of, hold, map_batches, raw_texts, record_batch

#: Bounds of the labelled sample: texts, and characters of a text that may be in it.
SAMPLE, SAMPLE_CHARS = 4_000, 20_000
#: Lines, padding included, whose sums are held at once while training.
PADDED_LINES = 50_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate long"
)
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("n_lines", pa.int64()), ("n_boilerplate", pa.int64())]
)

# The symbols that are counted, and the bytes that are white space.
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_UPPER, _LOWER, _DIGITS = (bytes(b for b in range(256) if b not in kept) for kept in (range(65, 91), range(97, 123), range(48, 58)))
_CONTINUED = bytes(range(0x80, 0xC0))
_WIDTH = 16


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text; bytes.split() cuts at _SPACE."""
    words = text.split()
    word_chars = len(text.translate(None, _SPACE + _CONTINUED))
    seen, n_dup_lines = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return len(words), word_chars, len(text.translate(None, _NOT_SYMBOLS)), n_dup_lines, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    first: dict[tuple, int] = {}
    covered: set[int] = set()
    if len(set(windows)) == len(windows):
        return 0
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            covered.update((j, j + 1, j + 2, i, i + 1, i + 2))
    return len(covered)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def line_features(text: bytes) -> tuple[np.ndarray, list[int]]:
    """One row of features and the word characters of every line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line.translate(None, _SPACE + _CONTINUED))
        upper, lower = len(line.translate(None, _UPPER)), len(line.translate(None, _LOWER))
        symbols = len(line.translate(None, _NOT_SYMBOLS))
        distinct = len(set(words))
        sentence_ends = line.count(b". ") + line.endswith(b".")
        alone = line.count(b" | ")
        rows.append((
            1.0, min(n, 60) / 60, n < 4, min(symbols / n, 2.0), symbols > 0, min(alone / n, 1.0), min(line.count(b"!") / n, 2.0),
            upper > lower, min(upper / (upper + lower + 1), 1.0), min(len(line.translate(None, _DIGITS)) / size, 1.0),
            distinct / n if n > 5 else 1.0, n > 5 and distinct < 0.5 * n, min(size / n, 20) / 20, min(sentence_ends, 5) / 5,
            line in seen, line[-1:] in b".?!" and 65 <= line[0] <= 90,
        ))
        seen.add(line)
        sizes.append(size)
    return np.array(rows, np.float64).reshape(-1, _WIDTH), sizes


class Field:
    """A linear-chain conditional random field with the labels 0 (content) and 1 (boilerplate)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, least_share: float):
        self.weights, self.moves, self.least_share = weights, moves, least_share
        self.digest = hashlib.sha256(weights.tobytes() + moves.tobytes() + np.float64(least_share).tobytes()).hexdigest()

    def decode(self, features: np.ndarray) -> list[int]:
        """The most probable labels, by the Viterbi algorithm in time and memory linear in the lines."""
        scores = (features @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, a, b = [], 0.0, 0.0
        for k, (x, y) in enumerate(scores):
            if k:
                back.append((b + m10 > a + m00, b + m11 > a + m01))
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
            a, b = a + x, b + y
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1] if scores else []

    def content_share(self, features: np.ndarray, sizes: list[int]) -> tuple[float, int]:
        labels = self.decode(features)
        total = sum(sizes)
        return (sum(s for s, y in zip(sizes, labels) if not y) / total if total else 0.0), sum(labels)


def _gradient(sample: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of padded sequences and its gradient, by forward and backward sums over all of them at once."""
    lengths = np.array([len(x) for x, _ in sample])
    n, t = len(sample), lengths.max()
    x, y = np.zeros((n, t, _WIDTH)), np.zeros((n, t), int)
    for i, (a, b) in enumerate(sample):
        x[i, : len(a)], y[i, : len(b)] = a, b
    real = np.arange(t) < lengths[:, None]
    scores = x @ weights
    add = np.logaddexp.reduce
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    forward[:, 0] = scores[:, 0]
    for k in range(1, t):
        stepped = add(forward[:, k - 1, :, None] + moves, axis=1) + scores[:, k]
        forward[:, k] = np.where(real[:, k, None], stepped, forward[:, k - 1])
    for k in range(t - 2, -1, -1):
        stepped = add(moves + (scores[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
        backward[:, k] = np.where(real[:, k + 1, None], stepped, 0.0)
    norm = add(forward[:, -1], axis=1)
    share = np.exp(forward + backward - norm[:, None, None]) * real[:, :, None]
    truth = np.eye(2)[y] * real[:, :, None]
    pair = np.exp(forward[:, :-1, :, None] + moves + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * real[:, 1:, None, None]
    pair_truth = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    likelihood = (scores * truth).sum() + (moves * pair_truth).sum() - norm.sum()
    return likelihood, np.einsum("ntf,nty->fy", x, truth - share), pair_truth - pair.sum((0, 1))


def train(labelled: list[tuple[bytes, int]], rounds: int = 3, steps: int = 60) -> Field:
    """A field from (text, 1 good or 0 bad) pairs, the same for the same pairs in any order.

    With one kind of text only, or none, nothing is boilerplate and every text passes.
    """
    labelled = sorted({(hashlib.sha256(t).digest(), t, y) for t, y in labelled})
    sample = [(*line_features(t), y) for _, t, y in labelled]
    sample = [(x, sizes, y) for x, sizes, y in sample if len(x)]
    neutral = Field(np.zeros((_WIDTH, 2)), np.zeros((2, 2)), 0.0)
    if len({y for _, _, y in sample}) < 2:
        return neutral
    lines = [np.full(len(x), 1 - y) for x, _, y in sample]
    by_length = sorted(range(len(sample)), key=lambda i: len(sample[i][0]))
    groups: list[list[int]] = [[]]
    for i in by_length:  # texts of about the same length, as many as the padded lines allow
        if groups[-1] and (len(groups[-1]) + 1) * len(sample[i][0]) > PADDED_LINES:
            groups.append([])
        groups[-1].append(i)
    weights, moves = np.zeros((_WIDTH, 2)), np.zeros((2, 2))
    field = neutral
    for _ in range(rounds):
        scale = 1.0 / sum(len(x) for x, _, _ in sample)
        first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
        for step in range(1, steps + 1):  # Adam on the penalised likelihood
            total = [np.zeros_like(weights), np.zeros_like(moves)]
            for group in groups:
                _, a, b = _gradient([(sample[i][0], lines[i]) for i in group], weights, moves)
                total[0] += a
                total[1] += b
            for k, (p, g) in enumerate(((weights, total[0]), (moves, total[1]))):
                g = g * scale - 1e-4 * p
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p += 0.3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        field = Field(weights.copy(), moves.copy(), 0.0)
        for i, (x, _, y) in enumerate(sample):
            if not y:
                decoded = np.array(field.decode(x))
                if decoded.any():
                    lines[i] = decoded
    shares = np.array([field.content_share(x, sizes)[0] for x, sizes, _ in sample])
    good = np.array([y for _, _, y in sample], bool)
    cuts = np.unique(np.round(np.concatenate([shares, [0.0, 0.5, 1.0]]), 3))
    # The least share that keeps most good texts and drops most bad ones; the lowest such share keeps clean texts in.
    value = [((shares >= c) & good).sum() / good.sum() + ((shares < c) & ~good).sum() / (~good).sum() for c in cuts]
    best = max(value)
    return Field(weights, moves, float(cuts[next(k for k, v in enumerate(value) if v >= best - 0.002)]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE) -> list[tuple[bytes, int]]:
    """A bounded sample of labelled texts by a hash of the id, half of it for each label if there are enough.

    One text is collected for each drawn label, the least one where an id repeats, so never more than rows.
    """
    own = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    own = own.filter(F.col("doc_id").isNotNull()).withColumn("draw", F.xxhash64("doc_id")).distinct()
    halves = [own.filter(F.col("label") == y).orderBy("draw", "doc_id").limit(rows // 2) for y in (0, 1)]
    texts_of = documents_of(docs, id_col, text_col).filter(F.length("text") <= SAMPLE_CHARS)
    drawn = F.broadcast(halves[0].unionByName(halves[1]))  # of a fixed number of rows
    found = texts_of.join(drawn, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r["text"].encode("utf-8"), r["label"]) for r in found.collect()]


_fields: dict[str, Field] = {}


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Base counts of every text, the base rule's verdict, and whether the text is kept.

    kept: the base rule didn't fail, and content lines hold at least the learned share of the word characters. A null
    or empty text has no words and fails the base rule. One row comes back for each row; without labels only the base
    rule decides. Apart from the fit, whose broadcast is bounded by SAMPLE rows, the plan has no shuffle.
    """
    field = train(training_rows(df, labels, id_col, text_col, label_col))
    sent, digest = df.sparkSession.sparkContext.broadcast(pickle.dumps(field)), field.digest

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        hold("quality", _fields.clear)
        if digest not in _fields:
            _fields.clear()
            _fields[digest] = pickle.loads(sent.value)
        model, out = _fields[digest], [[] for _ in _ARROW.names[1:]]
        for text in raw_texts(rows):
            counts = base_counts(text)
            failed = base_failed(counts[0], counts[4])
            features, sizes = line_features(text)
            share, n_boilerplate = model.content_share(features, sizes)
            for column, value in zip(out, (*counts, failed, not failed and share >= model.least_share, share, len(sizes), n_boilerplate)):
                column.append(value)
        return record_batch(_ARROW, [rows.column("doc_id"), *out])

    return map_batches(documents_of(df, id_col, text_col), batch, SCHEMA)
