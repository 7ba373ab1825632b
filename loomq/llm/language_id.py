"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of presence: the number of character n-grams (n = 1 to 3) that both
have, over the geometric mean of how many each has. Nyström landmarks give every text finite features, a one-versus-rest
kernel ridge regression is fitted on them, and batches of texts are scored by matrix products.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomq.llm.common import documents_of, fold, hold, map_batches, record_batch, texts
from loomq.session import expose_package

#: Bounds of the labelled sample: texts for each language (of a longer one an excerpt of so many characters) and landmarks among them.
SAMPLE, SAMPLE_CHARS, LANDMARKS = 500, 20_000, 48
#: Up to so many languages have the whole sample each; more share as many texts and landmarks in all, at least one each.
LANGUAGES = 16
#: Languages that are learned, those with the most texts first, and bytes of the weights that are sent for all of them.
MOST_LANGUAGES, MODEL_BYTES = 256, 128_000_000
RIDGE = 1e-2
#: Score below which a filter rejects a text.
LEAST_SCORE = 0.3
#: Steepness of the softmax that turns regression outputs, about 1 and -1, into scores.
STEEPNESS = 4.0
#: n-grams are told apart by a hash of so many bits.
BITS = 18
#: Texts in a matrix product.
BLOCK = 256

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _letters() -> np.ndarray:
    """For every code point 0 if it isn't a letter or mark, else a number below 2**16."""
    global _TABLE
    if _TABLE is None:
        import unicodedata

        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] in "LM":
                table[c] = c
        _TABLE = table
    return _TABLE


_TABLE: np.ndarray | None = None


def grams(text: str) -> np.ndarray:
    """Presence of every hashed n-gram of a text, lower-cased, each run of other characters one space."""
    codes = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    a = codes[keep]
    shift = np.uint32(32 - BITS)
    found = np.zeros(1 << BITS, bool)
    one = a * np.uint32(2654435769)
    found[one >> shift] = True
    if len(a) > 1:
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519) + a[1:] * np.uint32(3266489917)
        two ^= two >> np.uint32(15)
        found[(two * np.uint32(2654435769)) >> shift] = True
        if len(a) > 2:
            three = two[:-1] * np.uint32(668265263) + a[2:] * np.uint32(374761393)
            three ^= three >> np.uint32(13)
            found[(three * np.uint32(2654435769)) >> shift] = True
    return found


#: Columns of a dense block when landmarks are multiplied.
WIDE = 8192


def _products(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """rows @ others.T of two presence matrices; only a block of columns at a time is more than one byte an entry."""
    total = np.zeros((len(rows), len(others)), np.float32)
    for i in range(0, rows.shape[1], WIDE):
        total += rows[:, i : i + WIDE].astype(np.float32) @ others[:, i : i + WIDE].astype(np.float32).T
    return total


class Scorer:
    """What scoring needs: of every n-gram that counts its weight for each language.

    A text's kernel with the landmarks is linear in the presence of its n-grams, and so are the regressions over it; the
    landmarks are summed up in one matrix of columns by languages.
    """

    def __init__(self, languages: list[str], columns: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.columns, self.weights, self.bias = languages, columns, weights, bias
        self.digest = hashlib.sha256(weights.tobytes() + columns.tobytes()).hexdigest()

    def predict(self, sample: list[str]) -> tuple[list[str], list[float]]:
        """The language and its score of every text; 'und' and 0 where there is no letter or no learned language."""
        names, scores = [], []
        for i in range(0, len(sample), BLOCK):
            part = sample[i : i + BLOCK]
            if not self.languages:
                names += ["und"] * len(part)
                scores += [0.0] * len(part)
                continue
            rows, sizes = np.zeros((len(part), len(self.columns)), np.float32), np.zeros(len(part))
            for k, text in enumerate(part):
                found = grams(text)
                rows[k], sizes[k] = found[self.columns], np.count_nonzero(found)
            outputs = STEEPNESS * ((rows @ self.weights).astype(np.float64) / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias)
            chances = np.exp(outputs - outputs.max(1, keepdims=True))
            chances /= chances.sum(1, keepdims=True)
            best = chances.argmax(1)
            for text, k, row in zip(part, best, chances):
                known = has_letter(text)
                names.append(self.languages[k] if known else "und")
                scores.append(float(row[k]) if known else 0.0)
        return names, scores


class Model:
    """A fit: the landmarks' n-grams as presence by columns, and one weight vector over landmarks for each language."""

    def __init__(self, languages: list[str], columns: np.ndarray, landmarks: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.columns, self.landmarks, self.weights, self.bias = languages, columns, landmarks, weights, bias
        self.sizes = np.sqrt(np.maximum(landmarks.sum(1), 1)) if landmarks.size else np.ones(len(landmarks))

    def kernel(self, sample: list[str]) -> np.ndarray:
        rows, sizes = np.zeros((len(sample), len(self.columns)), bool), np.zeros(len(sample))
        for i, text in enumerate(sample):
            found = grams(text)
            rows[i], sizes[i] = found[self.columns], np.count_nonzero(found)
        return _products(rows, self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None] / self.sizes

    def scorer(self, most: int = MODEL_BYTES) -> Scorer:
        """The landmarks summed up; where that is more than the bytes allow, the n-grams of most landmarks are kept."""
        columns, landmarks = self.columns, self.landmarks
        room = max(1, most // (4 * max(1, len(self.languages))))
        if len(columns) > room:
            kept = np.sort(np.argsort(-landmarks.sum(0), kind="stable")[:room])
            columns, landmarks = columns[kept], landmarks[:, kept]
        own = self.weights / self.sizes[:, None]
        weights = [landmarks[:, i : i + WIDE].T.astype(np.float64) @ own for i in range(0, len(columns), WIDE)]
        joined = np.concatenate(weights).astype(np.float32) if weights else np.zeros((0, len(self.languages)), np.float32)
        return Scorer(self.languages, columns.astype(np.int32), joined, self.bias)

    def predict(self, sample: list[str]) -> tuple[list[str], list[float]]:
        return self.scorer().predict(sample)


def even_share(each: int, languages: int) -> int:
    """How many of a bound for each language are left to one if there are more languages than LANGUAGES."""
    return max(1, min(each, each * LANGUAGES // max(languages, 1)))


def fit(labelled: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from (text, language) pairs, the same for the same pairs in any order."""
    labelled = sorted((lang, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), text) for text, lang in labelled)
    languages = sorted({x[0] for x in labelled})
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), bool), np.zeros((0, 0)), np.zeros(0))
    landmarks = even_share(landmarks, len(languages))
    groups = {lang: list(g) for lang, g in groupby(labelled, lambda x: x[0])}
    chosen = [x[2] for lang in languages for x in groups[lang][:landmarks]]
    found = np.stack([grams(text) for text in chosen])
    columns = np.flatnonzero(found.any(0))
    model = Model(languages, columns, found[:, columns], np.zeros((len(chosen), len(languages))), np.zeros(len(languages)))
    del found
    between = _products(model.landmarks, model.landmarks).astype(np.float64) / np.outer(model.sizes, model.sizes)
    values, vectors = np.linalg.eigh(between)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T  # Nyström: features are kernel @ whiten
    number, counts = {lang: n for n, lang in enumerate(languages)}, {lang: len(g) for lang, g in groups.items()}
    left, right = ridge * np.eye(len(chosen) + 1), np.zeros((len(chosen) + 1, len(languages)))
    left[-1, -1] = 0
    for i in range(0, len(labelled), BLOCK):  # the normal equations, summed up
        part = labelled[i : i + BLOCK]
        features = np.hstack([model.kernel([x[2] for x in part]).astype(np.float64) @ whiten, np.ones((len(part), 1))])
        weighted = features * np.array([1 / counts[x[0]] for x in part])[:, None]  # languages weigh the same
        target = np.full((len(part), len(languages)), -1.0)
        target[np.arange(len(part)), [number[x[0]] for x in part]] = 1.0
        left += weighted.T @ features
        right += weighted.T @ target
    solved = np.linalg.solve(left, right)
    return Model(languages, columns, model.landmarks, whiten @ solved[:-1], solved[-1])


def training_rows(df: DataFrame, per_language: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """A bounded sample of labelled texts, by a hash of the text, from the folds that may be learned from.

    Every language with a labelled text that has a letter is in it, up to the MOST_LANGUAGES with the most texts. Of a text over SAMPLE_CHARS the excerpt from its first
    letter on is taken. One scan counts each language's distinct texts, another keeps about three times the sample's size,
    which is cut to it by the draw before anything is collected. Texts that repeat count once.
    """
    docs = documents_of(df, id_col, text_col, lang=lang_col).filter((fold("doc_id", 4) != 2) & F.col("lang").isNotNull())
    usable = docs.filter(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    counted = usable.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"), F.min(_draw("hash")).alias("least"))
    top = counted.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not top:
        return []
    per_language = even_share(per_language, len(top))
    # The least draw is always kept, so that a language of few texts can't be missed.
    limits = [(r["lang"], max(3.0 * per_language / max(r["n"], 1), r["least"])) for r in top]
    limit = df.sparkSession.createDataFrame(limits, "lang string, most double")
    from_letter = F.regexp_replace("text", r"^\P{L}+", "")
    excerpt = F.when(F.length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(F.substring(from_letter, 1, SAMPLE_CHARS))
    near = usable.join(F.broadcast(limit), "lang").filter(_draw("hash") <= F.col("most"))
    once = near.groupBy("lang", "hash").agg(F.min(excerpt).alias("text")).withColumn("draw", _draw("hash"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    return [(r["text"], r["lang"]) for r in once.withColumn("place", place).filter(F.col("place") <= per_language).collect()]


def _draw(hashed: str) -> Column:
    return F.pmod(F.col(hashed), F.lit(1_000_003)) / 1_000_003


_models: dict[str, Model] = {}


def _release() -> None:
    global _TABLE
    _TABLE = None
    _models.clear()


def _predictor(df: DataFrame, train: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[Callable[[list[str]], tuple[list[str], list[float]]], bool]:
    """A fitted model as a function that executors can call, and whether it has learned any language."""
    model = fit(training_rows(train, id_col=id_col, text_col=text_col, lang_col=lang_col)).scorer()
    sent, digest = df.sparkSession.sparkContext.broadcast(pickle.dumps(model)), model.digest

    def predict(sample: list[str]) -> tuple[list[str], list[float]]:
        hold("language ID", _release)
        if digest not in _models:
            _models.clear()
            _models[digest] = pickle.loads(sent.value)
        return _models[digest].predict(sample)

    return predict, bool(model.languages)


def keep_languages(
    df: DataFrame, least_score: float = LEAST_SCORE, allowed: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The rows of df, all columns unchanged, whose text has a language.

    Rows go whose prediction is 'und', isn't among the allowed languages or has a score below least_score. Null and
    letterless texts go therefore. If no labelled row outside the fold has a letter, nothing can be learned, and only
    letterless texts go.
    """
    expose_package(df.sparkSession)
    predict, learned = _predictor(df, df, id_col, text_col, lang_col)

    def passes(column: pa.Array) -> pa.Array:
        sample = [x or "" for x in column.to_pylist()]
        if not learned:
            return pa.array(map(has_letter, sample), pa.bool_())
        names, scores = predict(sample)
        return pa.array([n != "und" and s >= least_score and (allowed is None or n in allowed) for n, s in zip(names, scores)], pa.bool_())

    return df.filter(F.arrow_udf(passes, "boolean")(F.col(f"`{text_col}`").cast("string")))


def languages(df: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The predicted language of every text and its score.

    The model is fitted on a bounded sample of df, or of train, whose crc32(doc_id) mod 4 isn't 2; predictions see the
    text only. A null text and one without a letter give 'und' and score 0, as does everything if no labelled row outside
    that fold has a letter.
    One row comes back for each row; a null id counts as the empty text in the folds. Apart from the fit the plan has
    no shuffle; the model that is broadcast has a row of weights for each hashed n-gram of a landmark, and at most MODEL_BYTES.
    """
    predict, _ = _predictor(df, train if train is not None else df, id_col, text_col, lang_col)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = predict(texts(rows))
        return record_batch(_ARROW, [rows.column("doc_id"), rows.column("held_out"), names, scores])

    docs = documents_of(df, id_col, text_col).withColumn("held_out", fold("doc_id", 4) == 2)
    return map_batches(docs, batch, SCHEMA)
