import re
import unicodedata
import zlib

import pytest

from loomq.llm import language_id, quality, toxicity

SF = "/root/testdata/sf0.1"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels


def test_languages_held_out(labelled):
    docs = labelled[0]
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = language_id.languages(docs).collect()
    assert len(out) == len(truth) and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.995 * len(held)
    assert language_id.keep_languages(docs).count() >= 0.999 * len(truth)


def test_held_out_languages_are_not_learned(labelled, spark):
    docs = labelled[0].limit(600)
    from pyspark.sql import functions as F

    swapped = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.languages(d).collect()} for d in (docs, swapped))
    assert a == b


def test_languages_odd(odd, empty, spark):
    out = {(r["doc_id"], r["lang_pred"]) for r in language_id.languages(odd).collect()}
    assert (1, "und") in out and (2, "und") in out and (5, "und") in out and (3, "en") in out
    assert language_id.languages(empty).count() == 0
    assert language_id.keep_languages(empty).count() == 0
    kept = language_id.keep_languages(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 6, None}
    nameless = odd.drop("lang").withColumn("lang", odd["source"].substr(1, 0).cast("string")).filter("lang is null")
    assert {r["lang_pred"] for r in language_id.languages(nameless).collect()} <= {"und"}


def _invented(alphabet, n, seed):
    import random

    r = random.Random(seed)
    stock = ["".join(r.choices(alphabet, k=r.randint(3, 8))) for _ in range(300)]
    return [" ".join(r.choices(stock, k=n)) for _ in range(12)]


def test_long_texts_are_learned(spark):
    long, short = _invented("abcdefghij", 6_000, 1), _invented("klmnopqrst", 60, 2)
    rows = [(i, "7" * 25_000 + t, "aa") for i, t in enumerate(long)] + [(100 + i, t, "kk") for i, t in enumerate(short)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {r[0]: r[2] for r in rows}
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.languages(df).collect()} == truth
    only = df.filter("lang = 'aa'")
    assert {r["lang_pred"] for r in language_id.languages(only).collect()} == {"aa"}
    assert language_id.keep_languages(only).count() == len(long)
    assert all(len(t) <= language_id.SAMPLE_CHARS for t, _ in language_id.training_rows(df))


def test_every_language_is_learned(spark):
    rows = [(100 * n + i, t, f"l{n}") for n in range(70) for i, t in enumerate(_invented([chr(0x4E00 + 20 * n + c) for c in range(10)], 8, n))]
    rows += [(10_000 + i, "rare words", "rare") for i in range(4_000)]  # one text, however often
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {lang for _, lang in language_id.training_rows(df)} == {r[2] for r in rows}
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.languages(df).collect()}
    assert all(out[i] == lang for i, _, lang in rows)


def test_copies_of_one_text_are_collected_once(spark):
    rows = [(i, "one and the same text", "en") for i in range(100_000)] + [(200_000 + i, f"anderer text {i}", "de") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_rows(df)
    assert sum(lang == "en" for _, lang in sample) == 1 and sum(lang == "de" for _, lang in sample) == language_id.SAMPLE


def _exact_grams(text):
    shown = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f" {text.lower()} ")
    shown = re.sub(" +", " ", shown)
    return {shown[i : i + n] for n in (1, 2, 3) for i in range(len(shown) - n + 1)}


def test_hashed_kernel_is_near_the_exact_one(labelled):
    """The kernel by sets of n-grams as they are, and the regression's verdicts by it, against the hashed one's."""
    import numpy as np

    rows = [r for r in labelled[0].filter("length(text) between 100 and 4000").orderBy("doc_id").limit(120).collect()]
    sets = [_exact_grams(r["text"]) for r in rows]
    model = language_id.fit([(r["text"], r["lang"]) for r in rows[:60]], landmarks=8)
    chosen = [next(i for i, r in enumerate(rows) if (language_id.grams(r["text"])[model.columns] == (m > 0)).all()) for m in model.landmarks]
    exact = np.array([[len(a & sets[k]) / (len(a) * len(sets[k])) ** 0.5 for k in chosen] for a in sets])
    hashed = model.kernel([r["text"] for r in rows])
    assert np.abs(exact - hashed).max() < 0.01
    names = model.predict([r["text"] for r in rows])[0]
    assert [model.languages[k] for k in (exact @ model.weights + model.bias).argmax(1)] == names


def test_nothing_to_learn_keeps_what_has_a_letter(spark):
    held = [i for i in range(100) if crc(i) % 4 == 2]
    rows = [(i, f"some words {i}", "en" if i in held else None) for i in range(100)] + [(100, "7 7", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.languages(df).collect()} == {"und"}
    assert language_id.keep_languages(df).count() == 100


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = [r for r in toxicity.toxicity(docs, labels).collect()]
    assert len(out) == docs.count()
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    caught = sum(r["predicted"] for r in held if truth[r["doc_id"]])
    assert right >= 0.98 * len(held) and caught >= 0.9 * sum(truth[r["doc_id"]] for r in held)


def test_folding():
    plain = toxicity.words_of("worthless idiot trash")
    assert toxicity.words_of("W0rthle$s 1d1ot tr@sh") == plain
    assert toxicity.words_of("wоrthlеss idіоt trаsh") == plain  # Cyrillic letters
    assert toxicity.words_of("ＷＯＲＴＨＬＥＳＳ idi​ot trash") == plain
    assert toxicity.words_of("achlichß Réeux!!") == ["achlichß", "réeux"]
    assert toxicity.words_of("10.37.1.2 call 555") == toxicity.words_of("10.37.1.2 call 555")


def test_doubtful_foldings_need_a_term():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "worthl": 2.0, "whore ": 4.0}, [], [0.0] * 5)
    for text, n in (("idio7 whor3", 2), ("wörthless idíot", 2), ("i d i o t", 1), ("i.d.i.o.t!", 1), ("w h o r e", 1), ("a b c d e", 0), ("win10 schön", 0), ("whores", 0), ("1diot$ idi0t.", 2), ("ɡ idiot", 1)):
        assert lexicon.matches(toxicity.words_of(text, lexicon.begins))[0] == n, text
    assert toxicity.words_of("schön win10 a b c d", lexicon.begins) == ["schön", "win", "a", "b", "c", "d"]


def test_automaton_equals_a_plain_search():
    """Every word's beginnings against the terms, and every phrase's place against them, without an automaton."""
    import random

    r = random.Random(6)
    letters = "abc"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 6)))
    for _ in range(300):
        terms: dict[str, float] = {}
        for _ in range(8):
            t = word() + r.choice(["", " "])
            if len(t) >= 3 and not any(t.startswith(x) or x.startswith(t) for x in terms):
                terms[t] = r.random() + 0.1
        exceptions = sorted({r.choice([word(), f"{word()} {word()} "]) for _ in range(6)} - set(terms))
        words = [word() for _ in range(r.randint(0, 30))]
        line, found = " " + " ".join(words) + " ", []
        for start in (i for i, c in enumerate(line) if c == " "):
            found += [(start, start + len(t) + 1, w) for t, w in terms.items() if line.startswith(t, start + 1)]
        spans = [(i, i + len(p) + 1) for p in exceptions for i in range(len(line)) if line.startswith(" " + p, i)]
        kept = [w for a, b, w in found if not any(c <= a and b <= d for c, d in spans)]
        n, weight = toxicity.Lexicon(terms, exceptions, [0.0] * 5).matches(words)
        assert n == len(kept) and abs(weight - sum(kept)) < 1e-9


def test_exception_of_two_words():
    names = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(4)]
    bad = [(f"you trash {w} trash {v}", 1) for w, v in zip(names, reversed(names))]
    good = [(f"take the trash can {w} out", 0) for w in names[:6]] + [(f"nothing here {w} {v} of you", 0) for w in names for v in names[:5]]
    lexicon = toxicity.learn(bad + good)
    assert "trash can " in lexicon.exceptions and not any(e.startswith("you trash") for e in lexicon.exceptions)
    assert lexicon.matches(["the", "trash", "can"])[0] == 0 and lexicon.matches(["you", "trash", "man"])[0] == 1


def test_held_out_labels_leave_scores_unchanged(labelled, spark):
    from pyspark.sql import functions as F

    docs, labels = labelled[0].limit(2_000), labelled[1]
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    swapped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, swapped))
    assert a == b


def test_repeated_ids_are_collected_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5_000)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)] * 50 + [(2, 0, 0)], "doc_id long, toxic int, quality int")
    assert len(quality.training_rows(docs, labels, "doc_id", "text", "quality")) == 2
    assert sorted(t for t, _ in toxicity.training_rows(docs, labels, "doc_id", "text", "toxic")) == ["other", "text 0"]


def test_exceptions_and_order():
    bad = [(f"you scum {w} scum today", 1) for w in "abcdefghijklmnopqrst"] * 1
    good = [(f"the scummery of {w} is a place", 0) for w in "abcdefghijklmnopqrst"] + [(f"nothing here {w}", 0) for w in "abcdefghijklmnopqrst"]
    lexicon = toxicity.learn(bad + good)
    assert lexicon.digest == toxicity.learn(list(reversed(bad + good))).digest
    assert lexicon.score("what scum")[1] > 0.5 > lexicon.score("the scummery")[1]
    assert toxicity.learn([]).score("anything")[1] < 0.01


def test_toxicity_odd(odd, empty, spark):
    labels = spark.createDataFrame([(3, 1, "x"), (4, 0, "x"), (None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(odd, labels.filter("false")).count() == odd.count()


def test_quality_held_out(labelled):
    """Learned without a fold of the labels, judged on that fold."""
    from pyspark.sql import functions as F

    docs, labels = labelled
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    out = {r["doc_id"]: r for r in quality.quality(docs, labels.filter(~held)).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.filter(held).collect()}
    judged = [out[i] for i in truth if not out[i]["base_failed"]]
    right = sum(r["kept"] == bool(truth[r["doc_id"]]) for r in judged)
    print(f"quality: {right} of {len(judged)} held-out texts")
    assert right >= 0.98 * len(judged)
    assert not any(r["kept"] for r in out.values() if r["base_failed"])


def test_gradient_is_the_slope():
    import numpy as np

    r = np.random.default_rng(4)
    sample = [(r.normal(size=(n, quality._WIDTH)), r.integers(0, 2, n)) for n in (1, 3, 5)]
    weights, moves = r.normal(size=(quality._WIDTH, 2)), r.normal(size=(2, 2))
    _, a, b = quality._gradient(sample, weights, moves)
    for array, gradient in ((weights, a), (moves, b)):
        for at in np.ndindex(array.shape):
            values = []
            for step in (1e-5, -1e-5):
                array[at] += step
                values.append(quality._gradient(sample, weights, moves)[0])
                array[at] -= step
            assert abs((values[0] - values[1]) / 2e-5 - gradient[at]) < 1e-4


def test_lines_beyond_two_hundred_are_learned():
    good = [(("A line of words that ends here. Another one.\n" * 300 + f"tail {i}.").encode(), 1) for i in range(6)]
    bad = [(("A line of words that ends here. Another one.\n" * 220 + "# $ % | menu\n" * 400 + f"x {i}").encode(), 0) for i in range(6)]
    field = quality.train(good + bad)
    shares = [field.content_share(*quality.line_features(t))[0] for t, _ in (good[0], bad[0])]
    assert shares[0] >= field.least_share > shares[1]


def _brute(text):
    import re
    from collections import Counter

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[(w[i], w[i + 1], w[i + 2])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts(docs, rows, odd, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for df, known in ((docs, rows), (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        got = sorted((tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.quality(df, labels).collect()))
        assert got == sorted(_brute(t) for _, t in known)
    for text in ("a a a a", "x y z\nx y z", "é é é\xa0é", "a\x1cb \x85 c", "\n\na\n \na"):
        assert quality.base_counts(text.encode()) == _brute(text)


def test_quality_without_labels(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] != r["base_failed"] for r in quality.quality(odd, none).collect())
    assert quality.quality(empty, none).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(20):
        field = quality.Field(r.normal(size=(quality._WIDTH, 2)), r.normal(size=(2, 2)), 0.0)
        x = r.normal(size=(6, quality._WIDTH))
        scores = x @ field.weights
        best = max(itertools.product((0, 1), repeat=6), key=lambda y: sum(scores[i, a] for i, a in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        assert field.decode(x) == list(best)


@pytest.mark.parametrize("run", ["0", "01", "$", "!", "a1", "h a t e . "])
def test_toxicity_of_long_runs(run):
    """A million signs that a word could have are read once."""
    import time

    lexicon = toxicity.Lexicon({"hate": 1.0}, [], [0.0] * 5)
    text = (run * (1_000_000 // len(run)))[:1_000_000]
    began = time.perf_counter()
    lexicon.score(text)
    toxicity.words_of(text)
    assert time.perf_counter() - began < 4
    assert toxicity.words_of("a" * 50 + "t3", lambda w: w == "a" * 50 + "te") == ["a" * 50 + "te"]  # long words whole


def test_many_languages_stay_small():
    """64 languages of letters of their own fill all hashed columns; what is sent stays bounded, and they are told apart."""
    import pickle
    import random

    def made(n):
        r = random.Random(n)
        stock = ["".join(r.choices([chr(0x4E00 + 40 * n + c) for c in range(40)], k=r.randint(2, 9))) for _ in range(300)]
        return lambda seed, words: " ".join(random.Random(1000 * n + seed).choices(stock, k=words))

    writers = {f"l{n:02d}": made(n) for n in range(64)}
    share = language_id.even_share(language_id.LANDMARKS, 64) + 8
    model = language_id.fit([(write(k, 150), lang) for lang, write in writers.items() for k in range(share)])
    test = [(write(900 + k, 40), lang) for lang, write in writers.items() for k in range(4)]
    whole, small = model.scorer(), model.scorer(most=8_000_000)
    assert len(pickle.dumps(whole)) < 200e6 and len(pickle.dumps(small)) < 9e6
    for scorer in (whole, small):
        assert sum(a == b for a, (_, b) in zip(scorer.predict([t for t, _ in test])[0], test)) >= 0.98 * len(test)


def test_most_frequent_languages(spark, monkeypatch):
    """A dirty language column can't grow what is collected: the languages with the most texts are learned."""
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(i, f"some words {i}", "en") for i in range(30)] + [(100 + i, f"andere {i}", "de") for i in range(20)] + [(200 + i, f"odd {i}", f"x{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {lang for _, lang in language_id.training_rows(df)} == {"en", "de"}
