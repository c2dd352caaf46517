"""Language identification and quality: held-out accuracy, odd inputs, and what is learnt."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quernstone.llm import langid, quality

SYLLABLES = {"aa": ["th", "er", "on", "an"], "bb": ["sch", "ein", "ung", "ü"], "cc": ["eau", "oi", "é", "tre"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, speech(rng, lang, rng.randrange(4, 60)), lang))
    return rows


SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def filters(spark):
    rows = corpus(1, 300) + [(900, None, "aa"), (901, "th er on", None)]
    return langid.train(spark.createDataFrame(rows, SCHEMA))


def test_language_of_held_out_texts(spark, filters):
    rows = corpus(2, 300)
    out = langid.predict(spark.createDataFrame(rows, SCHEMA), filters).collect()
    want = {i: lang for i, _, lang in rows}
    assert sum(r.lang_pred == want[r.doc_id] for r in out) >= 297
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_texts(spark, filters):
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "漢字漢字"), (5, "th er on " * 30_000), (6, "x")]
    df = spark.createDataFrame([(i, t, "zz") for i, t in odd], SCHEMA)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, filters).collect()}
    assert [out[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert out[4][0] in SYLLABLES and out[4][1] == 0.0
    assert out[5][0] == "aa"
    assert langid.predict(df.limit(0), filters).count() == 0


def test_nothing_to_learn_from(spark):
    empty = langid.train(spark.createDataFrame([], SCHEMA))
    df = spark.createDataFrame([(1, "words", "aa")], SCHEMA)
    assert [r.lang_pred for r in langid.predict(df, empty).collect()] == ["und"]


def test_filters_answer_for_every_known_gram(filters):
    code, _ = langid.text_grams([b"then ein"])
    slots = langid.slots_of(code, filters.bits)
    (masks,) = filters.masks
    mask = masks[slots[0]] & masks[slots[1]] & masks[slots[2]]
    assert (mask != 0).any()
    assert (filters.by_chance() < 0.5).all()


def test_grams_stay_inside_texts():
    code, owner = langid.text_grams([b"ab", b"", None, b"c"])
    one, _ = langid.text_grams([b"ab"])
    two, _ = langid.text_grams([b"c"])
    assert sorted(code[owner == 0].tolist()) == sorted(one.tolist())
    assert sorted(code[owner == 3].tolist()) == sorted(two.tolist())


def grams_of(text):
    low = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").encode().lower())
    low = b" " + low + b"  "
    return [low[i : i + 4] for i in range(len(low) - 3) if low[i : i + 4].strip() and low[i + 1 : i + 3] != b"  "]


def by_sets(rows, texts, share=0.02, least=2):
    """The decision with sets in place of filters."""
    counts = {}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams_of(t))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    top = Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / total[lang])
    known = {lang: {g for g, n in c.items() if n >= least and n / total[lang] >= share * top[g]} for lang, c in counts.items()}
    out = []
    for t in texts:
        votes = sorted(((sum(g in known[lang] for g in grams_of(t)), lang) for lang in sorted(known)), key=lambda x: -x[0])
        out.append(votes)
    return out


def test_decisions_are_those_of_sets(spark, filters):
    rows = [*corpus(1, 300), (900, None, "aa"), (901, "th er on", None)]
    texts = [t for _, t, _ in corpus(8, 150)] + ["th ein", "eau ung er", "x th"]
    want = by_sets(rows, texts)
    got = filters.decide(texts)
    for votes, lang, score in zip(want, *got, strict=True):
        if votes[0][0] - votes[1][0] > 2:  # false positives may turn a tie
            assert lang == votes[0][1]
        assert abs(score - votes[0][0] / max(1, votes[0][0] + votes[1][0])) < 0.15
    assert len(set(got[0])) == 3
    small = langid.train(spark.createDataFrame(rows, SCHEMA), most_slots=1 << 8)  # far too full: by_chance is taken off
    assert (small.by_chance() > 0.3).any()
    assert np.mean([a == v[0][1] for a, v in zip(small.decide(texts[:150])[0], want[:150], strict=True)]) > 0.9


def test_long_texts_in_parts():
    rng = random.Random(3)
    texts = [speech(rng, lang, n).encode() for lang, n in (("aa", 5), ("bb", 900), ("cc", 1), ("aa", 300))] + [None, b"", b"   "]
    want = sorted(zip(*(x.tolist() for x in langid.text_grams(texts)), strict=True))
    got = sorted(g for code, owner in langid.gram_runs(texts, 100) for g in zip(code.tolist(), owner.tolist(), strict=True))
    assert got == want


def test_more_than_64_languages(spark):
    rng = random.Random(4)
    words = {f"l{i:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(130)}
    say = lambda lang: " ".join(rng.choices(words[lang], k=20))
    many = langid.train(spark.createDataFrame([(i, say(lang), lang) for i, lang in enumerate(list(words) * 4)], SCHEMA))
    assert len(many.langs) == 130 and len(many.masks) == 3
    assert np.mean([a == b for a, b in zip(many.decide([say(x) for x in words])[0], words, strict=True)]) > 0.97


def labelled(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = speech(rng, "aa", rng.randrange(30, 200)) if good else " ".join(w.upper() + "!!" for w in speech(rng, "bb", rng.randrange(30, 200)).split())
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_of_held_out_texts(spark):
    rows, labels = labelled(1, 300)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7777, 0), (5, None)], "doc_id long, quality int")
    model = quality.fit(df, lab)
    fresh, truth = labelled(2, 200)
    fresh += [(1000, None), (1001, ""), (1002, "th er on " * 20_000)]
    out = {r.doc_id: r for r in quality.score(spark.createDataFrame([(i, t, "x") for i, t in fresh], "doc_id long, text string, score string"), model).collect()}
    assert sum(out[i].predicted == y for i, y in truth) >= 196
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert len(out) == len(fresh) and out[1000].score == out[1001].score
    assert quality.score(df.limit(0), model).count() == 0


def test_quality_sample_is_bounded_and_repeatable(spark):
    rows, labels = labelled(3, 120)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = (quality.fit(df.repartition(n), lab, rows=20, most_bytes=20_000) for n in (1, 5))
    assert a.good == b.good and a.bad == b.bad and np.allclose(a.weights, b.weights)


def test_quality_with_a_long_text_first(spark):
    rows, labels = labelled(4, 200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    first = {y: lab.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id")).first().doc_id for y in (0, 1)}
    fresh, truth = labelled(5, 100)
    fresh = spark.createDataFrame(fresh, "doc_id long, text string")
    label = dict(labels)
    for y in (0, 1):
        one = [(i, t * 400 if i == first[y] else t) for i, t in rows]
        every = [(i, t * 400 if label[i] == y else t) for i, t in rows]
        for docs in (one, every):
            model = quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), lab, most_bytes=80_000)
            out = {r.doc_id: r.predicted for r in quality.score(fresh, model).collect()}
            assert set(out.values()) == {0, 1}
            if docs is one:
                assert sum(out[i] == v for i, v in truth) >= 90


def test_quality_with_one_class_or_none(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for labels, low, high in (([], 0.5, 0.5), ([(1, 1)], 0.9, 1.0), ([(1, 0)], 0.0, 0.1)):
        model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert low <= quality.score(df, model).first().score <= high


def test_logistic_regression_settles_on_separable_classes():
    """Classes that are wholly apart: weights stay finite and right."""
    d = np.random.default_rng(1).normal(0, 0.05, 400)
    y = (d > 0.01).astype(float)
    x = quality._columns(d)
    w = quality._logistic(x, y, np.ones(400))
    assert np.isfinite(w).all() and np.abs(w).max() < 1e5
    assert ((x @ w > 0) == (y == 1)).mean() > 0.95


def test_scores_are_those_of_the_compressed_sizes(spark):
    """Scores computed directly: two dictionaries, sizes, one intercept and slope."""
    rows, labels = labelled(6, 150)
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    label, text = dict(labels), dict(rows)
    for y, made in ((1, model.good), (0, model.bad)):
        assert all(any(t.encode() in made for i, t in rows if label[i] == y) for y in (y,)) and not any(t.encode() in made for i, t in rows if label[i] != y and t)
    odd = [(900, None), (901, ""), (902, text[0] * 50), (0, text[0])]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame([*rows[1:], *odd], "doc_id long, text string"), model).collect()}
    size = lambda t, d: len(zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(t))
    for i, t in [*rows[1:], *odd]:
        t = (t or "").encode()
        d = (size(t, model.bad) - size(t, model.good)) / (len(t) + 64)
        assert abs(got[i] - 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * d)))) < 1e-9
    assert len(model.weights) == 2


def test_keep_good_keeps_rows_as_they_were(spark):
    rows, labels = labelled(7, 150)
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    df = spark.createDataFrame([(i, t, "s", 3, {"a": 1}) for i, t in [*rows, *rows[:3], (None, None)]], "doc_id long, text string, score string, good int, predicted map<string,int>")
    out, want = quality.keep_good(df, model), [r.doc_id for r in quality.score(df.select("doc_id", "text"), model).filter("predicted = 1").collect()]
    assert out.columns == df.columns and out.schema == df.schema
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in out.collect()) and {(r.score, r.good) for r in out.collect()} == {("s", 3)}
