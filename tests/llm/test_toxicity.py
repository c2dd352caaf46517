"""Toxicity: held-out accuracy, unseen spellings, whole texts, edge cases."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from quernstone.llm import toxicity

DATA = Path("/root/testdata/sf0.1")


def sentences(seed, n, stems=("vermin", "rotten")):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tu", "re", "sa", "no", "pe", "di", "go"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["", "s", "ed", "ish", "y"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = sentences(1, 400)
    y = np.array([r[2] for r in rows])
    return toxicity.train([r[1] for r in rows], y, np.ones(len(y)) / len(y))


def test_unseen_spellings_share_ngrams(model):
    words = toxicity._Logits(model)
    right = [(toxicity.logit(t, words) > 0) == bool(y) for _, t, y in sentences(2, 200, ("verminlike", "rottenest", "xvermin"))]
    assert np.mean(right) > 0.95


def test_texts_are_read_whole_and_in_pieces(model, monkeypatch):
    text = "kalo mire " * 300 + "Vermin ROTTEN " * 40 + "x" * 5000
    whole = toxicity.logit(text, toxicity._Logits(model))
    assert toxicity.logit(text + " vermins" * 99, toxicity._Logits(model)) > whole
    monkeypatch.setattr(toxicity, "PIECE", 16)
    monkeypatch.setattr(toxicity, "HELD_WORDS", 2)
    assert toxicity.logit(text, toxicity._Logits(model)) == pytest.approx(whole, abs=1e-9)


def test_fit_and_score_edge_cases(spark):
    rows = sentences(3, 120)
    docs = [(i, t, 0.5, "x") for i, t, _ in rows] + [(500, None, 0.5, "x"), (501, "", 0.5, "x"), (None, rows[0][1], 0.5, "x"), (0, rows[0][1], 0.5, "x"), (502, "vermin " * 200_000, 0.5, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, o string")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(0, 0, "x"), (1, None, "x"), (None, 1, "x"), (502, 1, "x"), (500, 0, "x"), (777, 1, "x")], "doc_id long, toxic int, t string")
    model = toxicity.fit(df, labels)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) and set(got[0].asDict()) == {"doc_id", "text", "o", "score", "predicted"}
    by = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        by.setdefault((r.doc_id, r.text), set()).add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[500, None] == by[501, ""]
    y = {i: y for i, _, y in rows}
    assert np.mean([r.predicted == y[r.doc_id] for r in got if r.doc_id in y]) > 0.95
    none = toxicity.fit(df, labels.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.5}
    ones = toxicity.fit(df, labels.filter("toxic = 1"))
    assert min(r.score for r in toxicity.score(df, ones).collect()) > 0.9
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.fit(df.limit(0), labels).intercept == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_held_out_texts(spark):
    from quernstone.llm.queries import op11_toxicity

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = op11_toxicity(spark, str(DATA)).collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    seen = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    caught = np.mean([p for y, p in seen if y == 1])
    clean = np.mean([1 - p for y, p in seen if y == 0])
    assert caught > 0.88 and clean > 0.95, (caught, clean)
