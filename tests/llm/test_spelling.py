"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from quernstone.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, shortest=6, least=5, damage=None) -> dict[str, int]:
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def expected(words: dict[str, int], times=5) -> set[tuple]:
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= times * words[a] else None
    out = set()
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out.add((a, form[a], root, words[a], len(near[a]), words[form[a]] if form[a] else None))
    return out


def rows_of(df) -> list[tuple]:
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    words, letters = {}, "abcdeéß"
    for _ in range(120):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9)))
        for _ in range(4):
            words[w] = rng.choice([5, 6, 25, 30, 150, 160, 900])
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "Öaaaaaa": 25, "abbbbb" * 300: 5, "abbbbb" * 300 + "b": 40}
    got = rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert len(got) == len(words) and set(got) == expected(words)
    assert next(r for r in got if r[0] == "aaaaaa")[1:3] == ("aaaaaaa", "aaaaaaaaa")  # the longest chain; ties by code point


def test_words_are_counted_in_whole_texts(spark):
    rng = random.Random(5)
    some = ["Garden", "garden", "Über", "übermut", "ÜBERMUT", "naïveté", "straße", "x×y÷zab", "a", "Gardens"]
    rows = [(i, " ".join(rng.choice(some) for _ in range(60))) for i in range(40)]
    rows += [(None, "garden; garden garden-garden garden\tgarden"), (7, None), (8, ""), (3, "straße " * 9), (3, "straße " * 9), (9, "garden_garden1garden " * 9)]
    rows.append((41, "wonder " * 90_000 + "y" * 400_000))
    df = spark.createDataFrame([(i, t, "word", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for damage in (None, 3):
        got = {r.word: r.n for r in spelling.count_words(df, damage=damage).collect()}
        assert got == counted(rows, damage=damage)


def test_texts_are_cut_between_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 5)
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    rows = [(1, "letter litter, letter. " * 5), (2, "latter letter " * 5)]
    got = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {"letter": 15, "litter": 5, "latter": 5}


def test_nothing_in_nothing_out(spark):
    words = spelling.count_words(spark.createDataFrame([], "doc_id long, text string"))
    assert words.count() == 0 and spelling.variants(words).count() == 0
    alone = spark.createDataFrame([("lonely", 9)], "word string, n long")
    assert rows_of(spelling.variants(alone)) == [("lonely", None, "lonely", 9, 0, None)]
    with pytest.raises(ValueError):
        spelling.variants(words, times=1)


def test_signatures_meet_within_the_distance():
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 12)))
        i = rng.randrange(len(w))
        other, longer = w[:i] + "z" + w[i + 1 :], w[:i] + "z" + w[i:]
        assert set(spelling.signatures(w, 6, 2, len(w))) & set(spelling.signatures(other, 6, 2, len(w)))
        assert set(spelling.signatures(w, 4, 1, len(w))) & set(spelling.signatures(longer, 4, 1, len(w)))
