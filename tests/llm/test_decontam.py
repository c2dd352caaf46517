"""Winnowed decontamination against brute force."""

import hashlib
import random
import re

import numpy as np

from quernstone.llm import decontam

DOCS = "doc_id long, text string, contaminated string, i string, n string, fp string, hash string, items string, words string, c0 string, set string"
CLASH = ("clash",) * 9


def words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def brute(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        for a in range(max(1, len(w) - span + 1)):
            windows.setdefault(tuple(w[a : a + span]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def case(seed=4):
    rng = random.Random(seed)
    lexicon = ["the", "of", "é", "x1", "漢字", "Foo", "bar", "baz", "qux", "a"]
    say = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 7, 10, 11, 25, 60]))) for i in range(12)] + [(100, ""), (101, None), (None, say(12)), (7, say(15))]
    items.append((50, items[3][1]))
    items = [(i, t if t is None or len(words(t)) > 2 else t + " " + say(9)) for i, t in items] + [(200, "only four words here"), (201, "... --")]
    docs = []
    for d in range(60):
        parts = [say(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            w = words(rng.choice([t for _, t in items if t]))
            a = rng.randrange(0, max(1, len(w) - 5))
            parts += [" - ".join(w[a : a + rng.choice([9, 10, 12, 40])]).upper(), say(rng.randrange(0, 9))]
        docs.append((d, " ".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, "ONLY, four words; here"), (1003, " ".join([items[3][1]] * 900)), (1004, "only four words")]
    return docs, items


def run(spark, docs, items, **options):
    df = spark.createDataFrame([(d, t, *CLASH) for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(df, bench, **options)
    assert out.columns == [*[c for c in df.columns if c != "contaminated"], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()}


def test_broadcast_and_join_equal_brute_force(spark):
    docs, items = case()
    want = brute(docs, items)
    assert any(v[4] for v in want.values()) and any(not v[4] for v in want.values())
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, broadcast_windows=5) == want


def test_repeated_and_null_ids(spark):
    docs, items = case()
    texts = [t for _, t in docs[:40]] + [None, "", "only four", "ONLY, four words; here", "only four words here"]
    same = [(i % 3 or None, t) for i, t in enumerate(texts)] * 2  # ids: null, 1, 2
    one = brute(enumerate(texts), items)
    want = sorted(((d, t, *one[i]) for i, (d, t) in enumerate(same[: len(texts)])), key=repr) * 2
    df, bench = spark.createDataFrame(same, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontam.BROADCAST_WINDOWS, 5):
        got = decontam.decontaminate(df, bench, broadcast_windows=most).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        kept = decontam.drop_contaminated(df, bench, broadcast_windows=most).collect()
        assert sorted(map(tuple, kept), key=repr) == sorted((w[:2] for w in want if not w[-1]), key=repr)
    bare = decontam.decontaminate(df, bench, keep=["doc_id"], broadcast_windows=5)
    assert sorted(map(tuple, bare.collect()), key=repr) == sorted(((w[0], *w[2:]) for w in want), key=repr)


def test_empty_benchmark_and_empty_table(spark):
    docs, items = case()
    assert not any(v[4] for v in run(spark, docs, []).values())
    assert run(spark, [], items) == {}


def test_drop_contaminated_keeps_columns(spark):
    docs, items = case()
    df = spark.createDataFrame([(d, t, *CLASH) for d, t in docs], DOCS)
    for most in (decontam.BROADCAST_WINDOWS, 5):
        out = decontam.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=most)
        assert out.columns == df.columns
        rows = out.collect()
        assert {r.contaminated for r in rows} == {"clash"} and {r.items for r in rows} == {"clash"}
        assert {r.doc_id for r in rows} == {d for d, v in brute(docs, items).items() if not v[4]}


def test_a_phrase_in_every_item(spark):
    """One window shared by all items and by most documents: items are listed for each set of windows, not each document."""
    phrase = "ten words that all of these items have in common"
    items = [(i, f"{phrase} own{i} tail{i}") for i in range(300)]
    docs = [(d, f"start{d} {phrase} end{d}" if d % 3 else f"nothing {d} here") for d in range(90)]
    want = brute(docs, items)
    assert want[1][2] == 300
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, broadcast_windows=5) == want


def test_winnow_selects_from_every_window():
    h = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    for w in (1, 2, 6):
        want = {i + max(range(w), key=lambda j: (-int(h[i + j]), j)) for i in range(len(h) - w + 1)}
        assert set(decontam.winnow(h, w).tolist()) == want
    assert len(decontam.winnow(h[:3], 6)) == 0


def hot_conf(spark):
    """Settings under which adaptive execution splits small skewed partitions, as it splits large ones by default."""
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "2k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "shuffle.partitions": "16"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    return small, before


def test_a_passage_of_a_third_of_all_documents(spark, monkeypatch):
    docs, items = case(8)
    item = next(t for _, t in items if t and len(words(t)) > 20)
    docs += [(5000 + i, f"n{i} {item}") for i in range(60)]
    plans, cut = [], decontam.cut

    def watched(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(decontam, "cut", watched)
    small, before = hot_conf(spark)
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        assert run(spark, docs, items, broadcast_windows=5) == brute(docs, items)
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert joins and not any("HashAggregate" in p for p in joins)  # both sides are plain shuffles, which can be split
