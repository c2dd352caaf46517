"""Hard negatives against brute force over all rows."""

import math
import random

import numpy as np
import pytest

from quernstone.llm import negatives


def brute(rows, every, positives=5, picked=3, low=50, high=95):
    known = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        known[i] = min(known[i], r) if i in known else r
    out = set()
    for a, (label, v) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in known.items() if i != a)
        same = [(-s, i) for s, i, other in scored if other == label][:positives]
        for p, pid in same:
            some = [(-s, i) for s, i, other in scored if other != label and low * p <= -100 * s <= high * p][:picked]
            out |= {(a, pid, k, i, p, s) for k, (s, i) in enumerate(some, 1)}
    return out


def mined(df, **how):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = [tuple(r[n] for n in names) for r in negatives.mine(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(n, dims, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.3, (n, dims))
    return [(i, [float(np.float32(v)) for v in row], int(rng.integers(0, 4))) for i, row in enumerate(x)]


SCHEMA = "vec_id long, embedding array<float>, label int, id string, shard string"


def test_mined_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    rows = vectors(260, 5, 1) + [(1000 + i, [1.0, 0.5, 0.25, 0.0, -1.0], i % 3) for i in range(120)]  # one vector many times: ties, and a cell in several shards
    rows += [(5, [9.0] * 5, 0), (2000, None, 1), (2001, [1.0, None, 0.0, 0.0, 0.0], 1), (2002, [math.nan] * 5, 1), (2003, [math.inf] * 5, 1), (2004, [1.0] * 5, None), (None, [1.0] * 5, 1)]
    rows += [(2010, [2.0, 1.0], 1), (2020, [], 2), (2030, [0.0] * 5, 2), (2040, [-1.0] * 5, 3), (-20, [1.0] * 5, 3), (-20, [1.0] * 5, 3)]
    df = spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA)
    assert mined(df, every=10) == brute(rows, 10)
    assert mined(df, every=10, positives=2, negatives=1, low=0, high=70) == brute(rows, 10, 2, 1, 0, 70)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)], [(1, [1.0], 1), (2, [1.0], 2)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA)
    assert mined(df) == brute(rows, 50)


def test_large_components_are_held(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [0.8, 0.1], 2)], "vec_id long, embedding array<double>, label int")
    got = mined(df)
    assert all(abs(r[4]) < 1 << 63 for r in got)


def test_search_stops_at_certified_windows():
    import pyarrow as pa

    rng = random.Random(2)
    x, c1, c2 = [], [], []
    for a in range(8):
        for b in range(8):
            for _ in range(5):
                x.append([100 * a + rng.randint(0, 3), 100 * b + rng.randint(0, 3)])
                c1.append(a)
                c2.append(b)
    n = len(x)
    shard = negatives._Shard(pa.table({"id": list(range(n)), "label": [i % 2 for i in range(n)], "v": x, "c1": c1, "c2": c2}), 2)
    centres = tuple(np.array([[100.0 * k + 1.5] for k in range(8)]) for _ in range(2))
    index = negatives.Index(2, centres, (np.full(8, 2.0), np.full(8, 2.0)), {})
    q = np.array([[3.0, 2.0]])
    bounds = [b[0] for b in index.half_bounds(q)]
    found, visited = shard.best(q[0], -1, 0, bounds, [(0, 900), (-(1 << 63), (1 << 63) - 1)], 3, True)
    for (lo, hi), got in zip([(0, 900), (-(1 << 63), (1 << 63) - 1)], found, strict=True):
        want = sorted((-(3 * v[0] + 2 * v[1]), i) for i, v in enumerate(x) if i % 2 == 0 and lo <= 3 * v[0] + 2 * v[1] <= hi)[:3]
        assert got == want
    _, few = shard.best(q[0], -1, 0, bounds, [(-(1 << 63), (1 << 63) - 1)], 3, True)
    assert few < 6 and visited < 64
    order = [b for b, *_ in shard.visits(*bounds)]
    assert len(order) == 64 and order == sorted(order, reverse=True)
