"""Exact and near duplicates against brute force."""

import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quernstone.llm import components, exact_dedup, grams, minhash

SCHEMA = "doc_id long, text string, keep_id string, lang string"


def brute_groups(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = (max if keep == "largest" else min)(ids) if ids else None
        out.append((i, best, len(groups[t or ""]), i == best))
    return sorted(out, key=str)


def exact(spark, rows, keep, **options):
    df = spark.createDataFrame([(i, t, "x", "en") for i, t in rows], SCHEMA)
    out = exact_dedup.exact_groups(df, keep=keep, **options)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()), key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "a "), (8, "x" * 50_000), (9, "x" * 50_000), (10, "x" * 49_999 + "y"), (3, "a"), (None, "b"), (None, "c")]


def test_exact_groups(spark):
    for keep in ("largest", "smallest"):
        assert exact(spark, ROWS, keep) == brute_groups(ROWS, keep)


def test_colliding_hashes_are_told_apart(spark):
    weak = lambda sha: F.unhex(F.substring(sha, 1, 1).cast("string")).substr(1, 1)
    assert exact(spark, ROWS, "largest", hash_of=weak) == brute_groups(ROWS, "largest")
    assert exact(spark, ROWS, "smallest", hash_of=lambda sha: F.lit(b"same")) == brute_groups(ROWS, "smallest")


def test_exact_on_empty_table(spark):
    assert exact(spark, [], "largest") == []


def test_drop_exact_copies_keeps_all_columns(spark):
    df = spark.createDataFrame([(3, "a", "k3", "en"), (1, "a", "k1", None), (1, "a", "k0", "fr"), (2, None, "k2", "de"), (5, "", "k5", "en"), (None, "z", "k", "en")], SCHEMA)
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", "k0", "fr"), (2, None, "k2", "de"), (None, "z", "k", "en")], key=str)


def shingle_set(text, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, n, words=120, edits=(1, 2, 3, 5, 8)):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(n):
        base = [rng.choice(lexicon) for _ in range(words)]
        for e in (0, *rng.choices(edits, k=rng.randrange(0, 14))):
            text = list(base)
            for _ in range(e):
                text[rng.randrange(len(text))] = rng.choice(lexicon)
            rows.append((i, " ".join(text)))
            i += 1
    rng.shuffle(rows)
    return rows


def near(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", "en") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **options).collect()}


def test_near_duplicates_equal_brute_force(spark):
    rows = families(5, 40) + [(100_001, None), (100_002, ""), (100_003, " \t\n"), (100_004, "Two Words"), (100_005, "two  words"), (100_006, "one"), (100_007, "q " * 4000), (100_008, "q " * 3000)]
    for k, percent in ((3, 85), (5, 80)):
        want = brute_components(rows, k, percent)
        got = near(spark, rows, k=k, percent=percent)
        assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_large_bucket_in_blocks(spark):
    """A family whose members mostly link with their neighbours only: blocks must find every link between components."""
    rng = random.Random(2)
    text = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(160):
        rows.append((i, " ".join(text)))
        for _ in range(2):
            text[rng.randrange(len(text))] = f"n{i}{rng.random()}"
    want = brute_components(rows, 3, 85)
    got = near(spark, rows, k=3, percent=85, block=8)
    assert {i: c for i, (_, c, _) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_of_empty_table_and_repeated_rows(spark):
    assert near(spark, []) == {}
    got = near(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])
    assert {i: c for i, (_, c, _) in got.items()} == {1: 1, 2: 1}


def test_drop_near_duplicates_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "k", "en"), (1, "a b c d e f", "k", "en"), (3, None, None, None)], SCHEMA)
    out = minhash.drop_near_duplicates(df)
    assert sorted(out.columns) == sorted(df.columns)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5, 5), (None, 3), (7, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_and_shingles_are_the_patterns():
    texts = ["Straße 12, ÉA_b c", "", None, "  x-y\t1é\x0b", "tail"]
    for kind, pattern in (("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ("space", r"[^\x20\x09-\x0D]+")):
        w = grams.words([t.encode() if t is not None else None for t in texts], kind)
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for i, t in enumerate(texts):
            got = [b.decode() for b in w.text(int(w.first[i]), int(w.first[i + 1] - w.first[i]))]
            assert got == re.findall(pattern, (t or "").translate(low))


def test_drop_exact_copies_with_any_other_columns(spark):
    names = ["id", "no_id", "null_text", "__row", "__h", "h", "spot", "row", "a.b", "text_sha256", "c0"]
    kinds = ", ".join(f"`{c}` string" for c in names)
    other = lambda x: tuple(f"{x}{j}" for j in range(len(names)))
    rows = [(2, "a", *other("k"), {"y": 1}, [b"1"]), (1, "a", *other("q"), {"x": 1}, None), (1, "a", *other("q"), None, [b"2"]), (3, None, *other("k"), None, None), (3, "", *other("z"), None, None), (4, "b", *other("z"), {"x": 2, "w": 3}, [])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {kinds}, tags map<string,int>, raw array<binary>")
    for deal in (1, 5):
        out = exact_dedup.drop_exact_copies(df.repartition(deal))
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == 3 and {r["h"] for r in got.values()} == {"q5", "z5"}
        assert got[3].text == "" and got[4].tags == {"x": 2, "w": 3} and got[1].tags == {"x": 1}
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0
