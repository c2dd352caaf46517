"""Revisit resolution against a direct search."""

import random

from pyspark.sql import functions as F

from quernstone.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, canonical string"
URLS = ["http://www.A.com/x/", "https://a.com:443/x#top", "a.com/x?utm_source=q", "http://b.org/p?page=2&ref=z", "b.org/p?page=2", "http://c.net", None, ""]


def captures():
    rng = random.Random(1)
    out = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit"])
        tag = rng.choice([None, '"1"', 'W/"1"', '"2"', ""])
        head = rng.choice([None, {}, {"date": str(i), "content-length": "0"}, {"ETag": "e", "x": "y", "Content-Type": "t"}, {"etag": "f", "Content-Length": "0", "Date": str(i), "X ": None}])
        out.append((i, rng.choice(URLS), rng.choice([None, *range(60)]), kind, tag, rng.choice([None, "d1", "d2"]), f"sha{i}" if kind == "response" else None, head, "clash"))
    out += [(9999, URLS[0], 30, "revisit", '"1"', None, None, {"a": "b"}, "clash"), (10000, URLS[0], 20, "odd", None, None, None, None, "clash"), (500, URLS[5], -10**12, "response", '"1"', None, "far", {"k": "v"}, "clash")]
    return out


def canonical(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", warc.canonical_url(F.col("u")).alias("c"))
    return {urls[r.i]: r.c for r in df.collect()}


def brute(rows, canon):
    strip = lambda t: (t.strip().removeprefix("W/") or None) if t else None
    out = []
    for i, u, ts, kind, tag, mod, _, head, _ in rows:
        if kind != "revisit":
            continue
        past = [r for r in rows if r[3] == "response" and canon[r[1]] is not None and canon[r[1]] == canon[u] and r[2] is not None and ts is not None and r[2] < ts]
        best = max(past, key=lambda r: (r[2], r[0]), default=None)
        if best is None:
            status = "no_response"
        elif strip(tag) and strip(best[4]):
            status = "resolved" if strip(tag) == strip(best[4]) else "validator_mismatch"
        elif mod and best[5]:
            status = "resolved" if mod == best[5] else "validator_mismatch"
        else:
            status = "no_validator"
        merged = None
        if status == "resolved":
            stored, own = ({k.lower().strip(): v for k, v in (h or {}).items() if v is not None} for h in (best[7], head))
            merged = {**stored, **{k: v for k, v in own.items() if k not in warc.NEVER_MERGED}}
        out.append((i, best and best[0], status, best[6] if status == "resolved" else None, merged and sorted(merged.items()) if merged is not None else None))
    return sorted(out, key=str)


def test_resolution_equals_direct_search(spark):
    rows = captures()
    canon = canonical(spark, URLS)
    assert canon[URLS[0]] == canon[URLS[1]] == canon[URLS[2]] == "a.com/x" and canon[URLS[3]] == canon[URLS[4]] == "b.org/p?page=2"
    want = brute(rows, canon)
    for hot, slices in ((10**9, 4), (20, 7), (0, 64), (50, 2)):
        out = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), hot, slices).collect()
        got = [(r.record_id, r.response_id, r.status, r.digest, (sorted(r.headers.items()) if r.headers else r.headers and []) if r.headers is not None else None) for r in out]
        got = [(a, b, c, d, [] if e == {} else e) for a, b, c, d, e in got]
        assert sorted(got, key=str) == sorted([(a, b, c, d, [] if e == {} else e) for a, b, c, d, e in want], key=str)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.resolve_revisits(empty).count() == 0
    row = (1, "http://a.com/", 5, "revisit", None, None, None, None, "c")
    assert warc.resolve_revisits(spark.createDataFrame([row, row], SCHEMA)).count() == 2


def test_fields_of_any_case_are_one(spark):
    df = spark.createDataFrame([({"ETag": "1", "etag ": "2", "Content-Length": "9", "x": None},), (None,), ({},)], "h map<string,string>")
    got = [[tuple(x) for x in r.f] for r in df.select(warc.fields(F.col("h")).alias("f")).collect()]
    assert got == [[("content-length", "9"), ("etag", "1, 2")], [], []]


def test_merge_keeps_what_a_revisit_must_not_change(spark):
    stored, own = ({"ETag": "a", "Content-Type": "text/html", "content-LENGTH": "9"}, {"etag": "b", "Content-Length": "0", "CONTENT-TYPE": "x"})
    rows = [(1, "http://a.com/", 1, "response", '"t"', None, "sha", stored, "c"), (2, "http://a.com/", 5, "revisit", '"t"', None, None, own, "c")]
    (r,) = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert r.headers == {"etag": "b", "content-type": "text/html", "content-length": "9"}


def test_repeated_records_keep_their_own_headers(spark):
    say = lambda i, ts, kind, digest, head: (i, "http://a.com/", ts, kind, '"t"', None, digest, head, "c")
    rows = [say(1, 1, "response", "s1", {"x": "1"}), say(1, 1, "response", "s2", {"x": "0"}), say(1, 1, "response", "s2", {"x": "2"})]
    rows += [say(7, 5, "revisit", None, {"y": "first"}), say(7, 5, "revisit", None, {"y": "second"}), say(7, 5, "revisit", None, {"y": "second"})]
    for deal in (1, 4):
        out = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(deal)).collect()
        assert sorted(sorted(r.headers.items()) for r in out) == [[("x", "2"), ("y", "first")], [("x", "2"), ("y", "second")], [("x", "2"), ("y", "second")]]
        assert {r.digest for r in out} == {"s2"}


def test_a_third_of_the_captures_in_one_day(spark):
    """One URL with a third of all captures, in one day of ten years: its windows are cut where its captures are."""
    rng = random.Random(5)
    day = lambda i, ts: (i, "http://hot.org/", ts, rng.choice(["response", "revisit", "revisit"]), rng.choice(['"1"', '"2"']), None, f"d{i}", {"n": str(i)}, "c")
    rows = [day(i, 10**9 + rng.randrange(86_400)) for i in range(300)] + [(1000 + i, f"http://u{i % 40}.org", rng.randrange(3 * 10**8), rng.choice(["response", "revisit"]), '"1"', None, f"d{i}", {}, "c") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    cuts = warc._cuts(df.select(warc.canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("double").alias("at")), 100, 8).collect()
    assert [r.canonical for r in cuts] == ["hot.org"] and len(cuts[0].cuts) == 7
    times = sorted(r[2] for r in rows if r[1] == "http://hot.org/")
    sizes = [sum(a < t <= b for t in times) for a, b in zip([-1, *cuts[0].cuts], [*cuts[0].cuts, 1e12], strict=True)]
    assert max(sizes) < 60
    canon = canonical(spark, sorted({r[1] for r in rows}))
    got = [(r.record_id, r.response_id, r.status) for r in warc.resolve_revisits(df, 100, 8).collect()]
    assert sorted(got, key=str) == sorted([x[:3] for x in brute(rows, canon)], key=str)
