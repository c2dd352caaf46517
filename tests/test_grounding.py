"""Evidence in lines, packing under several limits, and order-dependent folds, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import dictionary, duplicates, grounding, leaders, packing, trends


def bare(t):
    return re.sub(r"[（）()，,。.:：;；、|\s_\-]+", "", (t or "").lower())


def some_lines(rng, n=60):
    words = ["wbc", "6.1", "liver", "cyst", "12", "mm", "肝", "囊肿", "a", "left", "left lobe", "1.2", "0.6"]
    return [(k, f"r{k % 3}", k % 6 // 3, k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for k in range(n)]


LINES = "line_id long, report_id string, page_number int, line_no long, text string"


def once(found, lines, most):
    """Best lines of each fact, equal lines of a page once."""
    text, out = {x[0]: (x[1], x[2], x[4]) for x in lines}, set()
    for fact in {f for f, *_ in found}:
        mine, seen = sorted((-s, x, s) for f, x, s in found if f == fact)[:most], set()
        mine.sort(key=lambda x: (x[0], text[x[1]][1], x[1]))
        for _, x, s in mine:
            if text[x] not in seen:
                seen.add(text[x])
                out.add((fact, x, s))
    return out


def test_lines_of_results_findings_and_facts(spark):
    rng = random.Random(4)
    lines = some_lines(rng)
    meets = lambda a, b: bool(a) and bool(b) and (a in b or b in a)
    facts = []
    for k in range(40):
        pick = lambda: rng.choice([x[4] for x in lines] + ["", None, "liver", "cyst 12", "6.1", "囊肿"])
        facts.append((k, f"r{k % 3}", rng.randrange(2), pick(), pick(), pick(), pick(), pick(), pick()))
    df = spark.createDataFrame(facts, "fact_id long, report_id string, page_number int, quote string, name string, value string, type string, organ string, raw_text string")
    lf = spark.createDataFrame(lines, LINES)
    results, findings, clinical = [], [], []
    for f, report, page, *texts in facts:
        quote, name, value, kind, organ, raw = map(bare, texts)
        for x, r, p, _, text in lines:
            t = bare(text)
            if (r, p) != (report, page) or not t:
                continue
            if len(quote) >= 4 and meets(quote, t):
                results.append((f, x, 2))
            elif len(name) >= 2 and value and name in t and value in t:
                results.append((f, x, 1))
            total = sum(min(1, len(a) / 8) for a in (raw, name, kind, organ, quote) if len(a) >= 2 and meets(a, t))
            if len(quote) >= 4 and meets(quote, t):
                findings.append((f, x, 4.0))
            elif total >= 1.25:
                findings.append((f, x, total))
            ratio = max([min(len(a), len(t)) / max(len(a), len(t)) for a in (raw, name, quote) if len(a) >= 2 and meets(a, t)], default=0)
            if ratio >= 0.35:
                clinical.append((f, x, ratio))
    get = lambda d: {(r.fact_id, r.line_id, r.score) for r in d.collect()}
    assert get(grounding.lines_of_results(df, lf)) == once(results, lines, None)
    assert get(grounding.lines_of_findings(df, lf)) == once(findings, lines, 5)
    assert get(grounding.lines_of_facts(df, ["name", "raw_text"], lf)) == once(clinical, lines, 5)
    assert grounding.lines_of_results(df.limit(0), lf).count() == 0 and grounding.lines_of_findings(df, lf.limit(0)).count() == 0


@pytest.mark.parametrize("large", [3, 2000])
def test_lines_meet_facts_without_copies_of_their_grams(spark, monkeypatch, large):
    """Pages of more lines than are compared one by one lose nothing; the others send each line once."""
    monkeypatch.setattr(grounding, "LARGE", large)
    rng = random.Random(7)
    lines = some_lines(rng, 40) + [(100, "big", 0, 0, "left lobe of the liver 12 mm")]
    lf = spark.createDataFrame(lines, LINES)
    facts = [(k, *rng.choice(lines)[1:3], rng.choice(lines)[4], rng.choice(["liver", "cyst", "a", None]), rng.choice(["12", "6.1", ""])) for k in range(30)]
    df = spark.createDataFrame(facts, "fact_id long, report_id string, page_number int, quote string, name string, value string")
    found = []
    for f, report, page, *texts in facts:
        quote, name, value = map(bare, texts)
        for x, r, p, _, text in lines:
            t = bare(text)
            if (r, p) == (report, page) and t:
                if len(quote) >= 4 and (quote in t or t in quote):
                    found.append((f, x, 2))
                elif len(name) >= 2 and value and name in t and value in t:
                    found.append((f, x, 1))
    got = grounding.lines_of_results(df, lf)
    assert {tuple(r) for r in got.collect()} == once(found, lines, None) and found
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert large == 3 or "Generate" not in plan and "ArrowEvalPython" not in plan and "BroadcastHashJoin" not in plan


def test_numbers_explain_a_line_as_whole_tokens_only(spark):
    lines = spark.createDataFrame([(1, "r", 0, 0, "wbc count is 6.1"), (2, "r", 0, 1, "wbc count is 16.1"), (3, "r", 0, 2, "left lobe 12 mm"), (4, "r", 0, 3, "lobe 112 mm"), (5, "q", 0, 0, "wbc count is 6.1")], LINES)
    results = spark.createDataFrame([("f", "r", None, "wbc", None, "6.1")], "fact_id string, report_id string, quote string, name string, value string, number string")
    findings = spark.createDataFrame([("g", "r", None, None, "lobe", None, None, None, ["12"])], "fact_id string, report_id string, raw_text string, quote string, name string, type string, organ string, region string, sizes array<string>")
    got = {tuple(r) for r in grounding.explained_lines(lines, results, findings).collect()}
    assert got == {(1, False, True, False), (3, False, False, True)}


def test_lines_are_never_sent_to_every_task(spark, tmp_path):
    """Lines in a small file are many once they are read: the names are sent."""
    spark.createDataFrame([(1, "wbc | 6.1"), (2, "提示白细胞升高")], "line_id long, text string").write.parquet(str(tmp_path / "lines"))
    names = spark.createDataFrame([("cbc_wbc", "WBC"), ("cbc_wbc", "白细胞")], "canonical_key string, alias string")
    found = dictionary.facts_for_lines(spark.read.parquet(str(tmp_path / "lines")), names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert {tuple(r) for r in found.collect()} == {(1, "cbc_wbc", "WBC"), (2, "cbc_wbc", "白细胞")}


def test_series_are_shown_in_pinyin_order(spark):
    """Names that a query's SQL doesn't list have their place too."""
    names = ["总胆固醇", "心率", "息肉大小", "随机血糖", "尿白细胞", "脉搏", "空腹血糖", "白细胞计数"]
    df = spark.createDataFrame([(n, "k", 2, "2024-01-30") for n in names], "name string, series_key string, point_count int, last_date string")
    assert [r["name"] for r in trends.in_shown_order(df).collect()] == ["白细胞计数", "空腹血糖", "脉搏", "尿白细胞", "随机血糖", "息肉大小", "心率", "总胆固醇"]


def next_fit(sizes, limits, joint=2):
    units, at = [], 0
    for k, s in enumerate(sizes):
        if k:
            some = sizes[at : k + 1]
            n, ch, c, m = len(some), sum(x[0] for x in some) + joint * (k - at), sum(x[1] for x in some), sum(x[2] for x in some)
            tokens = 768 + 96 * n + 100 * c + 180 * m + min(768, -(-ch // 8))
            if n > limits.pages or ch > limits.characters or tokens > limits.tokens or limits.rows is not None and c > limits.rows:
                units.append((at, k))
                at = k
    return [*units, (at, len(sizes))] if sizes else []


@pytest.mark.parametrize("limits", [packing.SCALAR, packing.NARRATIVE, packing.Limits(pages=3, characters=500, tokens=2500, rows=5)])
def test_pages_are_packed_as_one_by_one(spark, monkeypatch, limits):
    monkeypatch.setattr(packing, "BLOCK", 25)
    rng = random.Random(9)
    docs = {f"d{k}": [(rng.choice([0, 30, 400, 3000, 9000]), rng.choice([0, 1, 3, 70]), rng.choice([0, 0, 2])) for _ in range(n)] for k, n in enumerate([1, 2, 24, 25, 26, 27, 49, 50, 51, 300])}
    docs["long"] = [(10, 0, 0)] * 203
    rows = [(d, i, *s) for d, sizes in docs.items() for i, s in enumerate(sizes)] + [("null", 0, None, None, None), (None, 0, 1, 1, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "d string, place int, characters int, candidate_rows int, morphology_rows int")
    got = {(r.d, r.unit, r.first, r.n_pages, r.characters, r.candidate_rows, r.morphology_rows) for r in packing.pack_pages(df, "d", limits).collect()}
    docs["null"] = [(0, 0, 0)]
    want = {(d, u, a, b - a, *(sum(x[j] for x in sizes[a:b]) for j in range(3))) for d, sizes in docs.items() for u, (a, b) in enumerate(next_fit(sizes, limits), 1)}
    assert got == want
    assert packing.pack_pages(df.limit(0), "d", limits).count() == 0


def test_gaps_in_places_are_an_error(spark):
    df = spark.createDataFrame([("d", 0, 1, 1, 1), ("d", 2, 1, 1, 1)], "d string, place int, characters int, candidate_rows int, morphology_rows int")
    with pytest.raises(Exception, match="gaps"):
        packing.pack_pages(df, "d").collect()


def naive_findings(rows, tolerance=0.5):
    says = lambda r: sum(len(v) if isinstance(v, list) else 1 for v in r.values() if v not in (None, ""))
    kept = []
    for row in rows:
        for i, k in enumerate(kept):
            if k["region"] and row["region"] and k["region"] != row["region"]:
                continue
            x, y = k["sizes"] or [], row["sizes"] or []
            if x and y and (len(x) != len(y) or any(abs(a - b) > tolerance for a, b in zip(x, y, strict=True))):
                continue
            first, second = (row, k) if says(row) > says(k) else (k, row)
            both = {c: second[c] if v in (None, []) else v for c, v in first.items()}
            both["raw"] = max((t for t in (first["raw"], second["raw"]) if t), key=len, default=None)
            kept[i] = {**both, "pos": k["pos"]}
            break
        else:
            kept.append(dict(row))
    return kept


def test_findings_fold_within_tolerance(spark):
    rng = random.Random(6)
    rows = [{"g": f"g{i % 4}", "pos": i, "region": rng.choice([None, "s1", "s2"]), "sizes": rng.choice([None, [], [round(rng.uniform(1, 5), 1)], sorted((round(rng.uniform(1, 3), 1) for _ in range(2)), reverse=True)]), "raw": rng.choice([None, "a", "abc"])} for i in range(240)]
    rows += [{"g": "drift", "pos": 1000 + i, "region": "s", "sizes": [1.0 + i / 2], "raw": "x" * (i % 2)} for i in range(6)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "g string, pos int, region string, sizes array<double>, raw string")
    got = {(r.g, r.pos, r.region, tuple(r.sizes or ()), r.raw) for r in leaders.fold_findings(df, ["g"], ["pos"], longest=("raw",)).collect()}
    want = {(r["g"], r["pos"], r["region"], tuple(r["sizes"] or ()), r["raw"]) for g in {r["g"] for r in rows} for r in naive_findings([r for r in rows if r["g"] == g])}
    assert got == want


def test_rows_fold_by_the_first_key_that_is_known(spark):
    rows = [("g", 1, ["a"], None), ("g", 2, ["b"], "u"), ("g", 3, ["x", "b", "a"], "v"), ("g", 4, ["a"], "w"), ("g", 5, [], "n"), ("g", 6, None, "n"), ("h", 1, ["a"], "h")]
    df = spark.createDataFrame(rows, "g string, pos int, keys array<string>, unit string")
    got = sorted((r.g, r.pos, r["keys"], r.unit) for r in leaders.fold_by_first_key(df, ["g"], ["pos"], "keys").collect())
    # the third row joins the second by "b" and takes "a" with it, so the fourth follows; the first stays apart
    assert got == [("g", 1, ["a"], None), ("g", 2, ["b", "x", "a"], "u"), ("g", 5, [], "n"), ("g", 6, None, "n"), ("h", 1, ["a"], "h")]


def test_near_duplicate_texts_find_pairs_without_shared_lines(spark):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    long, lined = say(600), [say(8) for _ in range(12)]
    texts = [(1, long), (2, long[:2000] + "zz" + long[2002:]), (3, long), (4, "\n".join(lined)), (5, "\n".join([*lined[:11], say(8)])), (6, say(600)), (7, "short"), (8, None), (None, long), (1, long)]
    got = {(r.a, r.b, r.confidence) for r in duplicates.near_duplicate_texts(spark.createDataFrame(texts, "id long, t string").withColumn("a", F.lit(1)), "id", "t").collect()}
    assert got == {(1, 2, "high"), (1, 3, "same"), (4, 5, "high")}


def test_redirects_are_followed_however_far(spark):
    from quernstone.operators import dictionary

    pairs = [(f"k{i}", f"k{i + 1}") for i in range(100)] + [("x", "y"), ("y", "z"), ("z", "x"), ("in", "x"), ("k5", "zz"), (None, "k1"), ("n", None)]
    ends = {r.from_key: r.to_key for r in dictionary.resolve_redirects(spark.createDataFrame(pairs, "from_key string, to_key string")).collect()}
    assert all(ends[f"k{i}"] == "k100" for i in range(100)) and set(ends) == {f"k{i}" for i in range(100)} | {"x", "y", "z", "in"}
    assert all(ends[k] in {"x", "y", "z"} for k in ("x", "y", "z", "in"))
    assert dictionary.resolve_redirects(spark.createDataFrame([], "from_key string, to_key string")).count() == 0


def naive_rows(cells):
    """Each cell joins the last row that it overlaps, all rows looked at."""
    height = sorted(c["bottom"] - c["top"] for c in cells)
    height = (height[(len(height) - 1) // 2] + height[len(height) // 2]) / 2
    share = lambda a0, a1, b0, b1: max(0.0, min(a1, b1) - max(a0, b0)) / min(a1 - a0, b1 - b0) if min(a1 - a0, b1 - b0) > 0 else 0.0
    rows = []
    for c in sorted(cells, key=lambda c: (round(c["top"] / (height * 0.45)), c["left"], c["line_id"])):
        for row in reversed(rows):
            tall = share(min(x["top"] for x in row), max(x["bottom"] for x in row), c["top"], c["bottom"]) >= 0.55
            if tall and all(share(x["left"], x["right"], c["left"], c["right"]) < 0.25 for x in row):
                row.append(c)
                break
        else:
            rows.append([c])
    return [" | ".join(x["text"] for x in sorted(row, key=lambda x: x["left"])) for row in rows]


def test_visual_rows_equal_a_search_of_all_rows(spark):
    from quernstone.operators import folds

    rng = random.Random(12)
    pages = {}
    for p in range(30):
        cells = []
        for i in range(rng.randint(1, 40)):
            top, left = rng.uniform(0, 200), rng.uniform(0, 300)
            cells.append({"line_id": f"{i:03d}", "text": f"t{i}", "top": top, "left": left, "right": left + rng.uniform(5, 80), "bottom": top + rng.choice([10, 12, 15, 40])})
        pages[p] = cells
    rows = [("d", p, c["line_id"], c["text"], None, c["left"], c["top"], c["right"], c["bottom"]) for p, cells in pages.items() for c in cells]
    df = spark.createDataFrame(rows, "doc_id string, page int, line_id string, text string, confidence double, left double, top double, right double, bottom double")
    got = {}
    for r in sorted(folds.visual_rows(df).collect(), key=lambda r: r.row_no):
        got.setdefault(r.page, []).append(r.text)
    assert got == {p: naive_rows(cells) for p, cells in pages.items()}


def test_a_budget_is_filled_by_priority(spark):
    from quernstone.operators import folds

    rng = random.Random(3)
    rows = [(f"d{i % 3}", rng.randrange(4), i, "x" * rng.choice([0, 1, 5, 20, 60, 200]), "keep") for i in range(120)] + [("d0", 0, 500, None, "keep")]
    want = []
    for d in ("d0", "d1", "d2"):
        left = 100
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], r[2])):
            if len(r[3] or "") <= left:
                left -= len(r[3] or "")
                want.append((d, r[2]))
    got = folds.fill_budget(spark.createDataFrame(rows, "doc_id string, priority int, line_no int, text string, other string"), budget=100).collect()
    assert sorted((r.doc_id, r.line_no) for r in got) == sorted(want) and all(r.other == "keep" for r in got)
    for d in ("d0", "d1", "d2"):
        at = [r.line_no for r in got if r.doc_id == d]
        assert at == sorted(at)


def test_lines_left_over_are_packed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 70)
    rng = random.Random(8)
    rows = [(f"r{rng.randrange(3)}", rng.randrange(60), i, "x" * rng.choice([0, 3, 40, 300]), rng.choice(["scalar", "scalar", "morphology"])) for i in range(2500)]
    df = spark.createDataFrame(rows, "report_id string, page_number int, line_no int, text string, mode string")
    want = set()
    for key in {(r[0], r[4]) for r in rows}:
        most, blocks = 16 if key[1] == "morphology" else 30, []
        mine = sorted((r for r in rows if (r[0], r[4]) == key), key=lambda r: (r[1], r[2]))
        for p in sorted({r[1] for r in mine}):
            some = [r for r in mine if r[1] == p]
            blocks += [(p, sum(len(r[3]) + 1 for r in some[i : i + most]) - 1, len(some[i : i + most])) for i in range(0, len(some), most)]
        at, unit = 0, 1
        for k in range(1, len(blocks) + 1):
            some = blocks[at : k + 1]
            n = sum(b[2] for b in some)
            ch, c, m = sum(b[1] for b in some) + 2 * (len(some) - 1), n, n if key[1] == "morphology" else 0
            pages = len({b[0] for b in some})
            if k == len(blocks) or pages > 24 or ch > 8000 or c > 60 or 768 + 96 * pages + 100 * c + 180 * m + min(768, -(-ch // 8)) > 12000:
                took = blocks[at:k]
                n = sum(b[2] for b in took)
                want.add((*key, unit, at, len({b[0] for b in took}), sum(b[1] for b in took), n, n if key[1] == "morphology" else 0))
                at, unit = k, unit + 1
    got = {tuple(r) for r in packing.omission_units(df).collect()}
    assert got == want and len(got) > 40


def test_alike_texts_are_candidates_by_equal_parts_only(spark):
    """Texts of few syllables have all their shingles in common with others, but hardly ever a whole part (F1)."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiou") + rng.choice("nrst") for _ in range(2)) for _ in range(20)]
    say = lambda n: "".join(rng.choice(words) for _ in range(n))
    texts = [say(rng.randrange(60, 900)) for _ in range(150)]
    for k in range(40):  # near copies around the limits: letters replaced here and there, some at the end
        t = list(texts[k])
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t))] = "z"
        texts.append("".join(t) + "y" * rng.randrange(0, 3) + say(rng.randrange(0, 1 + len(t) // 90)))
    sets = [set(duplicates.shingle_hashes(t, 7).tolist()) for t in texts]
    both = lambda a, b: len(sets[a] & sets[b])
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if a != b]
    want = {(a, b) for a, b in pairs if 1000 * both(a, b) >= 985 * min(len(sets[a]), len(sets[b])) and 100 * both(a, b) >= 95 * max(len(sets[a]), len(sets[b]))}
    got = {tuple(r) for r in duplicates.alike_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).select("a", "b").collect()}
    assert len(want) > 10 and want <= got and len(got) <= 2 * len(want) + 20


def test_groups_of_alike_texts_are_compared_in_blocks(spark, monkeypatch):
    """Neither pairs nor their texts are made by joins, and large groups are dealt over blocks (F2)."""
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    texts = []
    for size, lines in ((130, 9), (9, 40), (4, 1)):
        base = [say(10 if lines > 1 else 300) for _ in range(lines)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(lines)
                own[at] = own[at][: (cut := rng.randrange(40))] + "zyx" + own[at][cut + 3 :]
            texts.append("\n".join(own[: lines - rng.randrange(2)] or own))
    rng.shuffle(texts)
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(1000, texts[3]), (1000, texts[3])], "id long, text string")
    written, cut = [], duplicates.cut
    monkeypatch.setattr(duplicates, "cut", lambda df: (written.append((made.columns, made.count())), made)[1] if (made := cut(df)) else None)
    monkeypatch.setattr(duplicates, "SLICE_TEXTS", 32, raising=False)
    got = sorted(map(tuple, duplicates.near_duplicate_texts(df, "id", "text").collect()))
    every = spark.createDataFrame([(a, b) for b in range(len(texts)) for a in range(b)], "a long, b long")
    lines = F.array_distinct(F.split("text", "\n"))
    want = sorted(map(tuple, duplicates.text_evidence(every, df.filter("id < 1000").withColumn("lines", lines)).collect()))
    assert [r for r in got if r[2] == "same"] == [(3, 1000, "same", 1.0, None)]
    assert [r for r in got if r[2] != "same"] == want and len(want) > 1000
    assert max(n for columns, n in written if not {"key", "part"} & {*columns}) < 2 * len(texts)


def test_a_pair_with_a_key_in_common_is_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "SLICE_TEXTS", 8)
    rng = random.Random(3)
    keyed = sorted({(rng.randrange(60) if rng.random() < 0.6 else 7, f"d{rng.randrange(90):02}") for _ in range(260)})
    sizes = [(x, rng.randrange(120, 400)) for x in sorted({x for _, x in keyed})]
    blocks = duplicates.comparison_blocks(spark.createDataFrame(keyed, "key long, id string"), spark.createDataFrame(sizes, "id string, n int")).collect()
    held = {}
    for r in blocks:
        held.setdefault((r.lo, r.hi, r.i, r.j), []).append(r)
    pairs = [tuple(sorted((x.id, y.id))) for b in held.values() for k, y in enumerate(b) for x in b[:k] if x.whole or x.side != y.side]
    assert all(len({r.id for r in b}) == len(b) and len({r.whole for r in b}) == 1 for b in held.values()) and max(map(len, held.values())) < 48
    assert len(pairs) == len(set(pairs))
    by_key = {}
    for k, x in keyed:
        by_key.setdefault(k, []).append(x)
    assert {(x, y) for same in by_key.values() for x in same for y in same if x < y} <= set(pairs)


def test_shared_items_are_counted_by_bits_or_numbers():
    rng = random.Random(11)
    for most, size in ((90, 60), (10**6, 40), (70, 1)):  # alike sets, sets with little in common, sets of one item
        sets = [sorted({rng.randrange(most) for _ in range(rng.randrange(1, size + 1))}) for _ in range(30)]
        count = duplicates.shared_counts([np.array(x, np.uint64) for x in sets])
        assert all(count(y, np.arange(y)).tolist() == [len({*sets[y]} & {*sets[x]}) for x in range(y)] for y in range(1, 30))
