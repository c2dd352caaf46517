"""Operators on small hand-made tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quernstone.operators import aggregates, dictionary, diffs, documents, duplicates, evidence, findings, folds, jobs, listing, normalize, series


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def test_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"2024-01-{i % 5 + 1:02d}") for i in range(1, 60)], "id long, issued string")
    seen, after = [], None
    while page := listing.keyset_page(df, "issued", "id", 13, after).collect():
        seen += [r.id for r in page]
        after = (page[-1].issued, page[-1].id)
    assert sorted(seen) == list(range(1, 60)) and len(set(seen)) == 59


def test_cursor_and_filters(spark):
    assert listing.decode_cursor(listing.encode_cursor("2024-01-01", 7)) == ["2024-01-01", "7"]
    df = spark.createDataFrame([(1, "St. Mary's", "a"), (2, "General", "b")], "id long, name string, kind string")
    assert rows(listing.list_filter(df, search=(["name"], "st mary")), "id") == [(1,)]
    assert listing.list_filter(df, equals={"kind": None}).count() == 2
    grants = spark.createDataFrame([("a", 1), ("a", 1)], "kind string, user_id int")
    assert rows(listing.visible_to(df, grants, 1, "kind"), "id") == [(1,)]


def test_aggregates(spark):
    df = spark.createDataFrame([("g", "x", 1.0), ("g", "y", 2.0), ("g", "y", 0.0), ("h", None, 1.0)], "g string, v string, w double")
    assert rows(aggregates.majority(df, ["g"], "v", "w")) == [("g", "y", 2), ("h", None, 1)]
    assert rows(aggregates.distinct_list(df, ["g"], "v", "all")) == [("g", "x,y")]
    merged = aggregates.merge_rows(spark.createDataFrame([(1, 2, None, "b"), (1, 1, "a", None)], "k int, r int, p string, q string"), ["k"], ["p", "q"], F.col("r"))
    assert rows(merged) == [(1, "a", "b")]
    sig = aggregates.signature(spark.createDataFrame([(1, "s1", 2), (1, "s0", 1), (2, None, 1)], "r int, sha string, p int"), ["r"], ["sha", "p"], "sha")
    assert rows(sig) == [(1, "s0:1|s1:2"), (2, None)]


def test_series(spark):
    pts = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 5.0), ("s", 3, 5.05), ("s", 4, 9.0)], "s string, rank int, v double")
    kept = series.drop_repeated_points(pts, ["s"], "rank", F.abs(F.col("p.v") - F.col("o.v")) < 0.2)
    assert rows(kept, "rank") == [(1,), (4,)]
    days = spark.createDataFrame([("u", d) for d in (1, 2, 3, 5, 5, 8)], "u string, d int")
    assert rows(series.islands(days, ["u"], "d"), "first", "last", "length") == [(1, 3, 3), (5, 5, 1), (8, 8, 1)]
    inferred = series.infer_if_unique(spark.createDataFrame([("a", "L"), ("a", None), ("b", "L"), ("b", "R"), ("b", None)], "k string, side string"), ["k"], "side", "out")
    assert rows(inferred, "k", "out", "ambiguous") == sorted([("a", "L", False), ("a", "L", False), ("b", "L", False), ("b", "R", False), ("b", None, True)], key=str)
    flat = series.scaled(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double"), ["k"], "v", "s")
    assert rows(flat, "k", "s") == [("a", 0.0), ("a", 1.0), ("b", 0.5)]


def test_near_points(spark):
    rng = random.Random(5)
    base = [0.0, -0.0, 1.0, 7.25, -3.5, 2.0**22, 2.0**23, 2.0**24, 1e12, 1e300, 1.7e308, 4e-310]
    moves = [0.0, 1e-9, 9.999999999999999e-10, 2.0**-30, 5e-10, -4e-10, 1.4e-9, 2e-9, -1e-9, 3e-9]
    values = [rng.choice(base) + rng.choice(moves) * rng.choice((1, 1, 2, 0.5)) for _ in range(600)] + [float("nan"), float("inf"), float("-inf"), None] * 3
    pts = spark.createDataFrame([(rng.choice(("a", "b", None)), i, v) for i, v in enumerate(rng.sample(values, len(values)))], "s string, at int, v double").repartition(3)
    want = series.drop_repeated_points(pts, ["s"], "at", F.abs(F.col("p.v") - F.col("o.v")) < 1e-9)
    kept = series.drop_near_points(pts, ["s"], "v", "at", 1e-9)
    assert kept.columns == pts.columns and rows(kept, "at", "s") == rows(want, "at", "s")
    wide = series.drop_near_points(pts, ["s"], "v", "at", 4.0)
    assert rows(wide, "at") == rows(series.drop_repeated_points(pts, ["s"], "at", F.abs(F.col("p.v") - F.col("o.v")) < 4.0), "at")
    assert " Join " not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_diffs_and_overrides(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert rows(diffs.snapshot_diff(old, new, "k", ["v"])) == [(1, "removed"), (2, "updated"), (4, "added")]
    assert rows(diffs.reconcile(old, new, "k", "v")) == [(1, "missing"), (2, "mismatched"), (4, "extra")]
    o = spark.createDataFrame([(1, "v", "x", 1), (1, "v", "y", 2), (2, "v", None, 1)], "k int, field string, value string, at int")
    assert rows(diffs.apply_overrides(old, o, "k", ["v"])) == [(1, "y"), (2, None), (3, None)]
    base = spark.createDataFrame([(1, "a", ["v"]), (2, "b", [])], "k int, v string, manual_fields array<string>")
    assert rows(diffs.apply_extraction(base, spark.createDataFrame([(1, "n"), (2, " ")], "k int, v string"), "k", ["v"]), "k", "v") == [(1, "a"), (2, "b")]
    assert rows(diffs.field_changes(old, new, "k", ["v"])) == [(2, "v", "b", "c")]
    assert rows(diffs.newest_rows(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, t int, v string"), ["k"], ["t"])) == [(1, 2, "b")]
    assert rows(diffs.insert_absent(old, new, ["k"]), "k") == [(1,), (2,), (3,), (4,)]
    derived = spark.createDataFrame([(1, "old", False), (1, "mine", True), (2, "else", False)], "k int, v string, manual boolean")
    fresh = spark.createDataFrame([(1, "new", False)], "k int, v string, manual boolean")
    assert rows(diffs.replace_derived(derived, fresh, "k", "manual"), "k", "v") == [(1, "mine"), (1, "new"), (2, "else")]
    assert rows(diffs.version_gaps(spark.createDataFrame([(1,), (2,), (5,)], "v int"), "v")) == [(5, 2)]


def finding(i, report, name, laterality="unspecified", size=None, date="2024-01-01", region=None):
    return (str(i), report, "m", None, region, laterality, None, name, "present", size, None, None, name, date)


FINDING = "id string, report_id string, member_id string, organ string, region string, laterality string, finding_type string, finding_name string, presence string, size_mm double, classification string, description string, raw_text string, report_date string"


def test_timelines(spark):
    data = [
        finding(1, "r1", "左肾囊肿", size=32.0), finding(2, "r2", "肾囊肿", size=38.0, date="2024-06-01"),  # the side is inferred
        finding(3, "r1", "左侧甲状腺结节", size=3.0), finding(4, "r2", "右侧甲状腺结节", size=3.0), finding(5, "r3", "甲状腺结节", size=4.0),  # either side: ambiguous
        finding(6, "r1", "胆囊息肉", size=3.0), finding(7, "r1", "胆囊息肉", size=6.0),  # two sizes in a report
    ]
    linked = findings.link_findings(spark.createDataFrame(data, FINDING))
    state = {r.id: (r.group_id is not None, r.ambiguous) for r in linked.collect()}
    assert state == {"1": (True, False), "2": (True, False), "3": (True, False), "4": (True, False), "5": (False, True), "6": (False, True), "7": (False, True)}
    lines = {r.n_reports: (r.latest_mm, r.delta_mm, r.change) for r in findings.timelines(linked).collect()}
    assert lines[2] == (38.0, 6.0, "increased") and lines[1][2] == "first"
    keep = findings.is_trackable(F.col("finding_name"), F.col("finding_type"), F.col("raw_text"), F.col("description"), F.col("presence"))
    df = spark.createDataFrame([finding(1, "r", "未见明显异常"), finding(2, "r", "肝囊肿"), finding(3, "r", "检查发现")], FINDING)
    assert rows(df.filter(keep), "id") == [("2",)]


def test_documents(spark):
    pages = spark.createDataFrame([("d", 1, '[{"id":"x","text":" a ","confidence":2},{"text":""},{"text":"b"}]'), ("d", 2, "broken")], "doc string, page_number int, lines_json string")
    assert rows(documents.parse_lines(pages), "line_id", "text", "confidence") == [("p1l3", "b", 0.0), ("x", "a", 1.0)]
    lines = spark.createDataFrame([("d", p, n, t) for p in range(1, 6) for n, t in enumerate(["Header", f"body {'abcdefgh'[p]}", *(f"l{'xyz'[k]}{'abcdefgh'[p]}" for k in range(3)), f"第 {p} 页"])], "doc_id string, page int, line_no int, line string")
    kept = documents.drop_repeated_lines(lines, "doc_id", "page", "line_no", edge=2)
    assert kept.filter("line = 'Header'").count() == 1 and kept.filter("line like '第%'").count() == 1 and kept.filter("line like 'body%'").count() == 5
    kinds = documents.classify_documents(spark.createDataFrame([("a", 1, "体检报告 检验报告"), ("a", 2, "超声 影像所见 回声"), ("b", 1, "plain")], "d string, p int, t string"), "d", "p", "t")
    assert {r.d: r.kinds[0] for r in kinds.collect()} == {"a": "checkup", "b": "other"}
    units = documents.pack(spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 5, 5, 100, 1, 1])], "d string, p int, n int"), ["d"], ["p"], F.col("n"), 10, 2)
    assert rows(units, "unit", "items", "total", "first") == [(1, 2, 10, 0), (2, 1, 5, 2), (3, 1, 100, 3), (4, 2, 2, 4)]
    halves = documents.split_units(spark.createDataFrame([([1, 2, 3],)], "x array<int>"), "x")
    assert rows(halves) == [([1, 2],), ([3],)]


def test_folds(spark):
    box = "doc_id string, page int, line_id string, text string, confidence double, left double, top double, right double, bottom double"
    cells = [("d", 1, "b", "9.1", 0.8, 100.0, 11.0, 140.0, 21.0), ("d", 1, "a", "WBC", 1.0, 0.0, 10.0, 50.0, 20.0), ("d", 1, "c", "next", 0.5, 0.0, 40.0, 50.0, 50.0), ("d", 1, "z", "no box", None, None, None, None, None)]
    assert rows(folds.visual_rows(spark.createDataFrame(cells, box)), "row_no", "text") == [(0, "WBC | 9.1"), (1, "next"), (2, "no box")]
    wrapped = spark.createDataFrame([("d", 1, 0, "a" * 30, None, "l0"), ("d", 1, 1, "goes on.", None, "l1"), ("d", 1, 2, "Head", "section", "l2"), ("d", 1, 3, "x | y", None, "l3")], "doc_id string, page int, line_no int, text string, boundary string, line_id string")
    assert rows(folds.merge_wrapped(wrapped), "text") == sorted([("a" * 30 + "goes on.",), ("Head",), ("x | y",)])
    budget = spark.createDataFrame([("d", 0, 0, "aaaa"), ("d", 1, 1, "b" * 9), ("d", 2, 2, "cc")], "doc_id string, priority int, line_no int, text string")
    assert rows(folds.fill_budget(budget, budget=7), "text") == [("aaaa",), ("cc",)]
    ctx = spark.createDataFrame([("d", 1, 0, "S", "section", False), ("d", 1, 1, "H", "table_header", False), ("d", 1, 2, "r", None, True), ("d", 2, 0, "r2", None, True), ("d", 3, 0, "t", None, False)], "doc_id string, page int, line_no int, text string, boundary string, candidate boolean")
    assert rows(folds.carry_context(ctx), "page", "line_no", "section", "table_header")[2:] == [(1, 2, "S", "H"), (2, 0, "S", "H"), (3, 0, None, None)]


DICTIONARY = "normalized_alias string, canonical_key string, display_name string, default_unit string, value_type string, trend_enabled boolean, scope string, allowed_units array<string>, section_hints array<string>"
ENTRIES = [
    ("白细胞", "cbc_wbc", "白细胞", "10^9/L", "numeric", True, "global", [], ["血常规"]), ("wbc", "cbc_wbc", "白细胞", "10^9/L", "numeric", True, "global", [], ["血常规"]),
    ("白细胞", "urine_wbc", "尿白细胞", "/HPF", "numeric", True, "global", ["个/μL"], ["尿常规"]), ("尿素氮", "renal_bun", "尿素氮", "mmol/L", "numeric", True, "global", [], []),
    ("尿蛋白", "urine_protein", "尿蛋白", None, "text", False, "global", [], ["尿常规"]),
]


def test_normalisation(spark):
    obs = spark.createDataFrame(
        [
            ("1", "白细胞(WBC)", "6.1", None, "10*9/L", "血常规", "laboratory"), ("2", "白细胞", "3", None, "个/HPF", "尿常规", "laboratory"), ("3", "尿素氮", None, 14.0, "mg/dl", None, None),
            ("4", "尿蛋白", "阴性", None, None, "尿常规", None), ("5", "unknown", "1", None, None, None, None),
        ],
        "id string, item_name string, result_text string, numeric_value double, unit string, section_name string, report_type string",
    )
    out = {r.id: r for r in normalize.normalize_observations(obs, spark.createDataFrame(ENTRIES, DICTIONARY)).collect()}
    assert [out[i].canonical_key for i in "12345"] == ["cbc_wbc", "urine_wbc", "renal_bun", "urine_protein", None]
    assert (round(out["3"].canonical_value, 6), out["3"].canonical_unit) == (4.998, "mmol/L")
    assert [out[i].quality for i in "1245"] == ["high", "high", "excluded", "low"]
    moved = normalize.key_migrations(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id int, canonical_key string"), spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "id int, canonical_key string"))
    assert rows(moved) == [("a", "x")]


def test_a_kind_of_observation_is_matched_once(spark):
    made = spark.range(400).select(
        "id", F.when(F.col("id") % 2 == 0, "白细胞(WBC)").otherwise(" ( ) ").alias("item_name"), F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("result_text"), F.lit(None).cast("double").alias("numeric_value"),
        F.when(F.col("id") % 3 == 0, "10*9/L").alias("unit"), F.when(F.col("id") % 4 == 0, "血常规").alias("section_name"), F.lit(None).cast("string").alias("report_type"),
    )
    out = normalize.normalize_observations(made.repartition(3), spark.createDataFrame(ENTRIES, DICTIONARY))
    got = {r.id: r for r in out.collect()}
    assert len(got) == 400 and all(got[i].canonical_key == (None if i % 2 else "cbc_wbc") for i in got)
    assert all(got[i].canonical_value == (None if i % 2 or i % 5 == 0 else float(i)) and got[i].excluded_reason == ("unmatched" if i % 2 else None if i % 5 else "no_number") for i in got)
    assert {got[i].quality for i in (6, 12)} == {"high"} and got[2].quality == "medium"
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = max(i for i, line in enumerate(plan) if "Aggregate [" in line)
    assert "item_name" in plan[last] and not any("regexp_extract(" in line for line in plan[last:])  # names are taken apart above the kinds only


def test_dictionary(spark):
    redirects = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("p", "gone")], "from_key string, to_key string")
    ends = {r.from_key: r.to_key for r in dictionary.resolve_redirects(redirects).collect()}
    assert ends["a"] == "c" and ends["b"] == "c"
    indicators = spark.createDataFrame([("c", "k1"), ("c", "k1"), ("d", "none")], "canonical_key string, category string")
    aliases = spark.createDataFrame([("c", "N A", "global"), ("d", "na", "global"), ("e", "z", "global")], "canonical_key string, alias string, scope string")
    categories = spark.createDataFrame([("k1", "g", 1), ("k2", "g", 1)], "category string, group string, item_order int")
    problems = {(r.problem, r.subject) for r in dictionary.validate(indicators, aliases, categories, redirects).collect()}
    assert {("repeated_key", "c"), ("unknown_category", "d"), ("unknown_key", "z"), ("ambiguous_alias", "na"), ("order_clash", "g#1"), ("redirect_to_nowhere", "p")} <= problems
    assert ("redirect_circle", "x") in problems
    merged = dictionary.merge_layers(spark.createDataFrame([("a", 1), ("k", 1)], "canonical_key string, v int"), spark.createDataFrame([("k", 2), ("r", 2)], "canonical_key string, v int"), redirects)
    assert rows(merged) == [("k", 1, "core"), ("r", 2, "remote")]
    obs = spark.createDataFrame([(1, "blood", None, None), (2, None, "血常规五项", None), (3, None, "未知", "imaging"), (4, None, None, None)], "id int, category string, section_name string, report_type string")
    placed = dictionary.place(obs, spark.createDataFrame([("blood", "laboratory", "cbc")], "category string, group string, subgroup string"), spark.createDataFrame([("lab2", ["血常规"], 1)], "group string, hints array<string>, item_order int"), spark.createDataFrame([("imaging", "img")], "report_type string, group string"))
    assert rows(placed, "id", "group", "confidence") == [(1, "laboratory", 95), (2, "lab2", 80), (3, "img", 50), (4, None, 0)]
    lines = spark.createDataFrame([("l1", "WBC | 6.1"), ("l2", "提示白细胞升高"), ("l3", "XWBCX | 1")], "line_id string, text string")
    facts = dictionary.facts_for_lines(lines, spark.createDataFrame([("cbc_wbc", "WBC"), ("cbc_wbc", "白细胞")], "canonical_key string, alias string"))
    assert rows(facts, "line_id", "alias") == [("l1", "WBC"), ("l2", "白细胞")]
    one, two = (dictionary.content_hash(spark.createDataFrame(d, "a int, b string"), ["a", "b"]).first() for d in ([(1, "x"), (2, None)], [(2, None), (1, "x")]))
    assert one == two


def test_evidence(spark):
    facts = spark.createDataFrame([("f1", "r", 1, "白细胞 6.1", "白细胞", "6.1"), ("f2", "r", 1, None, "血红蛋白", "150"), ("f3", "r", 1, "不存在的话", "x", "y")], "fact_id string, report_id string, page_number int, quote string, name string, value string")
    lines = spark.createDataFrame([("l1", "r", 1, "白细胞 | 6.1"), ("l2", "r", 1, "血红蛋白 150 g/L"), ("l3", "r", 2, "白细胞 6.1")], "line_id string, report_id string, page_number int, text string")
    found = evidence.supported(facts, lines)
    assert rows(found, "fact_id", "line_id") == [("f1", "l1"), ("f2", "l2")]
    assert rows(evidence.source_line(found)) == [("f1", "l1"), ("f2", "l2")]
    assert rows(evidence.verified(facts, found), "fact_id") == [("f1",), ("f2",)]
    seen = evidence.coverage(lines.select("line_id"), found, spark.createDataFrame([("l1",)], "line_id string"))
    assert rows(seen) == [("l1", "redundant"), ("l2", "ai"), ("l3", "unresolved")]
    same = spark.createDataFrame([("r", "k", None, "u", 1), ("r", "k", 5.0, None, 2), ("r", "k", 6.0, "u", 3)], "report_id string, name string, v double, unit string, pos int")
    assert rows(evidence.fold_compatible(same, ["name"], ["v", "unit"], ["pos"]), "v", "unit", "pos") == [(5.0, "u", 1), (6.0, "u", 3)]
    best = evidence.best_fields(spark.createDataFrame([("r", "title", " ", 0.9, 0), ("r", "title", "A", 0.5, 1), ("r", "title", "B", 0.5, 2)], "report_id string, field string, value string, confidence double, position int"))
    assert rows(best) == [("r", "title", "A")]
    match = evidence.match_protected(spark.createDataFrame([("r", "n1", 1), ("r", "n2", 2)], "report_id string, fact_id string, v int"), spark.createDataFrame([("r", "m1", 1), ("r", "m2", 9)], "report_id string, fact_id string, v int"), F.when(F.col("n.v") == F.col("m.v"), 60.0).otherwise(10.0))
    assert rows(match) == [("n1", "m1")]


def test_duplicates(spark):
    text = "".join(chr(0x4E00 + (i * i) % 997) for i in range(300))
    snaps = spark.createDataFrame([(1, text, ["l1", "l2", "l3"]), (2, text + "尾", ["l1", "l2", "l3"]), (3, text[::-1], ["x"])], "id int, text string, lines array<string>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert rows(duplicates.text_evidence(pairs, snaps), "a", "b", "confidence") == [(1, 2, "high")]
    ids = spark.createDataFrame([(1, {"no": "A1234"}), (2, {"no": "A1234", "x": "y"}), (3, {"x": "y"})], "id int, m map<string,string>")
    assert rows(duplicates.shared_identifiers(ids, "id", "m")) == [(1, 2, ["no"])]
    items = spark.createDataFrame([(d, f"i{k}") for d in (1, 2) for k in range(4)] + [(d, "common") for d in range(30)], "d int, i string")
    assert rows(duplicates.overlapping_pairs(items, "d", "i", 20)) == [(1, 2, 4, 1.0, 1.0)]


def test_line_set_pairs_without_a_cap(spark):
    rng = random.Random(3)
    docs = {d: {f"copy{k}" for k in range(5)} for d in range(25)}  # 25 equal sets
    docs |= {100 + d: {f"near{k}" for k in range(8)} | {f"own{d}"} for d in range(25)}  # 25 near copies
    docs |= {200 + d: {f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))} | {"everywhere"} for d in range(60)}
    items = spark.createDataFrame([(d, i) for d, s in docs.items() for i in s] * 2, "d int, i string")
    members, pairs = duplicates.line_set_pairs(items, "d", "i")
    rep = {d: min(e for e, t in docs.items() if t == s) for d, s in docs.items()}
    assert sorted(map(tuple, members.collect())) == sorted((r, d, len(docs[d])) for d, r in rep.items() if d != r)
    reps = sorted(set(rep.values()))
    want = [(a, b, len(docs[a] & docs[b]), len(docs[a]), len(docs[b])) for a in reps for b in reps if a < b]
    want = [w for w in want if w[2] >= 3 and w[2] * 10 >= min(w[3:]) * 6]
    assert sum(a >= 100 and b < 200 for a, b, *_ in want) == 300 and len(want) > 300
    assert sorted(map(tuple, pairs.collect())) == want


def test_sets_with_a_common_last_item_are_no_candidates(spark):
    """An item at the end of the common order leaves too few behind it to share three (F11, F12)."""
    common = [f"x{d}" for d in range(20)]
    sets = {d: [f"own{d}", "often"] + common[d % 4 :: 4] for d in range(40)} | {100 + d: [f"u{d}{k}" for k in range(3)] + ["often"] for d in range(60)}
    sets |= {90: ["p", "often", "x0"], 91: ["p", "often", "x0"] + common[1::4]}
    got = {tuple(r) for r in duplicates.overlap_candidates(spark.createDataFrame([(d, len(k), k) for d, k in sets.items()], "d int, n int, ks array<string>"), 3, 60).collect()}
    want = {(s, t) for s in sets for t in sets if (len(sets[s]), s) < (len(sets[t]), t) and 10 * len({*sets[s]} & {*sets[t]}) >= 6 * len(sets[s]) and len({*sets[s]} & {*sets[t]}) >= 3}
    assert want <= got and (90, 91) in want and not any(t >= 100 for _, t in got)


def test_queue(spark):
    t = dt.datetime(2024, 1, 1, 12)
    now = F.lit(t)
    schema = "id string, report_id string, page_id string, job_type string, status string, attempts int, lease_expires_at timestamp, next_retry_at timestamp, created_at timestamp"
    q = spark.createDataFrame(
        [
            ("a", "r1", None, "ocr", "queued", 0, None, None, t), ("b", "r1", None, "pdf_extract", "queued", 0, None, t + dt.timedelta(hours=1), t), ("c", "r2", None, "ai_extract", "queued", 0, None, None, t),
            ("d", "r2", None, "ocr", "processing", 3, t - dt.timedelta(minutes=1), None, t), ("e", "r2", None, "thumbnail", "processing", 1, t - dt.timedelta(minutes=1), None, t),
        ],
        schema,
    )
    state = {r.id: (r.status, r.attempts) for r in jobs.claim(q, now).collect()}
    assert state == {"a": ("queued", 0), "b": ("queued", 0), "c": ("queued", 0), "d": ("failed", 3), "e": ("processing", 2)}
    after = {r.id: (r.status, r.next_retry_at) for r in jobs.after_failure(q, spark.createDataFrame([("e",), ("d",)], "id string"), now).collect()}
    assert after["e"] == ("queued", t + dt.timedelta(seconds=30)) and after["d"][0] == "failed"
    plan = jobs.sync_units(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "unit_key string"), spark.createDataFrame([("k2", "done"), ("k3", "superseded"), ("k4", "done"), ("k5", "superseded")], "unit_key string, status string"))
    assert rows(plan) == [("k1", "insert"), ("k2", "keep"), ("k3", "revive"), ("k4", "supersede")]
    done = spark.createDataFrame([("1", "r9", None, "ocr", "completed", 1, None, None, t)], schema)
    ready = jobs.ready_for_extraction(done, spark.createDataFrame([("r9", 10)], "report_id string, text_length int"), spark.createDataFrame([], "report_id string, confidence string"))
    assert rows(ready) == [("r9",)]
    counts = jobs.reference_counts([(spark.createDataFrame([("p",), (None,)], "x string"), "x"), (spark.createDataFrame([("p",), ("q",)], "y string"), "y")])
    assert rows(counts) == [("p", 2), ("q", 1)]
