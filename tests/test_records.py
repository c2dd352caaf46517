"""Payloads, measurements, reports and the whole trend pipeline on hand-made records."""

import json

from pyspark.sql import functions as F

from quernstone.functions import measurements, payload
from quernstone.operators import reports, trends


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def payloads(spark, *items):
    return spark.createDataFrame([(i, json.dumps(x) if not isinstance(x, str) else x) for i, x in enumerate(items)], "rid int, payload string")


def test_facts_with_long_and_short_keys(spark):
    df = payloads(
        spark,
        {"diagnoses": [{"n": " 高血压 ", "t": "discharge", "primary": "是", "p": 2, "q": "诊断：高血压"}, {"text": "", "code": "x"}, {"diagnosisText": "y", "type": "odd", "evidence": [{"pageNumber": 0.4, "quote": " z "}, {"quote": ""}]}]},
        "broken {", {"diagnoses": "no list"}, {"observations": [{"n": "WBC", "r": "6.1", "v": "6.1", "lo": 4, "hi": "x", "f": "HIGH"}]},
    )
    got = payload.facts(df, "diagnosis", ["rid"]).collect()
    assert [(r.rid, r.diagnosisText, r.diagnosisType, r.isPrimary) for r in sorted(got, key=lambda r: r.position)] == [(0, "高血压", "discharge", True), (0, "y", "other", False)]
    assert {r.diagnosisText: [(e.pageNumber, e.quote) for e in r.evidence] for r in got} == {"高血压": [(2, "诊断：高血压")], "y": [(1, "z")]}
    o = payload.facts(df, "observation", ["rid"]).first()
    assert (o.itemName, o.numericValue, o.referenceLow, o.referenceHigh, o.abnormalFlag) == ("WBC", 6.1, 4.0, None, None)
    for kind in payload.FACTS:
        assert payload.facts(df.limit(0), kind, ["rid"]).count() == 0


def test_bills_and_maps(spark):
    df = payloads(spark, {"billingSummary": {"total": "12.5", "invoiceNo": "A1"}}, {"billing": {"summary": {"currency": "USD"}}}, {})
    assert rows(payload.billing_summary(df, ["rid"]), "rid", "invoiceNumber", "totalAmount", "currency") == [(0, "A1", 12.5, "CNY")]
    m = spark.createDataFrame([('{"a": " x ", "b": "", "c": "y"}',), ("broken",), (None,)], "j string")
    assert [r.m for r in m.select(payload.string_map(F.col("j"), ["a", "b"]).alias("m")).collect()] == [{"a": "x"}, {}, {}]
    assert [r.m for r in spark.createDataFrame([('["a", "b"]',), ("{}",)], "j string").select(payload.string_list(F.col("j")).alias("m")).collect()] == [["a", "b"], []]


def test_measurements(spark):
    lines = spark.createDataFrame([("r", 1, 1, "身高：170 cm 体重 65kg"), ("r", 1, 2, "身高 171cm"), ("r", 1, 3, "血压 120/80 mmHg"), ("r", 1, 4, "体重 900 kg"), ("r", 2, 1, "ABI 右侧 1.1 左侧 1.05"), ("r", 2, 2, "baPWV"), ("r", 2, 3, "右侧 1400 左侧 9")], "rid string, page int, line_no int, text string")
    got = {r.name: (r.value, r.unit) for r in measurements.basic_measurements(lines, ["rid"], ["page", "line_no"]).collect()}
    assert got == {"身高": (170.0, "cm"), "体重": (65.0, "kg"), "收缩压": (120.0, "mmHg"), "舒张压": (80.0, "mmHg")}
    v = measurements.vascular_values(lines, ["rid", "page"], ["line_no"])
    assert rows(v, "metric", "side", "value") == [("abi", "left", 1.05), ("abi", "right", 1.1), ("bapwv", "right", 1400.0)]


def test_titles_and_departments(spark):
    df = spark.createDataFrame([("报告", "laboratory", "血常规检验", None), ("出院小结 2024", "inpatient", None, None), (None, "outpatient", None, "内科"), (None, "checkup", None, None), (None, None, None, None)], "title string, kind string, subtype string, dept string")
    none = F.lit(None).cast("string")
    t = reports.report_title(F.col("title"), F.col("kind"), F.col("subtype"), none, F.col("dept"), none, none, none, none, none)
    assert [r.t for r in df.select(t.alias("t")).collect()] == ["血常规检验报告", "出院小结 2024", "内科门诊记录", "综合体检报告", "健康报告"]
    d = reports.display_department(none, none, none, none, F.col("kind"))
    assert [r.d for r in df.select(d.alias("d")).collect()] == [None, None, None, "综合体检", None]


def test_pages(spark):
    files = spark.createDataFrame([("r", 1, 2), ("r", 2, 1), ("s", 1, 0)], "report_id string, position int, page_count int")
    pages = reports.expand_pages(files)
    assert rows(pages) == [("r", 1, 1, 2), ("r", 2, 2, 2), ("r", 3, 1, 1), ("s", 1, 1, 1)]
    assert reports.incomplete_files(pages).count() == 0
    assert rows(reports.incomplete_files(pages.filter("page_number <> 2"))) == [("r",)]
    named = pages.withColumn("id", F.concat_ws("-", "report_id", "page_number"))
    assert rows(reports.merge_reports(named, "s", "r"), "report_id", "page_number") == [("r", 1), ("r", 2), ("r", 3), ("r", 4)]
    assert rows(reports.without_pages(named, spark.createDataFrame([("r-1",)], "id string")), "id", "page_number") == [("r-2", 1), ("r-3", 2), ("s-1", 1)]


REPORT = "id string, member_id string, status string, report_issued_at string, examined_at string, created_at string, recommendation string, deleted_at string"


def test_reminders_notices_trash(spark):
    rs = spark.createDataFrame([("r1", "m", "ready", "2024-01-31", None, "x", "1个月后复查", None), ("r2", "m", "failed", None, None, "2024-02-01 10:00:00", " ", None)], REPORT)
    none = spark.createDataFrame([], "report_id string")
    assert rows(reports.due_reminders(rs, none), "report_id", "due_date") == [("r1", "2024-03-02")]
    assert reports.due_reminders(rs, spark.createDataFrame([("r1",)], "report_id string")).count() == 0
    before = rs.withColumn("status", F.lit("processing"))
    assert rows(reports.notices(before, rs)) == [("r1", "filed"), ("r2", "processing_failed")]
    gone = reports.trash(rs, spark.createDataFrame([("r2",)], "id string"), F.lit("2024-03-01").cast("timestamp"))
    assert rows(gone, "id", "status", "purge_after") == [("r1", "ready", None), ("r2", "trashed", "2024-03-31 00:00:00")]
    tables = {"report_pages": spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r2", "b")], "report_id string, storage_path string")}
    left, files = reports.purge(tables, spark.createDataFrame([("r2",)], "id string"))
    assert rows(left["report_pages"]) == [("r1", "a")] and rows(files) == [("b",)]
    jobs = spark.createDataFrame([("r", "completed", 0, 0), ("r", "processing", 4, 1)], "report_id string, status string, units_total int, units_done int")
    assert rows(reports.page_progress(jobs)) == [("r", 63)]


def test_trend_with_a_duplicate_upload(spark):
    rs = spark.createDataFrame([(i, "m", s, d, None, "x", None, None) for i, s, d in (("r1", "ready", "2024-01-01"), ("r2", "ready", "2024-02-01"), ("r3", "needs_review", "2024-02-01 08:00:00"), ("r4", "trashed", "2024-03-01"))], REPORT)
    obs = spark.createDataFrame(
        [("o1", "r1", "GLU", 5.2, "mmol/L"), ("o2", "r2", "葡萄糖", 6.8, "mmol/L"), ("o3", "r3", "葡萄糖", 6.8, "mmol/L"), ("o4", "r4", "GLU", 9.0, "mmol/L"), ("o5", "r1", "GLU", None, None)],
        "id string, report_id string, item_name string, numeric_value double, unit string",
    ).withColumns({"reference_low": F.lit(3.9), "reference_high": F.lit(6.1), "abnormal_flag": F.lit(None).cast("string")})
    norm = spark.createDataFrame([(f"o{i}", "glucose_fasting", "空腹血糖", v, "mmol/L", "high", None) for i, v in ((1, 5.2), (2, 6.8), (3, 6.8), (4, 9.0))] + [("o5", None, None, None, None, "low", "unmatched")], "id string, canonical_key string, display_name string, canonical_value double, canonical_unit string, quality string, excluded_reason string")
    points = trends.trend_points(obs, norm, rs)
    s = trends.in_shown_order(trends.trend_series(points)).collect()
    assert len(s) == 1
    s = s[0]
    assert (s.point_count, s.latest_value, s.previous_value, s.delta, s.level, s.boundary, s.names) == (2, 6.8, 5.2, 1.6, "abnormal", "upper", ["GLU", "葡萄糖"])
    assert {r.id: r.left_out for r in points.collect()}["o5"] == "uncertain_match"


def test_trends_of_near_points(spark):
    made = [
        ("1", "r2", "ready", "2024-01-02 09:00:00", "A", 5.0, "high"), ("2", "r1", "ready", "2024-01-02 08:00:00", "B", 5.0 + 8e-10, "high"), ("3", "r3", "needs_review", "2024-01-02 08:00:00", "C", 5.0 + 1.6e-9, "high"),
        ("4", "r4", "ready", "2024-01-03", "D", 5.0, "medium"), ("5", "r4", "ready", "2024-01-03", "E", 5.0, "high"), ("6", "r5", "ready", None, "F", 5.0, "high"), ("7", "r5", "ready", None, "G", 5.0, "high"),
        ("8", "r6", "ready", "2024-01-01", "H", float("nan"), "high"), ("9", "r6", "ready", "2024-01-01", "H", float("nan"), "high"),
    ]
    points = spark.createDataFrame([(*m, "m", None, None, None, k, "Name " + m[4], u, None) for m in made for k, u in (("x", "u"), ("y", None))], "id string, report_id string, status string, sort_date string, item_name string, value double, quality string, member_id string, reference_low double, reference_high double, abnormal_flag string, series_key string, series_name string, series_unit string, left_out string")
    out = trends.trend_series(points)
    same = (F.substring("p.sort_date", 1, 10) == F.substring("o.sort_date", 1, 10)) & (F.abs(F.col("p.value") - F.col("o.value")) < 1e-9)
    assert [str(r) for r in rows(out)] == [str(r) for r in rows(trends.trend_series(points, same))]
    x = out.filter("series_key = 'x'").first()
    assert (x.point_count, x.name, x.latest_value, x.previous_value, x.names, x.first_date, x.last_date) == (6, "Name E", 5.0, 5.0 + 8e-10, ["B", "E", "F", "G", "H"], "2024-01-01", "2024-01-03")
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_findings_of_payloads(spark):
    df = payloads(
        spark,
        {"morphologyFindings": [
            {"organ": "肾", "findingType": "囊肿", "rawText": "左肾囊肿 12×8mm", "laterality": "odd", "classification": {"system": "Bosniak", "value": "1"}, "measurements": [{"key": "a", "value": 1.5}, {"key": None}]},
            {"findingName": "无描述"}, {"rawText": "nothing named"},
        ]},
        {"morphologyFindings": "x"},
    )
    got = payload.findings(df, ["rid"]).collect()
    assert len(got) == 1
    f = got[0]
    assert (f.finding_name, f.laterality, f.presence, f.size.length, f.size.unit, f.classification.system, [(m.key, m.value) for m in f.measurements]) == ("肾囊肿", "unspecified", "present", 12.0, "mm", "Bosniak", [("a", 1.5)])


def test_reading_again_and_confirming(spark):
    rs = spark.createDataFrame([("a", "needs_review", "t", ["title"]), ("b", "needs_review", "u", []), ("c", "ready", "v", [])], "id string, status string, title string, manual_fields array<string>")
    jobs = spark.createDataFrame([("j1", "a", "queued"), ("j2", "b", "queued"), ("j3", "c", "queued")], "id string, report_id string, status string")
    r, j = reports.reprocess(rs, jobs, spark.createDataFrame([("a",), ("b",)], "id string"), ["title"])
    assert rows(r, "id", "status", "title") == [("a", "processing", "t"), ("b", "processing", None), ("c", "ready", "v")]
    assert rows(j, "id", "status") == [("j1", "cancelled"), ("j2", "cancelled"), ("j3", "queued")]
    assert rows(reports.confirm(rs, spark.createDataFrame([("a",), ("c",)], "id string")), "id", "status") == [("a", "ready"), ("b", "needs_review"), ("c", "ready")]
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    none = F.lit(None).cast("string")
    assert v(reports.meaningful(F.lit("Laboratory"))) is None and v(reports.meaningful(F.lit(" CT "))) == "CT"
    assert v(reports.shown_body_part(F.lit("laboratory"), F.lit("laboratory"), none, none, F.lit("血常规"), none, none)) == "血常规"
    n = spark.createDataFrame([("1", "u", "x", "2024-01-03"), ("2", "u", None, "2024-01-01"), ("3", "v", None, "2024-01-02")], "id string, user_id string, read_at string, created_at string")
    assert [x.id for x in reports.notifications(n, "u").collect()] == ["2", "1"]
