"""Rollups and labels."""

from pyspark.sql import functions as F

from quernstone.operators import views


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def test_rollups(spark):
    s = spark.createDataFrame([("lab", "cbc", "k1", "WBC", "abnormal"), ("lab", "cbc", "k0", "RBC", "none"), ("lab", "lip", "k2", "TC", "none")], "group string, subgroup string, series_key string, name string, level string")
    r = views.sections(s).first()
    assert (r.n, r.abnormal, [(x.subgroup, x["keys"]) for x in r.subgroups]) == (3, 1, [("cbc", ["k0", "k1"]), ("lip", ["k2"])])
    u = spark.createDataFrame([("u1", p) for p in (1, 2, 3, 5)] + [("u2", 7)], "unit_id string, page_number int")
    assert rows(views.page_ranges(u)) == [("u1", "1-3、5"), ("u2", "7")]
    a = spark.createDataFrame([("r", "u1", 10, 5, 1500), ("r", "u1", None, 1, 500)], "report_id string, unit_id string, input_tokens int, output_tokens int, elapsed_ms int")
    units = spark.createDataFrame([("r", "u1", "done", [1, 2]), ("r", "u2", "failed", [2, 3]), ("s", "u3", "queued", [1])], "report_id string, unit_id string, status string, pages array<int>")
    assert rows(views.job_rollup(a, units), "report_id", "done", "failed", "open", "pages_done", "pages", "attempts", "input_tokens", "seconds") == [("r", 1, 1, 0, 2, 3, 2, 10, 2.0), ("s", 0, 0, 1, 0, 1, 0, 0, 0.0)]
    empty = spark.createDataFrame([], "attempts int, status string, input_tokens int, output_tokens int, elapsed_ms int")
    assert rows(views.usage_summary(empty)) == [(0, 0, 0, 0, 0.0)]
    i = spark.createDataFrame([("a", 1, "u", "s1", "2024"), ("a", 2, None, "s0", "2025")], "name string, n int, unit string, section_name string, latest string")
    assert rows(views.issues(i)) == [("a", 3, ["u"], ["s0", "s1"], "2025")]


def test_labels(spark):
    audit = spark.createDataFrame([(1, '{"memberId": "m1"}'), (2, '{"memberId": "unknown-member-id"}'), (3, "{}")], "n int, detail_json string")
    members = spark.createDataFrame([("m1", "Ann")], "id string, name string")
    assert rows(views.audit_labels(audit, {"memberId": (members, "name")}), "n", "memberId_name") == [(1, "Ann"), (2, "unknow…r-id"), (3, None)]
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert v(views.audit_sentence(F.lit("merged"), [F.lit("a"), F.lit(None).cast("string"), F.lit(" ")])) == "merged · a"
    assert v(views.series_name(F.lit("left"), F.lit("肾脏"), F.lit(None).cast("string"), F.lit("囊肿"))) == "左侧肾脏囊肿"
    log = spark.createDataFrame([("1", "2024-01-01", "info", "OCR done"), ("2", "2024-01-02", "error", "upload failed"), ("3", "2024-01-03", "warn", "x")], "id string, ts string, level string, message string")
    assert [(r.id, r.kind) for r in views.log_page(log, "important").collect()] == [("3", "system"), ("2", "upload")]
    assert [r.id for r in views.log_page(log, None, 1, ("2024-01-02", "2")).collect()] == ["1"]
    m = spark.createDataFrame([("m", "a", "left", "肾", "囊肿"), ("m", "b", "right", "肾", "囊肿"), ("m", "c", "unspecified", "肾", "结石")], "member_id string, group_id string, side string, organ string, type string")
    assert rows(views.comparable_series(m)) == [("a", "c"), ("b", "c")]
