"""Edits by people."""

from pyspark.sql import functions as F

from quernstone.operators import edits


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def test_pins(spark):
    s = "user_id string, member_id string, series_key string"
    pins = spark.createDataFrame([("u", "m", "a"), ("u", "m", "b")], s)
    assert rows(edits.toggle_pins(pins, spark.createDataFrame([("u", "m", "b"), ("u", "m", "c")], s)), "series_key") == [("a",), ("c",)]
    assert rows(edits.migrate_pins(pins, spark.createDataFrame([("a", "b")], "old_key string, new_key string")), "series_key") == [("b",)]


def test_facts_and_links(spark):
    f = spark.createDataFrame([("f1", "x", 1.0, [], False), ("f2", "y", None, None, False)], "fact_id string, name string, dose double, manual_fields array<string>, is_deleted boolean")
    e = spark.createDataFrame([("f1", "name", "old", 1), ("f1", "name", "new", 2), ("f2", "dose", "2.5", 1), ("f2", "is_deleted", "true", 1)], "fact_id string, field string, value string, at int")
    assert rows(edits.apply_edits(f, e, ["name", "dose"])) == [("f1", "new", 1.0, ["name"], False), ("f2", "y", 2.5, ["dose", "is_deleted"], True)]
    g = spark.createDataFrame([("1", "g", []), ("2", "g", []), ("3", "g", ["ignored"])], "id string, group_id string, manual_fields array<string>")
    linked = edits.relink(g, spark.createDataFrame([("1", "h", 1), ("2", None, 1)], "id string, group_id string, at int"))
    got = {r.id: (r.group_id, r.manual_fields) for r in linked.collect()}
    assert got["1"] == ("h", ["group_id"]) and got["2"][0].startswith("morph_own_") and got["3"] == ("g", ["ignored"])
    rebuilt = g.withColumn("group_id", F.lit("new"))
    assert rows(edits.keep_manual_links(linked, rebuilt), "id", "group_id")[0] == ("1", "h") and rows(edits.keep_manual_links(linked, rebuilt), "id", "group_id")[2] == ("3", "new")
    assert rows(edits.not_ignored(g), "id") == [("1",), ("2",)]


def test_sections_events_pages(spark):
    s = spark.createDataFrame([("1", "r", "inpatient_course", "ai", []), ("2", "r", "inpatient_course", "ai", ["text"]), ("3", "r", "summary", "ai", [])], "id string, report_id string, section_key string, source string, manual_fields array<string>")
    assert rows(edits.repair_sections(s, spark.createDataFrame([("r", "checkup")], "id string, report_type string")), "id") == [("2",), ("3",)]
    units = spark.createDataFrame([("j", "k1", 0, "u1"), ("j", "k2", 1, "u2"), ("j", "k3", 1, "u3")], "job_id string, unit_key string, unit_index int, unit_id string")
    ev = spark.createDataFrame([("e1", "j", "k2", 5), ("e2", "j", None, 0), ("e3", "j", None, 1)], "event_id string, job_id string, unit_key string, unit_index int")
    assert rows(edits.attach_events(ev, units), "event_id", "unit_id") == [("e1", "u2"), ("e2", "u1"), ("e3", None)]
    pages = spark.createDataFrame([("r", 1), ("r", 2)], "report_id string, page_number int")
    assert rows(edits.lookup_pages(pages, spark.createDataFrame([("r", 2), ("r", 2), ("q", 1)], "report_id string, page_number int"))) == [("r", 2)]


def test_contexts_and_members(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = lambda s: F.lit(s).cast("string")
    c = v(edits.observation_context(lit("历史结果"), lit("血清钾"), lit("4.1"), lit(None), F.array(lit("2023-05-06 08:30"))))
    assert (c.temporal, c.measured_at, c.specimen) == ("historical", "2023-05-06 08:30", "serum")
    assert [v(edits.corrected_result(lit("5"), lit(x))) for x in ("—", "6.1 mmol/L", "阴性 -", "其他")] == [None, "6.1", "阴性", "5"]
    obs = spark.createDataFrame([("r", "超声", "左侧甲状腺结节", "大小 5×3mm", None)], "report_id string, section_name string, item_name string, result_text string, quote string")
    f = edits.findings_from_observations(obs).first()
    assert (f.organ, f.laterality, f.finding_type, f.presence, f.size.length, f.size.unit) == ("甲状腺", "left", "结节", "present", 5.0, "mm")
    m = spark.createDataFrame([("1", "Ann", None), ("2", "Bo", None)], "id string, name string, deleted_at string")
    ch = spark.createDataFrame([("1", "Anna", None, "2024-01-01"), ("3", "Cy", None, "2024-01-01"), ("2", "Bo", "2024-01-02", "2024-01-02")], "id string, name string, deleted_at string, at string")
    after = edits.members_after(m, ch)
    assert rows(after) == [("1", "Anna", None), ("2", "Bo", "2024-01-02"), ("3", "Cy", None)]
    p = spark.createDataFrame([("1", "old", "viewer"), ("1", "root", "viewer")], "member_id string, user_id string, permission string")
    assert rows(edits.rebind_admin(p, after, "root")) == [("1", "old", "viewer"), ("1", "root", "manager"), ("3", "root", "manager")]
    assert [r.k for r in edits.fixed_order(spark.createDataFrame([("z",), ("b",), ("a",), ("c",)], "k string"), "k", ["b", "a"]).collect()] == ["b", "a", "c", "z"]
