"""Lines of reports."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import screening


@pytest.mark.parametrize(
    ("line", "candidate", "boundary"),
    [
        ("白细胞 | 6.1 | 10^9/L | 3.5-9.5", True, None), ("【血常规】", False, "section"), ("项目 | 结果 | 参考范围 | 单位", False, "table_header"), ("第 3 页 共 5 页", False, None),
        ("报告日期：2024-01-01", False, "none"), ("甲状腺右叶可见低回声结节", True, None), ("胆囊未见明显结石", False, None), ("尿蛋白 阴性", True, None), ("20240101123456", False, None), ("血压 120 mmHg", True, None),
        ("目录", False, None), ("检查所见：", False, "section"),
    ],
)
def test_lines(spark, line, candidate, boundary):
    r = spark.createDataFrame([(line,)], "t string").select(screening.is_candidate(F.col("t")).alias("c"), screening.boundary(F.col("t")).alias("b")).first()
    assert r.c == candidate
    if boundary != "none":
        assert r.b == boundary


def test_table_results(spark):
    head = "项目 | 上次结果 | 结果 | 单位 | 参考范围"
    df = spark.createDataFrame([("WBC | 5.0 | 11.2↑ | 10^9/L | 3.5-9.5", head, 0.9), ("尿蛋白 | 阴性", None, None), ("A | 2024-01-01", None, None), ("B | 7", None, 0.3), ("no cells", None, None)], "text string, table_header string, confidence double")
    got = {r.item_name: (r.result_text, r.numeric_value, r.unit, r["range"].low, r["range"].high, r.flag) for r in screening.table_results(df).collect()}
    assert got == {"WBC": ("11.2↑", 11.2, "10^9/L", 3.5, 9.5, "high"), "尿蛋白": ("阴性", None, None, None, None, None)}


def test_small_rules(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert v(screening.needs_ocr(F.lit(20), F.lit(2000), F.lit(0.2))) and not v(screening.needs_ocr(F.lit(20), F.lit(2000), F.lit(0.1)))
    assert v(screening.section_fits(F.lit("checkup"), F.lit("checkup_summary"))) and not v(screening.section_fits(F.lit(None).cast("string"), F.lit("inpatient_course")))
    assert v(screening.feedback_name(F.lit(" 白细胞\n计数 "))) == "白细胞 计数" and v(screening.feedback_name(F.lit("call 13812345678"))) is None
    s = spark.createDataFrame([("空腹血糖", ["GLU", "葡萄糖"]), ("尿酸", ["UA"])], "name string, names array<string>")
    assert [(r.name, r.matched_alias) for r in screening.search_series(s, "g lu").collect()] == [("空腹血糖", "GLU")]
    assert [r.matched_alias for r in screening.search_series(s, "血糖").collect()] == [None]
    pages = spark.createDataFrame([("d", 1, 1, "健康教育"), ("d", 1, 2, "多喝水"), ("d", 2, 1, "血常规")], "d string, p int, line_no int, text string")
    assert [tuple(r) for r in screening.education_pages(pages, ["d", "p"]).collect()] == [("d", 1)]
    obs = spark.createDataFrame([("超声", "甲状腺", "结节", None, None, None), ("血常规", "WBC", "6", 6.0, "x", None)], "section_name string, item_name string, result_text string, numeric_value double, unit string, reference_text string")
    a, b = screening.split_legacy(obs)
    assert [r.item_name for r in a.collect()] == ["甲状腺"] and [r.item_name for r in b.collect()] == ["WBC"]


def test_result_cells_and_candidate_lines(spark):
    lines = {
        "尿糖 | 未见异常": True, "尿糖 | 阴性": True, "尿糖 | 阴性异常": True, "尿糖 | 5.2异常": False, "白细胞 5.2 10^9/L": True, "阴性 | 正常": False, "姓名：张三 | 阴性": False, "病历号：1 | 阴性": False,
        "1 | 血常规检查 | 12": False, "血常规 ........ 12": False, "目录": False, "尿蛋白 弱阳性": True, "备注 | 说明 | 阳性": True, "备注 | 正常区域 | 阳性": True, "图例 | 说明 | 正常区域 | 阳性": False, "未见": False,
    }
    df = spark.createDataFrame([(t, None, 0.9) for t in lines], "text string, table_header string, confidence double")
    got = {r.text: r.c for r in df.select("text", screening.is_candidate(F.col("text")).alias("c")).collect()}
    assert got == lines
    assert {r.text for r in screening.table_results(df).collect()} >= {"尿糖 | 未见异常", "尿糖 | 阴性"}
    assert not {"尿糖 | 阴性异常", "尿糖 | 5.2异常"} & {r.text for r in screening.table_results(df).collect()}


def test_cells_of_a_row_are_split_once(spark):
    """Each row's and header's cells are made once, not for each use of them (F16)."""
    rows = [(1, "白细胞 | 9.9 | 4.5 ↑ | 10^9/L | 3.5-9.5", "项目名称 | 历史结果 | 本次结果 | 单位 | 参考范围", 0.9), (2, "血糖 | 5 mmol/L | <6.1", None, None), (3, "检查日期 | 2024-01-01", None, 0.9), (4, "尿蛋白 | 阴性", "项目 | 单位", 0.9), (5, None, "项目 | 结果", 0.9)]
    out = screening.table_results(spark.createDataFrame(rows, "id int, text string, table_header string, confidence double"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    got = sorted((r.id, r.item_name, r.result_text, r.numeric_value, r.unit, r.range.low, r.range.high) for r in out.collect())
    assert got == [(1, "白细胞", "4.5 ↑", 4.5, "10^9/L", 3.5, 9.5), (2, "血糖", "5 mmol/L", 5.0, "mmol/L", None, 6.1), (4, "尿蛋白", "阴性", None, "阴性", None, None)]


def test_numbers_of_measurements_are_found_once_and_without_casts_of_empty_texts(spark):
    """Each pattern is tried once on a line, and a line without a match has null, not an empty text to cast (F14)."""
    from quernstone.functions import measurements

    out = measurements.basic_measurements(spark.createDataFrame([(1, 1, "身高 170 cm 血压 120/80"), (1, 2, "身高 180"), (1, 3, "没有"), (1, 4, None)], "r int, l int, text string"), ["r"], ["l"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 8
    assert sorted((r.name, r.value) for r in out.collect()) == [("收缩压", 120.0), ("舒张压", 80.0), ("身高", 170.0)]


def test_only_queued_jobs_meet_the_reports_to_be_read_again(spark):
    """Jobs that aren't queued are no input of a join, and none of a query for cancelled ones (F13)."""
    from quernstone.operators import reports

    jobs = spark.createDataFrame([(1, "queued", 1), (1, "completed", 2), (2, "queued", 3), (1, None, 4), (None, "queued", 5)], "report_id int, status string, job int")
    r = spark.createDataFrame([(1, "ready", "a", None), (2, "ready", "b", None)], "id int, status string, title string, manual_fields array<string>")
    _, queue = reports.reprocess(r, jobs, r.filter("id = 1").select("id"), ["title"])
    assert sorted((j.job, j.report_id, j.status) for j in queue.collect()) == [(1, 1, "cancelled"), (2, 1, "completed"), (3, 2, "queued"), (4, 1, None), (5, None, "queued")]
    plan = queue.filter("status = 'cancelled'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "LeftOuter" not in plan
