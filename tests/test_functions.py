"""Pure expressions: values in, values out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.functions import dates, numeric, rules, text, units
from quernstone.functions.report_rules import FINDING_TYPES, ORGANS, REPORT_KINDS


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(v, kind="string"):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    ("args", "level", "boundary"),
    [
        ((11, 4, 10, "high"), "abnormal", "upper"),
        ((11, 4, 10, None), "abnormal", "upper"),
        ((9.5, 4, 10, "normal"), "near_boundary", "upper"),
        ((11, 4, 10, "normal"), "conflict", None),
        ((7, 10, 5, None), "conflict", None),
        ((9.2, None, 10, None), "near_boundary", "upper"),
        ((5, None, None, None), "none", None),
        ((3, 4, 10, None), "abnormal", "lower"),
        ((7, 10, 5, "low"), "abnormal", "lower"),
        ((4.3, 4, None, None), "near_boundary", "lower"),
    ],
)
def test_attention(spark, args, level, boundary):
    a = value(spark, numeric.attention(*[lit(x, "double") for x in args[:3]], lit(args[3])))
    assert (a.level, a.boundary) == (level, boundary)


@pytest.mark.parametrize(("said", "number"), [("1,234.5 mg", 1234.5), ("<0.5", 0.5), ("-3", -3.0), ("none", None), (None, None), ("≥ 7 x", 7.0)])
def test_first_number(spark, said, number):
    assert value(spark, numeric.first_number(lit(said))) == number


@pytest.mark.parametrize(("said", "low", "high"), [("3.5-5.5", 3.5, 5.5), ("3.5～5.5", 3.5, 5.5), ("<10", None, 10.0), ("≥ 4", 4.0, None), ("阴性", None, None)])
def test_reference_range(spark, said, low, high):
    r = value(spark, numeric.reference_range(lit(said)))
    assert (r.low, r.high, r.text) == (low, high, said)


def test_sizes(spark):
    s = numeric.size_of(lit("结节 1.2×0.8 cm"))
    assert value(spark, s).asDict() == {"length": 1.2, "width": 0.8, "height": None, "unit": "cm"}
    assert value(spark, numeric.largest_mm(s)) == 12.0
    assert value(spark, numeric.size_vector(s)) == [12.0, 8.0]
    assert value(spark, numeric.size_of(lit("没有"))) is None


def test_rounding_and_budgets(spark):
    assert value(spark, numeric.half_up(lit(-2.5, "double"))) == -2
    assert value(spark, numeric.token_estimate(*[lit(x, "int") for x in (2, 3, 1, 16_000)])) == 768 + 192 + 300 + 180 + 768
    assert value(spark, numeric.output_budget(lit(1000, "int"))) == 2048
    assert value(spark, numeric.output_budget(lit(100_000, "int"))) == 12_000
    assert [value(spark, numeric.display_number(lit(x, "double"))) for x in (123.4, 12.34, 1.234)] == ["123", "12.3", "1.23"]


@pytest.mark.parametrize(("unit", "name"), [("umol/l", "μmol/L"), ("10*9/L", "10^9/L"), ("kg/㎡", "kg/m²"), ("ｍｇ／ｄＬ", "mg/dL"), ("odd", "odd"), ("", None)])
def test_units(spark, unit, name):
    assert value(spark, units.canonical_unit(lit(unit))) == name


def test_conversions_are_mutual(spark):
    t = units.conversion_table(spark)
    assert t.count() == 2 * t.select("key").distinct().count()
    df = spark.createDataFrame([("renal_bun", "mg/dL", 14.0), ("cbc_hct", "L/L", 0.42), ("other", "x", 1.0)], "key string, unit string, value double")
    out = {r.key: (round(r.canonical_value, 6), r.canonical_unit) for r in numeric.convert_units(df, t).collect()}
    assert out == {"renal_bun": (4.998, "mmol/L"), "cbc_hct": (42.0, "%"), "other": (1.0, "x")}


def test_dates(spark):
    d = lambda day, n: value(spark, dates.add_months_rolling(lit(day, "date"), lit(n, "int")))
    assert d("2024-01-31", 1) == dt.date(2024, 3, 2)
    assert d("2024-01-15", 1) == dt.date(2024, 2, 15)
    assert value(spark, dates.normal_date(lit("报告日期 2024年3月5日 8:05"))) == "2024-03-05 08:05:00"
    assert value(spark, dates.normal_date(lit("2024/3/5"))) == "2024-03-05"
    assert value(spark, dates.normal_date(lit("none"))) is None
    assert value(spark, dates.valid_date_input(lit("2024-01-01T10:00"))) == "2024-01-01 10:00"
    assert value(spark, dates.valid_date_input(lit("yesterday"))) is None
    assert value(spark, dates.labelled_date(lit("送检 2023-01-02 报告时间：2024-05-06"), ["报告时间", "送检"])) == "2024-05-06"
    for advice, due in (("2024-09-01 复查", "2024-09-01"), ("6个月后复查", "2024-07-10"), ("10天后", "2024-01-20"), ("注意休息", "2024-04-10")):
        assert value(spark, dates.follow_up_date(lit(advice), lit("2024-01-10", "date"))) == due


@pytest.mark.parametrize(
    ("name", "keys"),
    [("白细胞计数(WBC)", {"白细胞计数wbc", "白细胞计数", "wbc"}), ("WBC-白细胞计数", {"wbc白细胞计数", "wbc"}), ("ＷＢＣ", {"wbc"}), ("", set())],
)
def test_name_variants(spark, name, keys):
    assert set(value(spark, text.name_variants(lit(name)))) >= keys


def test_keys_and_redaction(spark):
    assert value(spark, text.indicator_key(lit("尿 蛋白（定性）＋"))) == "尿蛋白+"
    assert value(spark, text.content_key(lit(None))) == ""
    assert value(spark, text.redact(lit("a@b.org 13812345678 10.0.0.1"))) == "[email] [mobile] [ip]"
    assert value(spark, text.redact(lit("Authorization: Bearer abc.def token=xyz"), text.LOG_REDACTIONS)).count("[redacted]") >= 2
    assert value(spark, text.drop_labelled_lines(lit("姓名：张三\n结果：正常"), ["姓名"])) == "结果：正常"
    assert value(spark, text.labelled_value(lit("门诊号：AB-123 x"), "门诊号")) == "AB-123"
    assert value(spark, text.same_institution(lit("北京大学第一医院"), lit("大学第一医院")))
    assert not value(spark, text.same_institution(lit("医院"), lit("北京医院")))
    assert value(spark, text.similar_text(lit("abcdefghijklmnop"), lit("xx ABCDEFGHIJKLMNOP yy")))
    assert spark.createDataFrame([("ﬁ①",), (None,)], "t string").select(text.nfkc("t").alias("t")).collect()[0].t == "fi1"


def test_rule_tables(spark):
    assert value(spark, rules.first_match(lit("左肾囊肿"), ORGANS)) == "肾脏"
    assert value(spark, rules.first_match(lit("左肾囊肿"), FINDING_TYPES)) == "囊肿"
    assert value(spark, rules.first_match(lit("x"), ORGANS, F.lit("none"))) == "none"
    done = rules.finish_classification(rules.scores_by_kind(lit("检验报告 血常规 标本类型 超声"), REPORT_KINDS))
    c = value(spark, done)
    assert c.kinds == ["laboratory"] or c.kinds[0] == "laboratory"
    assert 0.25 <= c.confidence <= 1
    assert value(spark, rules.finish_classification(rules.scores_by_kind(lit(""), REPORT_KINDS))).kinds == ["other"]
