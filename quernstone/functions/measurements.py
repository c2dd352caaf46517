"""Measurements in lines of text: basic ones, blood pressure, and vascular indices of either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.numeric import number_at
from quernstone.operators.series import carry_forward

# Name, pattern of its names, pattern of its unit, and plausible bounds.
BASIC = (
    ("身高", r"身高", r"cm|厘米|m|米", 30.0, 250.0),
    ("体重", r"体重", r"kg|千克|公斤", 1.0, 400.0),
    ("体重指数", r"体重指数|BMI", r"kg/m2|kg/m²|kg/㎡|", 8.0, 80.0),
    ("腰围", r"腰围", r"cm|厘米", 20.0, 250.0),
    ("臀围", r"臀围", r"cm|厘米", 20.0, 250.0),
    ("脉搏", r"脉搏|脉率", r"次/分|次/min|bpm", 20.0, 260.0),
)


def basic_measurements(lines: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The first plausible value of each basic measurement: keys, ``name, value, unit, source``.

    All patterns are tried in one projection of a line; the first line that has a value wins.
    """
    found, numbers = [], {}
    for at, (name, names, unit, low, high) in enumerate(BASIC):
        pattern = rf"(?i:{names})[^\d+\-参范]{{0,12}}([-+]?\d+(?:\.\d+)?)\s*({unit})"
        numbers[f"__v{at}"], value = number_at(F.col(text), pattern), F.col(f"__v{at}")
        known = (value >= low) & (value <= high)
        found.append(F.when(known, F.struct(F.lit(name).alias("name"), value.alias("value"), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).alias("unit"))))
    pressure = r"(?i:血压|BP)[^\d]{0,12}(\d{2,3})\s*[/／]\s*(\d{2,3})"
    numbers |= {"__upper": number_at(F.col(text), pressure), "__lower": number_at(F.col(text), pressure, 2)}
    upper, lower = F.col("__upper"), F.col("__lower")
    both = upper.between(50, 280) & lower.between(30, 180)
    for name, value in (("收缩压", upper), ("舒张压", lower)):
        found.append(F.when(both, F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit("mmHg").alias("unit"))))
    each = lines.withColumns(numbers).select(*keys, *order, text, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("m"))
    best = F.min_by(F.struct("m.value", "m.unit", F.col(text).alias("source")), F.struct(*order)).alias("b")
    return each.groupBy(*keys, F.col("m.name").alias("name")).agg(best).select(*keys, "name", "b.value", "b.unit", "b.source")


def vascular_metric(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)ba\s*PWV|肱踝脉搏波|臂踝脉搏波|\bPWV\b"), "bapwv").when(text.rlike(r"(?i)\bABI\b|踝肱指数|踝臂指数"), "abi")


def vascular_values(lines: DataFrame, page: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Plausible values of either side: page keys, ``metric, side, value``; a line without a metric has the one last named on its page."""
    rows = carry_forward(lines, page, order, vascular_metric(F.col(text)), "metric").filter("metric is not null")
    names = r"(?:(?:ba\s*PWV|PWV|ABI|踝肱指数|踝臂指数)\s*)?"
    out = None
    for side, sign in (("right", "右"), ("left", "左")):
        after = number_at(F.col(text), rf"(?i){sign}(?:侧|踝)?\s*{names}[:：]?\s*(\d+(?:\.\d+)?)")
        before = number_at(F.col(text), rf"(?i)(?:ba\s*PWV|PWV|ABI|踝肱指数|踝臂指数)\s*[（(]?{sign}[）)]?\s*[:：]?\s*(\d+(?:\.\d+)?)")
        part = rows.select(*page, *order, "metric", F.lit(side).alias("side"), F.coalesce(after, before).alias("value"))
        out = part if out is None else out.unionByName(part)
    fits = ((F.col("metric") == "abi") & F.col("value").between(0.2, 3)) | ((F.col("metric") == "bapwv") & F.col("value").between(100, 5000))
    best = F.min_by("value", F.struct(*order)).alias("value")
    return out.filter(fits).groupBy(*page, "metric", "side").agg(best)
