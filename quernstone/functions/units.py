"""Units of measurement: canonical spelling and the conversions between them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import narrow

# Canonical unit of each spelling in lower case.
UNIT_NAMES = {
    "mmol/l": "mmol/L", "μmol/l": "μmol/L", "umol/l": "μmol/L", "mg/dl": "mg/dL", "mg/l": "mg/L", "g/l": "g/L", "g/dl": "g/dL",
    "u/l": "U/L", "iu/l": "U/L", "miu/l": "mIU/L", "uiu/ml": "μIU/mL", "μiu/ml": "μIU/mL", "pmol/l": "pmol/L", "nmol/l": "nmol/L",
    "ng/ml": "ng/mL", "μg/l": "μg/L", "pg/ml": "pg/mL", "ng/dl": "ng/dL", "meq/l": "mEq/L", "iu/ml": "IU/mL", "kiu/l": "IU/mL",
    "copies/ml": "copies/mL", "kg/m2": "kg/m²", "kg/m²": "kg/m²", "kg/㎡": "kg/m²", "mmhg": "mmHg", "bpm": "次/分", "次/min": "次/分",
    "次/分钟": "次/分", "次/分": "次/分", "fl": "fL", "pg": "pg", "l/l": "L/L", "ml/min/1.73m2": "mL/min/1.73m²", "ml/min/1.73m²": "mL/min/1.73m²",
    "/hpf": "/HPF", "cell/hp": "/HPF", "/lpf": "/LPF", "cast/lp": "/LPF", "个/lpf": "/LPF", "个/hpf": "/HPF", "cells/hpf": "/HPF",
    "个/μl": "个/μL", "cells/μl": "个/μL", "kg": "kg", "千克": "kg", "公斤": "kg", "g": "g", "克": "g", "m": "m", "米": "m", "cm": "cm",
    "厘米": "cm", "mm": "mm", "毫米": "mm", "10^9/l": "10^9/L", "10*9/l": "10^9/L", "×10^9/l": "10^9/L", "10^12/l": "10^12/L",
    "10*12/l": "10^12/L", "×10^12/l": "10^12/L", "10^3/μl": "10^3/μL", "10^6/μl": "10^6/μL", "%": "%",
}

# Analytes, the two units, and the factor that divides values of the first unit (or multiplies them).
CONVERSIONS = (
    (("lipid_tc", "lipid_hdl_c", "lipid_ldl_c"), "mg/dL", "mmol/L", "divide", 38.67),
    (("lipid_tg",), "mg/dL", "mmol/L", "divide", 88.57),
    (("glucose_fasting", "glucose_postprandial_2h", "glucose_random"), "mg/dL", "mmol/L", "divide", 18.018),
    (("cbc_hgb", "cbc_mchc", "liver_total_protein", "liver_albumin", "liver_globulin"), "g/dL", "g/L", "multiply", 10.0),
    (("cbc_hct",), "L/L", "%", "multiply", 100.0),
    (("renal_creatinine",), "mg/dL", "μmol/L", "multiply", 88.4),
    (("renal_uric_acid",), "mg/dL", "μmol/L", "multiply", 59.48),
    (("renal_urea",), "mg/dL", "mmol/L", "multiply", 0.1665),
    (("renal_bun",), "mg/dL", "mmol/L", "multiply", 0.357),
    (("liver_tbil", "liver_dbil", "liver_ibil"), "mg/dL", "μmol/L", "multiply", 17.104),
    (("body_weight",), "g", "kg", "divide", 1000.0),
    (("body_height", "body_waist_circumference", "body_hip_circumference"), "m", "cm", "multiply", 100.0),
)


def canonical_unit(unit: Column) -> Column:
    """The canonical spelling of a unit; an unknown one is only cleaned, an empty one is null."""
    u = F.regexp_replace(narrow(unit), r"\s+", "")
    u = F.regexp_replace(F.translate(u, "／⁄µ﹪", "//μ%"), "[×xX*]", "×")
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in UNIT_NAMES.items()))
    starred = F.translate(F.lower(u), "×", "*")
    return F.nullif(F.coalesce(F.try_element_at(known, F.lower(u)), F.try_element_at(known, starred), u), F.lit(""))


def conversion_table(spark: SparkSession) -> DataFrame:
    """``key, from_unit, to_unit, factor, op`` in both directions; a few dozen rows."""
    other = {"divide": "multiply", "multiply": "divide"}
    rows = [(k, a, b, f, op) for keys, a, b, op, f in CONVERSIONS for k in keys] + [(k, b, a, f, other[op]) for keys, a, b, op, f in CONVERSIONS for k in keys]
    return spark.createDataFrame(rows, "key string, from_unit string, to_unit string, factor double, op string")


def length_rule(unit: Column, to: Column) -> tuple[Column, Column]:
    """Operation and factor between centimetres and millimetres, for any analyte; null for other units."""
    op = F.when((unit == "cm") & (to == "mm"), "multiply").when((unit == "mm") & (to == "cm"), "divide")
    return op, F.when(op.isNotNull(), 10.0)


def converted(key: Column, value: Column, unit: Column, to: Column) -> Column:
    """A value in another unit; null where there is no rule. Units are canonical spellings."""
    op, factor = length_rule(unit, to)
    out = F.when(unit == to, value).when(op == "multiply", value * factor).when(op == "divide", value / factor)
    for keys, a, b, how, f in CONVERSIONS:
        there, back = (value / f, value * f) if how == "divide" else (value * f, value / f)
        out = out.when(key.isin(*keys) & (unit == a) & (to == b), there).when(key.isin(*keys) & (unit == b) & (to == a), back)
    return out


def convertible(key: Column, unit: Column, to: Column) -> Column:
    """Whether there is a rule between two units of an analyte."""
    return converted(key, F.lit(1.0), unit, to).isNotNull()
