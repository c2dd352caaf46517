"""Numbers in text, ranges, units, and the attention that a value deserves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d+(?:\.\d+)?"


def first_number(text: Column) -> Column:
    """The first number in a text; thousands separators are dropped, comparison signs ignored."""
    bare = F.regexp_replace(F.regexp_replace(text, ",", ""), "[<>≤≥＜＞]", " ")
    return number_at(bare, NUMBER, 0)


def half_up(x: Column, digits: int = 0) -> Column:
    """Round with halves going up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def number_at(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match as a number; null without a match, where a cast of an empty text would throw and be caught for each row."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 0).try_cast("double")


def reference_range(text: Column) -> Column:
    """``low``, ``high`` and ``text`` of a reference range: ``a-b``, ``<b``, ``>a`` and the like."""
    t = F.regexp_replace(F.trim(text), r"[～~—–－至]+|\s+to\s+", "-")
    both = r"(-?\d+(?:\.\d+)?)\s*-+\s*(-?\d+(?:\.\d+)?)"
    upper, lower = r"^(?:<|≤|＜|<=|小于|不超过)\s*=?\s*(\d+(?:\.\d+)?)", r"^(?:>|≥|＞|>=|大于|不低于)\s*=?\s*(\d+(?:\.\d+)?)"
    num = lambda p, g: number_at(t, p, g)
    return F.struct(
        F.coalesce(num(both, 1), num(lower, 1)).alias("low"), F.coalesce(num(both, 2), num(upper, 1)).alias("high"), F.nullif(F.trim(text), F.lit("")).alias("text")
    )


def abnormal_flag(text: Column) -> Column:
    """``high``, ``low`` or ``abnormal`` from arrows, words or a star; null where there is no sign."""
    return (
        F.when(text.rlike(r"[↑⬆▲]|偏高|升高|(?i:\bhigh\b)|(?:^|\s)H(?:\s|$)"), "high")
        .when(text.rlike(r"[↓⬇▼]|偏低|降低|(?i:\blow\b)|(?:^|\s)L(?:\s|$)"), "low")
        .when(text.rlike(r"\*|异常|(?i:abnormal)|阳性"), "abnormal")
    )


def attention(value: Column, low: Column, high: Column, flag: Column, near: float = 0.1) -> Column:
    """How much attention a value deserves: struct of ``level``, ``boundary``, ``reason`` and ``conflict``.

    In order: an explicit flag makes a value abnormal; a range without extent is a conflict, and so
    is a normal flag on a value outside; a value outside is abnormal; one within a tenth of the range
    from a limit (with one limit: a tenth of that limit) is near the boundary, the lower one on a tie.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    invalid = no(high <= low)
    lo, hi = F.when(~invalid, low), F.when(~invalid, high)
    under, over = no(value < lo), no(value > hi)
    flagged = no(flag.isin("high", "low", "abnormal"))
    contradicts = no(flag == "normal") & (under | over)
    both = lo.isNotNull() & hi.isNotNull()
    to_low, to_high = (value - lo) / (hi - lo), (hi - value) / (hi - lo)
    near_two = both & no(F.least(to_low, to_high) <= near)
    near_one_high = ~both & no((hi != 0) & ((hi - value) / F.abs(hi) <= near))
    near_one_low = ~both & no((lo != 0) & ((value - lo) / F.abs(lo) <= near))
    at = F.when(near_two, F.when(to_low <= to_high, "lower").otherwise("upper")).when(near_one_high, "upper").when(near_one_low, "lower")
    level = (
        F.when(flagged, "abnormal").when(invalid | contradicts, "conflict").when(under | over, "abnormal").when(at.isNotNull(), "near_boundary").otherwise("none")
    )
    boundary = (
        F.when(flagged, F.when(flag == "high", "upper").when(flag == "low", "lower"))
        .when(invalid | contradicts, F.lit(None).cast("string"))
        .when(over, "upper")
        .when(under, "lower")
        .otherwise(at)
    )
    reason = (
        F.when(flagged, F.concat(F.lit("flag_"), flag)).when(invalid, "invalid_range").when(contradicts, "flag_against_range").when(over, "above_range").when(under, "below_range").when(at.isNotNull(), "near_limit")
    )
    return F.struct(level.alias("level"), boundary.alias("boundary"), reason.alias("reason"), (~flagged & (invalid | contradicts)).alias("conflict"))


def corrected_flag(value: Column, low: Column, high: Column, flag: Column) -> Column:
    """A flag that the range contradicts is dropped; where the range decides, it sets the flag."""
    outside = F.when(value > high, "high").when(value < low, "low")
    inside = (low.isNotNull() | high.isNotNull()) & value.isNotNull() & outside.isNull()
    return F.when(outside.isNotNull(), outside).when(inside & flag.isin("high", "low"), F.lit("normal")).otherwise(flag)


def convert_units(df: DataFrame, factors: DataFrame, key: str = "key", unit: str = "unit", value: str = "value") -> DataFrame:
    """Add ``canonical_value`` and ``canonical_unit`` by a table ``key, from_unit, to_unit, factor, op``.

    Dividing and multiplying stay apart, as they round differently. Values without a rule
    keep their unit. The table of factors is a dictionary of a few dozen rows and is broadcast.
    """
    f = F.broadcast(factors.select(F.col("key").alias("__k"), F.col("from_unit").alias("__u"), "to_unit", "factor", "op"))
    out = df.join(f, (F.col(key) == F.col("__k")) & (F.col(unit) == F.col("__u")), "left")
    made = F.when(F.col("op") == "divide", F.col(value) / F.col("factor")).when(F.col("op") == "multiply", F.col(value) * F.col("factor")).otherwise(F.col(value))
    return out.withColumn("canonical_value", made).withColumn("canonical_unit", F.coalesce("to_unit", unit)).drop("__k", "__u", "to_unit", "factor", "op")


def size_of(text: Column) -> Column:
    """``length, width, height, unit`` of a size like ``12×8×5 mm``; null without one."""
    p = r"(\d+(?:\.\d+)?)\s*(?:(mm|cm|毫米|厘米)\s*)?[×xX*＊]\s*(\d+(?:\.\d+)?)\s*(?:(?:mm|cm|毫米|厘米)\s*(?=[×xX*＊]))?(?:[×xX*＊]\s*(\d+(?:\.\d+)?))?\s*(mm|cm|毫米|厘米)?"
    unit = F.coalesce(F.nullif(F.regexp_extract(text, p, 5), F.lit("")), F.nullif(F.regexp_extract(text, p, 2), F.lit("")))
    number = lambda g: number_at(text, p, g)
    named = F.when(unit.isin("cm", "厘米"), "cm").when(unit.isin("mm", "毫米"), "mm")
    return F.when(text.rlike(p), F.struct(number(1).alias("length"), number(3).alias("width"), number(4).alias("height"), named.alias("unit")))


def largest_mm(size: Column) -> Column:
    """The largest dimension of a size in millimetres; without a unit it is unknown."""
    factor = F.when(size["unit"] == "cm", 10.0).when(size["unit"] == "mm", 1.0)
    return F.greatest(size["length"], size["width"], size["height"]) * factor


def size_vector(size: Column) -> Column:
    """Dimensions in millimetres, descending, to three decimals."""
    factor = F.when(size["unit"] == "cm", 10.0).otherwise(1.0)
    sides = F.filter(F.array(size["length"], size["width"], size["height"]), lambda x: x.isNotNull())
    return F.reverse(F.array_sort(F.transform(sides, lambda x: F.round(x * factor, 3))))


def quality_bucket(score: Column, excluded: Column) -> Column:
    return F.when(excluded, "excluded").when(score >= 90, "high").when(score >= 65, "medium").otherwise("low")


def retry_delay(attempt: Column) -> Column:
    """Seconds until a failed job's next try; null after the last."""
    return F.when(attempt == 1, 30).when(attempt == 2, 120).when(attempt == 3, 600)


def token_estimate(pages: Column, rows: Column, findings: Column, chars: Column) -> Column:
    """Output tokens that a unit of pages will need."""
    return 768 + 96 * pages + 100 * rows + 180 * findings + F.least(F.lit(768), F.ceil(chars / 8))


def output_budget(estimate: Column, low: int = 2048, high: int = 12000) -> Column:
    """The estimate plus 35 %, up to a multiple of 1024, within bounds."""
    return F.least(F.greatest(F.ceil(estimate * 1.35 / 1024) * 1024, F.lit(low)), F.lit(high))


def display_number(x: Column) -> Column:
    """Digits by magnitude: none from 100 on, one from 10 on, else two; null for null."""
    return F.when(F.abs(x) >= 100, F.format_string("%.0f", x)).when(F.abs(x) >= 10, F.format_string("%.1f", x)).when(x.isNotNull(), F.format_string("%.2f", x))
