"""Normalisation of observations: scored match against a dictionary of names, units, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.numeric import first_number, quality_bucket
from quernstone.functions.text import name_variants, narrow
from quernstone.functions.units import canonical_unit, conversion_table, length_rule

# Sections by which a name that several panels share is told apart.
STOOL = r"便常规|粪便|大便"
URINE = r"尿常规|尿沉渣|尿镜检|尿液|尿标本"
ECG = r"心电图|心电检查|静态心电|动态心电"
GENERAL_PULSE = r"一般检查|基础测量|生命体征|内科"

#: Rows of a dictionary that are sent to every task; a larger one is joined by a shuffle.
DICTIONARY_ROWS = 200_000


def context_penalty(key: Column, context: Column, name_text: Column) -> Column:
    """Points that a candidate loses because its panel can't be meant in this section."""
    stool, urine, ecg, pulse = (context.rlike(p) for p in (STOOL, URINE, ECG, GENERAL_PULSE))
    of = lambda p: key.rlike(p)
    rules = (
        (of("^glucose_fasting$") & F.concat_ws(" ", context, name_text).rlike("尿"), -80),
        (of("^renal_uric_acid$") & context.rlike("尿常规|尿液"), -35),
        ((stool | urine) & of("^cbc_"), -120),
        (stool & ~of("^stool_") & name_text.rlike(r"^(?:白细胞|红细胞)(?:计数)?$|(?i:^(?:wbc|rbc)$)"), -80),
        (urine & of("^stool_"), -120),
        (ecg & of("^vital_pulse$"), -120),
        (pulse & ~ecg & of("^ecg_heart_rate$"), -120),
    )
    total = F.lit(0)
    for test, points in rules:
        total = total + F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    return total


def match_scores(candidates: DataFrame) -> DataFrame:
    """Add ``score`` and ``unit_compatible`` to candidate rows (a kind of observation with one entry of the dictionary)."""
    unit, default = F.col("raw_unit"), canonical_unit(F.col("default_unit"))
    allowed = F.transform(F.coalesce("allowed_units", F.array().cast("array<string>")), canonical_unit)
    compatible = unit.isNull() | (default.isNull() & (F.size(allowed) == 0)) | F.array_contains(allowed, unit) | F.coalesce(unit == default, F.lit(False)) | F.col("convertible")
    numeric, kind = F.col("has_number"), F.col("value_type") == "numeric"
    bare = lambda c: F.regexp_replace(F.lower(narrow(c)), r"[\s\p{P}]+", "")
    hinted = F.exists(F.coalesce("section_hints", F.array().cast("array<string>")), lambda h: F.contains(bare(F.col("context")), bare(h)))
    score = (
        F.lit(55)
        + F.when(F.col("scope") != "global", 15).otherwise(0)
        + F.when(unit.isNull(), 0).when(compatible, 25).otherwise(-55)
        + F.when(hinted, 15).otherwise(0)
        + F.when(numeric & kind, 15).when(numeric, -15).when(~kind, 10).otherwise(0)
        + context_penalty(F.col("canonical_key"), F.col("context"), F.col("item_name"))
    )
    return candidates.withColumn("unit_compatible", compatible).withColumn("score", score)


def normalize_observations(observations: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Match each observation with its best entry of the dictionary and convert its value.

    ``observations``: ``id, item_name, result_text, numeric_value, unit, section_name, report_type``.
    ``dictionary``: ``normalized_alias, canonical_key, display_name, default_unit, value_type, trend_enabled, scope,
    allowed_units, section_hints``. Every observation has one row in the result. A match depends on no more than
    name, unit, section, report type and whether there is a number, so each such kind is matched once and joined
    with its observations. The variants of a name are exploded and joined by equality; the best score is an
    aggregate by kind, ties going to the smaller key. Without a match the quality is ``low`` and the reason says so.
    """
    spark = observations.sparkSession
    what = ["item_name", "unit", "section_name", "report_type", "has_number"]
    obs = observations.select("id", *what[:-1], F.coalesce("numeric_value", first_number(F.col("result_text"))).alias("number")).withColumn("has_number", F.col("number").isNotNull())
    kinds = obs.select(*what).distinct().withColumns({"raw_unit": canonical_unit(F.col("unit")), "context": F.concat_ws(" ", "section_name", "report_type")})
    small = dictionary.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS
    names = F.broadcast(dictionary) if small else dictionary
    # The outer form, as Spark would test for empty lists on each observation, before it looks for the kinds.
    met = kinds.withColumn("normalized_alias", F.explode_outer(name_variants(F.col("item_name")))).join(names, "normalized_alias")
    table = F.broadcast(conversion_table(spark))
    rule = table.select(F.col("key").alias("canonical_key"), F.col("from_unit").alias("raw_unit"), F.col("to_unit").alias("__to"), F.col("factor").alias("__f"), F.col("op").alias("__o"))
    met = met.withColumn("__to", canonical_unit(F.col("default_unit"))).join(rule, ["canonical_key", "raw_unit", "__to"], "left")
    op, factor = length_rule(F.col("raw_unit"), F.col("__to"))
    met = met.withColumns({"op": F.coalesce("__o", op), "factor": F.coalesce("__f", factor)})
    scored = match_scores(met.withColumn("convertible", F.col("factor").isNotNull()))
    excluded = ~F.col("trend_enabled") | (F.col("value_type") != "numeric") | ~F.col("has_number")
    why = (
        F.when(~F.col("trend_enabled"), "not_for_trends").when(F.col("value_type") != "numeric", "not_numeric").when(~F.col("has_number"), "no_number").when(~F.col("unit_compatible"), "unit")
    )
    row = F.struct(
        "canonical_key", "display_name", "op", "factor", F.coalesce("__to", "raw_unit").alias("canonical_unit"),
        (F.least(F.greatest("score", F.lit(0)), F.lit(100)) / 100).alias("confidence"), quality_bucket(F.col("score"), excluded).alias("quality"), F.when(excluded, why).alias("excluded_reason"),
    )
    best = scored.select(*what, "score", "canonical_key", row.alias("row")).groupBy(*what).agg(F.min_by("row", F.struct(-F.col("score"), F.col("canonical_key"))).alias("b"))
    best = best.select(*[F.col(c).alias(f"__{c}") for c in what], "b.*")
    out = obs.join(best, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in what]), "left")
    value = F.when(F.col("op") == "divide", F.col("number") / F.col("factor")).when(F.col("op") == "multiply", F.col("number") * F.col("factor")).otherwise(F.col("number"))
    return out.select(
        "id", "canonical_key", "display_name", F.when(F.col("canonical_key").isNotNull(), value).alias("canonical_value"), "canonical_unit",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("quality", F.lit("low")).alias("quality"),
        F.when(F.col("canonical_key").isNull(), "unmatched").otherwise(F.col("excluded_reason")).alias("excluded_reason"),
    )


def unmatched_pool(normalized: DataFrame, observations: DataFrame, most: int = 100) -> DataFrame:
    """The most frequent names without a match: a report of at most ``most`` rows."""
    lost = observations.join(normalized.filter("canonical_key is null").select("id"), "id", "left_semi")
    return lost.groupBy(F.lower(F.trim("item_name")).alias("name"), "unit").agg(F.count("*").alias("n"), F.max("report_date").alias("latest")).orderBy(F.col("n").desc(), "name").limit(most)


def stale(observations: DataFrame, normalized: DataFrame, version: str) -> DataFrame:
    """Observations that were never normalised, or by another version."""
    done = normalized.filter(F.col("version") == version).select("id")
    return observations.join(done, "id", "left_anti")


def key_migrations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old keys whose observations all have one same new key: ``old_key, new_key``."""
    both = old.select("id", F.col("canonical_key").alias("old_key")).join(new.select("id", F.col("canonical_key").alias("new_key")), "id")
    both = both.filter("old_key is not null and new_key is not null")
    one = both.groupBy("old_key").agg(F.count_distinct("new_key").alias("n"), F.min("new_key").alias("new_key"))
    return one.filter("n = 1 and new_key <> old_key").select("old_key", "new_key")
