"""Findings: descriptors by rules, timelines of the same finding, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import report_rules as R
from quernstone.functions.rules import first_match
from quernstone.functions.text import narrow

from .series import finding_change


def _said(*parts: Column) -> Column:
    return narrow(F.concat_ws(" ", *parts))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(narrow(F.coalesce(text, F.lit("")))), r"[（）()【】\[\]，,。.:：;；、\s_-]+", "")


def is_generic_normal(text: Column) -> Column:
    return text.rlike(R.GENERIC_NORMAL) & ~text.rlike(R.TRACKABLE)


def is_trackable(name: Column, kind: Column, raw: Column, morphology: Column, presence: Column) -> Column:
    """Whether a finding names something that later reports can be compared with."""
    text = _said(name, kind, raw, morphology)
    vague = F.trim(narrow(F.coalesce(name, F.lit("")))).rlike(R.PLACEHOLDER) & F.trim(narrow(F.coalesce(kind, F.lit("")))).rlike(R.PLACEHOLDER)
    lexicon = F.when(F.coalesce(presence, F.lit("")) == "absent", text.rlike(R.TRACKABLE_ABSENT)).otherwise(text.rlike(R.TRACKABLE))
    return (text != "") & ~is_generic_normal(text) & ~vague & lexicon


def organ_of(text: Column) -> Column:
    return first_match(F.trim(F.coalesce(text, F.lit(""))), R.ORGANS)


def type_of(text: Column) -> Column:
    return first_match(F.trim(F.coalesce(text, F.lit(""))), R.FINDING_TYPES)


def side_of(given: Column, text: Column) -> Column:
    known = F.coalesce(given, F.lit("unspecified"))
    return F.when(known != "unspecified", known).otherwise(first_match(text, R.SIDES, F.lit("unspecified")))


def region_of(given: Column, text: Column) -> Column:
    source = F.concat_ws(" ", F.coalesce(given, F.lit("")), text)
    found = [F.nullif(F.regexp_extract(source, p, 0), F.lit("")) for p in R.REGIONS]
    return F.regexp_replace(F.coalesce(*found), r"\s+", "")


def descriptors(findings: DataFrame) -> DataFrame:
    """Add ``d_organ, d_type, d_side, d_region``; organ and type are null where the rules find none."""
    ident = F.concat_ws(" ", "organ", "region", "finding_type", "finding_name")
    raw = F.substring(F.coalesce("raw_text", F.lit("")), 1, 500)
    return findings.withColumns(
        {
            "d_organ": F.coalesce(organ_of(F.coalesce(F.nullif("organ", F.lit("")), ident)), organ_of(F.col("finding_name")), organ_of(F.concat_ws(" ", ident, raw))),
            "d_type": F.coalesce(type_of(F.concat_ws(" ", "finding_type", "finding_name")), type_of(raw)),
            "d_side": side_of(F.col("laterality"), ident),
            "d_region": region_of(F.col("region"), ident),
        }
    )


def tracking_id(member: Column, organ: Column, kind: Column, side: Column, region: Column) -> Column:
    """The same id for the same member and descriptor, wherever it is computed."""
    key = F.concat_ws("|", *[compact(c) for c in (member, organ, kind, side, region)])
    return F.concat(F.lit("morph_"), F.substring(F.sha2(key, 256), 1, 24))


def link_findings(findings: DataFrame) -> DataFrame:
    """Assign findings to timelines.

    A missing side is taken from the member's other findings of the organ and type if those have one
    side only, a missing region likewise; else the finding is ``ambiguous`` and has no timeline.
    Findings of one report that would share a timeline but differ in size are ambiguous too.
    Adds ``group_id`` and ``ambiguous`` to the descriptors; input needs ``member_id, report_id, size_mm``.
    """
    d = descriptors(findings)
    known = F.col("d_organ").isNotNull() & F.col("d_type").isNotNull()
    # findings without organ or type never have a timeline, so they need no company in the windows
    d = d.withColumn("__w", F.when(~known, F.xxhash64(*findings.columns)))
    base = ["member_id", "d_organ", "d_type", "__w"]
    # One value only is the least and the largest; windows over a member's findings of one kind need no second pass.
    least = lambda c, *keys: F.min(c).over(Window.partitionBy(*keys))
    most = lambda c, *keys: F.max(c).over(Window.partitionBy(*keys))
    side = F.when(F.col("d_side") != "unspecified", F.col("d_side"))
    d = d.withColumn("__s", side).withColumns({"__s0": least("__s", *base), "__s1": most("__s", *base)})
    alone = F.when(F.col("__s0").isNull(), F.lit("unspecified")).when(F.col("__s0") == F.col("__s1"), F.col("__s0"))
    d = d.withColumn("__side", F.coalesce("__s", alone))
    d = d.withColumns({"__r0": least("d_region", *base, "__side"), "__r1": most("d_region", *base, "__side")})
    several = F.coalesce(F.col("__r0") != F.col("__r1"), F.lit(False))
    region = F.coalesce("d_region", F.when(~several, F.col("__r0")))
    d = d.withColumn("__region", region).withColumn("__many", F.col("d_region").isNull() & several)
    open_ = F.col("__side").isNull() | F.col("__many")
    group = F.when(known & ~open_, tracking_id(F.col("member_id"), F.col("d_organ"), F.col("d_type"), F.col("__side"), F.col("__region")))
    d = d.withColumn("__g", group).withColumn("__mm", F.round("size_mm", 1))
    bad = F.col("__g").isNotNull() & F.coalesce(least("__mm", "__g", "report_id") != most("__mm", "__g", "report_id"), F.lit(False))
    d = d.withColumn("__bad", bad)
    bad = F.col("__bad")
    out = d.withColumn("group_id", F.when(~bad, F.col("__g"))).withColumn("ambiguous", known & (open_ | bad))
    return out.select(*findings.columns, "d_organ", "d_type", "d_side", "d_region", "group_id", "ambiguous")


def timelines(linked: DataFrame) -> DataFrame:
    """One row for each timeline: its latest and previous report, the sizes, and the kind of change.

    Input needs ``group_id, report_id, report_date, presence, classification, size_mm, description``; the richest
    row of a report stands for it, then the one of the largest size, then the first by ``id``.
    """
    rich = sum((F.col(c).isNotNull().cast("int") for c in ("size_mm", "classification", "description")), F.lit(0))
    state = F.struct("presence", "classification", "size_mm", "description", "report_date", "report_id")
    one = linked.filter("group_id is not null").groupBy("group_id", "report_id").agg(F.min_by(state, F.struct(-rich, -F.coalesce("size_mm", F.lit(-1.0)), "id")).alias("s"))
    w = Window.partitionBy("group_id").orderBy("s.report_date", "report_id")
    seen = one.withColumn("p", F.lag("s").over(w)).withColumn("at", F.struct("s.report_date", "report_id"))
    out = seen.groupBy("group_id").agg(F.count("*").alias("n_reports"), F.max_by(F.struct("s", "p"), "at").alias("x"))
    s, p = F.col("x.s"), F.col("x.p")
    return out.select(
        "group_id", "n_reports", s["report_date"].alias("latest_date"), s["size_mm"].alias("latest_mm"), p["size_mm"].alias("previous_mm"),
        F.round(s["size_mm"] - p["size_mm"], 3).alias("delta_mm"), finding_change(s, p).alias("change"),
    )


def tracking_summary(linked: DataFrame) -> DataFrame:
    """One row: timelines, those with several reports, findings on a timeline, and findings without one."""
    per = linked.filter("group_id is not null").groupBy("group_id").agg(F.count_distinct("report_id").alias("reports"), F.count("*").alias("n"))
    on = per.agg(F.count("*").alias("groups"), F.count_if(F.col("reports") > 1).alias("multi_report_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
    off = linked.agg(F.count_if(F.col("group_id").isNull()).alias("untracked"))
    return on.join(off)  # one row each


def rebuild_counters(linked: DataFrame) -> DataFrame:
    """One row that tells what a rebuild of the timelines did: scanned, linked, groups, untracked, ambiguous, members."""
    g = F.col("group_id")
    return linked.agg(
        F.count("*").alias("scanned"), F.count(g).alias("linked"), F.count_distinct(g).alias("groups"), F.count_if(g.isNull()).alias("untracked"), F.count_if("ambiguous").alias("ambiguous"), F.count_distinct("member_id").alias("members")
    )


def shown_timelines(series: DataFrame, mode: str = "all", query: str | None = None) -> DataFrame:
    """Timelines for a list: ``multi`` or ``single`` by their number of reports, and a keyword in name, organ, region or type."""
    if mode != "all":
        series = series.filter(F.col("n_reports") > 1 if mode == "multi" else F.col("n_reports") <= 1)
    q = (query or "").strip().lower()
    if q:
        series = series.filter(F.contains(F.lower(F.concat_ws(" ", "name", "d_organ", "d_region", "d_type")), F.lit(q)))
    return series
