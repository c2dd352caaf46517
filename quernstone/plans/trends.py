"""Queries over series: latest and previous value, attention, duplicates, changes, islands, carried context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.dates import add_months_rolling
from quernstone.functions.numeric import attention, convert_units, retry_delay
from quernstone.operators.series import (
    carry_forward,
    first_wins,
    infer_if_unique,
    island_label,
    islands,
    renumber,
    size_change,
    status_changes,
)
from quernstone.operators.trends import series_summary

from .tables import table


def trend_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_summary(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value", "event_id")


def trend_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against a range for their type: the mean less and plus two standard deviations."""
    events = table(spark, sf_dir, "events")
    ranges = events.groupBy("event_type").agg(
        F.round(F.avg("value") - 2 * F.stddev_pop("value"), 2).alias("low"), F.round(F.avg("value") + 2 * F.stddev_pop("value"), 2).alias("high")
    )
    flag = F.when(F.col("event_id") % 17 == 0, "high").when(F.col("event_id") % 13 == 0, "normal")
    a = attention(F.col("value"), F.col("low"), F.col("high"), flag)
    rows = events.join(ranges, "event_type")
    return rows.select("event_id", a["level"].alias("level"), a["boundary"].alias("boundary")).filter("level <> 'none'")


def trend_points_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"), F.floor("value").alias("whole"), "ts", "event_id")
    return first_wins(rows, ["user_id", "event_type", "day", "whole"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "day", "whole", "event_id")


def gaps_and_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))
    runs = islands(days, ["user_id"], "day")
    return runs.select("user_id", "first", "last", "length", island_label(F.col("first"), F.col("last")).alias("label"))


def status_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return status_changes(rows, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type", "previous")


def timeline_change_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = series_summary(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "value", "event_id")
    return summary.select("user_id", "event_type", size_change(F.col("latest_value"), F.col("previous_value")).alias("change"))


def timeline_unique_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's segment, where missing, from the others of the nation, if all agree."""
    c = table(spark, sf_dir, "customer")
    known = F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_custkey") % 40 == F.col("c_nationkey")), F.col("c_mktsegment"))
    rows = c.select("c_custkey", "c_nationkey", known.alias("segment"))
    return infer_if_unique(rows, ["c_nationkey"], "segment", "inferred").select("c_custkey", "c_nationkey", "inferred", "ambiguous")


def carry_forward_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question that each answer is for: the last user turn before it."""
    asked = F.when(F.col("role") == "user", F.col("turn"))
    rows = carry_forward(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], asked, "asked", include_current=False)
    return rows.filter("role = 'assistant'").select("conv_id", "turn", "asked")


def renumber_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
    return renumber(kept, ["l_orderkey"], ["l_linenumber", "l_partkey"], "page")


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a failed job may run again: 30, 120, then 600 seconds later; after the third try never."""
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'")
    rows = failed.withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    wait = retry_delay(F.col("attempt"))
    return rows.select("event_id", "user_id", "attempt", F.coalesce(wait, F.lit(-1)).alias("wait"), F.timestamp_add("SECOND", wait, F.col("ts")).alias("next_retry_at"))


def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in the unit of their part, by a table of factors."""
    factors = spark.createDataFrame(
        [("glucose", "mg/dL", "mmol/L", 18.018, "divide"), ("creatinine", "mg/dL", "umol/L", 88.4, "multiply"), ("bun", "mg/dL", "mmol/L", 0.357, "multiply")],
        "key string, from_unit string, to_unit string, factor double, op string",
    )
    key = F.element_at(F.array(F.lit("glucose"), F.lit("creatinine"), F.lit("bun"), F.lit("other")), (F.col("l_partkey") % 4 + 1).cast("int"))
    unit = F.when(F.col("l_linenumber") % 2 == 0, "mg/dL").otherwise("mmol/L")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("key"), unit.alias("unit"), F.col("l_quantity").alias("value"))
    return convert_units(rows, factors).select("l_orderkey", "l_linenumber", "l_partkey", "canonical_unit", F.round("canonical_value", 6).alias("canonical_value"))


def due_date_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    months = (F.col("o_orderkey") % 6 + 1).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", add_months_rolling(day, months).cast("string").alias("due"))


QUERIES = {
    f.__name__: f
    for f in (
        trend_series_summary, trend_attention, trend_points_dedup_first, gaps_and_islands, status_change_events, timeline_change_kind, timeline_unique_inference,
        carry_forward_context, renumber_pages, retry_backoff, unit_conversion, due_date_rollover,
    )
}

_SUMMARY = """
    with r as (
      select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn
      from events where value is not null
    ), s as (
      select user_id, event_type, count(*) as point_count, min(ts) as first_ts, max(ts) as last_ts,
             max(case when rn = 1 then value end) as latest_value, max(case when rn = 2 then value end) as previous_value,
             round(max(case when rn = 1 then value end) - max(case when rn = 2 then value end), 6) as delta,
             min(value) as min_value, max(value) as max_value
      from r group by user_id, event_type
    )
"""

SQL = {
    "trend_series_summary": _SUMMARY + "select * from s",
    "trend_attention": """
        with g as (select event_type, round(avg(value) - 2 * stddev_pop(value), 2) as low, round(avg(value) + 2 * stddev_pop(value), 2) as high from events group by 1),
        e as (select *, case when event_id % 17 = 0 then 'high' when event_id % 13 = 0 then 'normal' end as flag from events join g using (event_type)),
        c as (select *, value < low as under, value > high as over, (value - low) / (high - low) as tl, (high - value) / (high - low) as th from e),
        l as (select event_id, case
            when flag = 'high' then 'abnormal' when high <= low then 'conflict' when flag = 'normal' and (under or over) then 'conflict'
            when under or over then 'abnormal' when least(tl, th) <= 0.1 then 'near_boundary' else 'none' end as level,
          case when flag = 'high' then 'upper' when high <= low or (flag = 'normal' and (under or over)) then null
            when over then 'upper' when under then 'lower' when least(tl, th) <= 0.1 then case when tl <= th then 'lower' else 'upper' end end as boundary
          from c)
        select event_id, level, boundary from l where level <> 'none'
    """,
    "trend_points_dedup_first": """
        select user_id, event_type, cast(cast(ts as date) as varchar) as day, cast(floor(value) as bigint) as whole, event_id from events
        qualify row_number() over (partition by user_id, event_type, cast(ts as date), floor(value) order by ts, event_id) = 1
    """,
    "gaps_and_islands": """
        with d as (select distinct user_id, cast(cast(ts as date) - date '2024-01-01' as integer) as day from events),
        g as (select *, day - row_number() over (partition by user_id order by day) as g from d)
        select user_id, min(day) as first, max(day) as last, count(*) as length,
          case when min(day) = max(day) then cast(min(day) as varchar) else min(day) || '-' || max(day) end as label
        from g group by user_id, g
    """,
    "status_change_events": """
        with l as (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events)
        select * from l where previous is distinct from event_type
    """,
    "timeline_change_kind": _SUMMARY + """
        select user_id, event_type, case when previous_value is null then 'new'
          when latest_value - previous_value > greatest(1.0, abs(previous_value) * 0.05) then 'increased'
          when previous_value - latest_value > greatest(1.0, abs(previous_value) * 0.05) then 'decreased' else 'stable' end as change
        from s
    """,
    "timeline_unique_inference": """
        with c as (select c_custkey, c_nationkey, case when c_custkey % 3 <> 0 and c_custkey % 40 = c_nationkey then c_mktsegment end as segment from customer),
        k as (select c_nationkey, count(distinct segment) as n, min(segment) as v from c group by 1)
        select c_custkey, c_nationkey, coalesce(segment, case when n = 1 then v end) as inferred, segment is null and n > 1 as ambiguous
        from c join k using (c_nationkey)
    """,
    "carry_forward_context": """
        with t as (select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls)
          over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as asked from conversations)
        select conv_id, turn, asked from t where role = 'assistant'
    """,
    "renumber_pages": """
        select l_orderkey, l_linenumber, l_partkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as integer) as page
        from lineitem where l_returnflag <> 'R'
    """,
    "retry_backoff": """
        with e as (select event_id, user_id, ts, cast(row_number() over (partition by user_id order by ts, event_id) as integer) as attempt from events where event_type = 'error')
        select event_id, user_id, attempt, case attempt when 1 then 30 when 2 then 120 when 3 then 600 else -1 end as wait,
          ts + to_seconds(case attempt when 1 then 30 when 2 then 120 when 3 then 600 end) as next_retry_at from e
    """,
    "unit_conversion": """
        with l as (select l_orderkey, l_linenumber, l_partkey, l_partkey % 4 as k, case when l_linenumber % 2 = 0 then 'mg/dL' else 'mmol/L' end as unit, l_quantity as v from lineitem)
        select l_orderkey, l_linenumber, l_partkey,
          case when unit = 'mg/dL' and k in (0, 2) then 'mmol/L' when unit = 'mg/dL' and k = 1 then 'umol/L' else unit end as canonical_unit,
          round(case when unit = 'mg/dL' and k = 0 then v / 18.018 when unit = 'mg/dL' and k = 1 then v * 88.4 when unit = 'mg/dL' and k = 2 then v * 0.357 else v end, 6) as canonical_value
        from l
    """,
    "due_date_rollover": """
        with o as (select o_orderkey, cast(o_orderdate as date) as d, cast(o_orderkey % 6 + 1 as integer) as m from orders)
        select o_orderkey, cast(cast(date_trunc('month', d) + to_months(m) as date) + cast(day(d) - 1 as integer) as varchar) as due from o
    """,
}
