"""Queries in the shape of record keeping: merged rows, signatures, references, ranges, sessions, queue and plan states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.aggregates import merge_rows, signature
from quernstone.operators.diffs import field_changes
from quernstone.operators.jobs import after_failure, reference_counts, sync_units
from quernstone.operators.normalize import key_migrations
from quernstone.operators.series import scaled
from quernstone.operators.views import page_ranges

from .tables import table


def scaled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "value", "height")
    return rows.select("event_id", F.round("height", 6).alias("height"))


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user: the first value of an error, and the first properties of a click."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    rows = e.select("user_id", "event_id", F.when(kind == "error", F.col("value")).alias("error_value"), F.when(kind == "click", F.col("props")).alias("click_props"))
    return merge_rows(rows, ["user_id"], ["error_value", "click_props"], F.col("event_id"))


def order_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signature(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], "o_orderstatus")
    return out.select("o_custkey", F.sha2("signature", 256).alias("signature"))


def supplier_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return reference_counts([(lines, "l_suppkey"), (parts, "s_suppkey")]).select(F.col("path").alias("suppkey"), "n")


def active_day_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"))
    return page_ranges(days, "user_id", "day").select("user_id", F.replace("pages", F.lit("、"), F.lit(",")).alias("days"))


def hourly_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events less than six hours apart."""
    e = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id")
    return e.agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select("user_id", F.col("w.start").alias("first_ts"), "last_ts", "n")


def edited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    edited = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 50 == 0, "MANUAL").otherwise(F.col("c_mktsegment")))
    edited = edited.withColumn("c_name", F.when(F.col("c_custkey") % 90 == 0, F.lit(None)).otherwise(F.col("c_name")))
    return field_changes(c, edited, "c_custkey", ["c_mktsegment", "c_name"])


def queue_after_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as running jobs on their first to fourth try; errors fail."""
    e = table(spark, sf_dir, "events")
    jobs = e.select(
        F.col("event_id").alias("id"), F.lit("processing").alias("status"), (F.col("event_id") % 4 + 1).cast("int").alias("attempts"),
        F.lit(None).cast("timestamp").alias("lease_expires_at"), F.lit(None).cast("timestamp").alias("next_retry_at"),
    )
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = after_failure(jobs, e.filter("event_type = 'error'").select(F.col("event_id").alias("id")), now)
    return out.select("id", "status", F.coalesce(F.date_format("next_retry_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("next_retry"))


def plan_synchronisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units of a plan: those from 1997 on are planned, those before 1999 are stored, pending ones superseded."""
    o = table(spark, sf_dir, "orders")
    planned = o.filter("o_orderdate >= timestamp'1997-01-01'").select(F.col("o_orderkey").alias("unit_key"))
    stored = o.filter("o_orderdate < timestamp'1999-01-01'").select(F.col("o_orderkey").alias("unit_key"), F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("done").alias("status"))
    return sync_units(planned, stored)


def moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose parts all have one new key, by their size."""
    p = table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type", "p_size").alias("canonical_key"))
    new = p.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_name").alias("canonical_key"))
    return key_migrations(old, new)


QUERIES = {
    f.__name__: f
    for f in (
        scaled_points, merged_rows, order_signatures, supplier_references, active_day_ranges, hourly_event_counts, user_sessions, edited_fields, queue_after_failures, plan_synchronisation, moved_keys,
    )
}

SQL = {
    "scaled_points": """
        with w as (select event_id, value, min(value) over (partition by user_id, event_type) as lo, max(value) over (partition by user_id, event_type) as hi from events)
        select event_id, round(case when hi = lo then 0.5 else (value - lo) / (hi - lo) end, 6) as height from w
    """,
    "merged_rows": """
        select user_id, arg_min(value, event_id) filter (event_type = 'error' and value is not null) as error_value,
          arg_min(props, event_id) filter (event_type = 'click' and props is not null) as click_props from events group by 1
    """,
    "order_signatures": """
        select o_custkey, sha256(array_to_string(list_sort(list(o_orderkey || ':' || o_orderstatus)), '|')) as signature from orders group by 1
    """,
    "supplier_references": """
        with p as (select l_suppkey as suppkey from lineitem union all select s_suppkey from supplier) select suppkey, count(*) as n from p where suppkey is not null group by 1
    """,
    "active_day_ranges": """
        with d as (select distinct user_id, cast(cast(ts as date) - date '2024-01-01' as integer) as day from events),
        g as (select *, day - row_number() over (partition by user_id order by day) as g from d),
        r as (select user_id, min(day) as a, max(day) as b from g group by user_id, g)
        select user_id, string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ',' order by a) as days from r group by 1
    """,
    "hourly_event_counts": "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "user_sessions": """
        with l as (select user_id, ts, event_id, case when ts >= lag(ts) over w + interval 6 hour or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from l)
        select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, s
    """,
    "edited_fields": """
        select c_custkey, 'c_mktsegment' as field, c_mktsegment as before, 'MANUAL' as after from customer where c_custkey % 50 = 0 and c_mktsegment <> 'MANUAL'
        union all select c_custkey, 'c_name', c_name, null from customer where c_custkey % 90 = 0 and c_name is not null
    """,
    "queue_after_failures": """
        select event_id as id, case when event_type <> 'error' then 'processing' when event_id % 4 + 1 >= 3 then 'failed' else 'queued' end as status,
          case when event_type = 'error' and event_id % 4 = 0 then '2024-02-01 00:00:30' when event_type = 'error' and event_id % 4 = 1 then '2024-02-01 00:02:00' else '' end as next_retry from events
    """,
    "plan_synchronisation": """
        with p as (select o_orderkey as k from orders where o_orderdate >= timestamp '1997-01-01'),
        s as (select o_orderkey as k, o_orderstatus = 'P' as gone from orders where o_orderdate < timestamp '1999-01-01')
        select coalesce(p.k, s.k) as unit_key, case when s.k is null then 'insert' when p.k is null then 'supersede' when gone then 'revive' else 'keep' end as action
        from p full join s on p.k = s.k where not (p.k is null and gone)
    """,
    "moved_keys": """
        with k as (select p_brand || '/' || p_type || '/' || p_size as old_key, p_brand || '/' || p_name as new_key from part)
        select old_key, min(new_key) as new_key from k group by 1 having count(distinct new_key) = 1 and min(new_key) <> old_key
    """,
}
