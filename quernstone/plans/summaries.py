"""Queries in the shape of summaries: counts by condition, unions of sources, votes, checks and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.aggregates import counts_where, distinct_list, majority, status_of
from quernstone.operators.diffs import apply_overrides, orphans, reconcile, repeated_keys, snapshot_diff, union_all

from .tables import table


def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over orders and their lines. Lines are summed up for each order first: no fan-out, no distinct counts."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_if(F.col("n") > 0).alias("with_lines"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
        F.count_if(F.col("r") > 0).alias("with_returns"),
        F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.coalesce("r", F.lit(0)) > 0)).alias("urgent_returns"),
        F.max("o_orderdate").alias("latest"),
    )


def job_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderstatus")
    return counts_where(table(spark, sf_dir, "orders"), {"n_f": o == "F", "n_o": o == "O", "n_p": o == "P", "n_other": ~o.isin("F", "O", "P")}, ["o_orderpriority"])


def report_status_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, flag = F.col("l_linestatus"), F.col("l_returnflag")
    jobs = counts_where(table(spark, sf_dir, "lineitem"), {"failed": (flag == "R") & (status == "F"), "active": status == "O"}, ["l_orderkey"])
    return jobs.select("l_orderkey", status_of(jobs).alias("status"))


def audit_union_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("origin"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("amount"))
    orders = table(spark, sf_dir, "orders").select(F.lit("order").alias("origin"), (F.col("o_orderstatus") == "P").alias("failed"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("priority"))
    return union_all([events, orders]).groupBy("origin").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("n_failed"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total"),
        F.round(F.avg("amount"), 4).alias("mean"), F.count("priority").alias("n_priority"),
    )


def issue_pool_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent names after cleaning, with their latest occurrence: a report, so it is limited."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    name = F.regexp_replace(F.lower("p_name"), r"[^a-z]+", " ")
    pool = table(spark, sf_dir, "part").select("p_partkey", F.trim(name).alias("name")).join(lines, F.col("p_partkey") == F.col("l_partkey"))
    return pool.groupBy("name").agg(F.sum("n").alias("n"), F.max("last").alias("last_seen")).orderBy(F.col("n").desc(), "name").limit(100)


def distinct_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_suppkey", "p_brand").distinct().join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = rows.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return distinct_list(named, ["n_name"], "p_brand", "brands")


def placement_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return majority(rows, ["c_mktsegment"], "o_orderpriority", "o_totalprice", "priority")


def snapshot_diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of customers: by the orders before 1998, and before 1999."""
    orders = table(spark, sf_dir, "orders")

    def at(year: int) -> DataFrame:
        past = orders.filter(F.col("o_orderdate") < F.make_date(F.lit(year), F.lit(1), F.lit(1)))
        return past.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"))

    return snapshot_diff(at(1998), at(1999), "o_custkey", ["n", "last_order"])


def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listed, with the number of their lines before 1998, against what all lines show."""
    lines = table(spark, sf_dir, "lineitem")
    listed = lines.filter("l_shipdate < timestamp'1998-01-01' and l_partkey % 7 <> 3").groupBy("l_partkey").agg(F.count("*").alias("n"))
    found = lines.filter("l_partkey % 11 <> 5").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return reconcile(listed, found, "l_partkey", "n")


def json_prop_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("99999")).cast("int")
    rows = table(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


def override_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with manual values for some: every 50th has a segment, every 70th a balance."""
    c = table(spark, sf_dir, "customer")
    segment = c.filter("c_custkey % 50 = 0").select("c_custkey", F.lit("c_mktsegment").alias("field"), F.lit("MANUAL").alias("value"), F.col("c_custkey").alias("at"))
    balance = c.filter("c_custkey % 70 = 0").select("c_custkey", F.lit("c_acctbal").alias("field"), F.lit("0.5").alias("value"), F.col("c_custkey").alias("at"))
    return apply_overrides(c, segment.unionByName(balance), "c_custkey", ["c_mktsegment", "c_acctbal"]).select("c_custkey", "c_mktsegment", "c_acctbal")


def integrity_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return union_all([
        orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey", "lineitem.order"),
        orphans(t("lineitem"), t("part"), "l_partkey", "p_partkey", "lineitem.part"),
        orphans(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders.customer"),
        orphans(t("customer"), t("nation"), "c_nationkey", "n_nationkey", "customer.nation"),
        orphans(t("labels"), t("documents"), "doc_id", "doc_id", "labels.document"),
    ])


def duplicate_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"], "events": ["event_id"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"]}
    return union_all([repeated_keys(table(spark, sf_dir, t), k, t) for t, k in keys.items()])


def quality_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


def turn_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, size = F.col("role"), F.length(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(role == "user").alias("user_turns"), F.sum(size).alias("chars"),
        F.coalesce(F.max(F.when(role == "assistant", size)), F.lit(0)).alias("longest_answer"), F.bool_or(role == "system").alias("has_system"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        archive_summary, job_status_pivot, report_status_derivation, audit_union_summary, issue_pool_top100, distinct_concat, placement_vote,
        snapshot_diff_orders, manifest_reconcile, json_prop_extract, override_apply, integrity_fk, duplicate_key_check, quality_vs_label, turn_rollup,
    )
}

SQL = {
    "archive_summary": """
        with l as (select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1)
        select count(*) as orders, count(*) filter (o_orderstatus = 'P') as pending, count(*) filter (n > 0) as with_lines,
          cast(coalesce(sum(n), 0) as bigint) as lines, count(*) filter (r > 0) as with_returns,
          count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH') and r > 0) as urgent_returns, max(o_orderdate) as latest
        from orders left join l on l_orderkey = o_orderkey
    """,
    "job_status_pivot": """
        select o_orderpriority, count(*) filter (o_orderstatus = 'F') as n_f, count(*) filter (o_orderstatus = 'O') as n_o,
          count(*) filter (o_orderstatus = 'P') as n_p, count(*) filter (o_orderstatus not in ('F', 'O', 'P')) as n_other
        from orders group by 1
    """,
    "report_status_derivation": """
        select l_orderkey, case when count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') > 0 then 'failed'
          when count(*) filter (l_linestatus = 'O') > 0 then 'processing' else 'needs_review' end as status
        from lineitem group by 1
    """,
    "audit_union_summary": """
        with u as (select 'event' as origin, event_type = 'error' as failed, value as amount, null as priority from events
          union all select 'order', o_orderstatus = 'P', o_totalprice, o_orderpriority from orders)
        select origin, count(*) as n, count(*) filter (failed) as n_failed, round(coalesce(sum(amount), 0), 2) as total,
          round(avg(amount), 4) as mean, count(priority) as n_priority from u group by 1
    """,
    "issue_pool_top100": """
        select trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')) as name, count(*) as n, max(l_shipdate) as last_seen
        from part join lineitem on l_partkey = p_partkey group by 1 order by n desc, name limit 100
    """,
    "distinct_concat": """
        select n_name, array_to_string(list_sort(list(distinct p_brand)), ',') as brands
        from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        where p_brand is not null group by 1
    """,
    "placement_vote": """
        with v as (select c_mktsegment, o_orderpriority as priority, count(*) as votes, max(o_totalprice) as w
          from orders join customer on o_custkey = c_custkey group by 1, 2)
        select c_mktsegment, priority, votes from v
        qualify row_number() over (partition by c_mktsegment order by votes desc, w desc, priority) = 1
    """,
    "snapshot_diff_orders": """
        with a as (select o_custkey as k, count(*) as n, max(o_orderkey) as m from orders where o_orderdate < date '1998-01-01' group by 1),
             b as (select o_custkey as k, count(*) as n, max(o_orderkey) as m from orders where o_orderdate < date '1999-01-01' group by 1)
        select coalesce(a.k, b.k) as o_custkey, case when a.k is null then 'added' when b.k is null then 'removed' else 'updated' end as change
        from a full join b on a.k = b.k where a.k is null or b.k is null or a.n <> b.n or a.m <> b.m
    """,
    "manifest_reconcile": """
        with a as (select l_partkey as k, count(*) as n from lineitem where l_shipdate < timestamp '1998-01-01' and l_partkey % 7 <> 3 group by 1),
             b as (select l_partkey as k, count(*) as n from lineitem where l_partkey % 11 <> 5 group by 1)
        select coalesce(a.k, b.k) as l_partkey, case when b.k is null then 'missing' when a.k is null then 'extra' else 'mismatched' end as state
        from a full join b on a.k = b.k where a.k is null or b.k is null or a.n <> b.n
    """,
    "json_prop_extract": """
        with e as (select event_type, cast(json_extract_string(props, '$.k') as integer) as k from events)
        select event_type, count(k) as n, cast(sum(k) as bigint) as total, max(k) as top from e group by 1
    """,
    "override_apply": """
        select c_custkey, case when c_custkey % 50 = 0 then 'MANUAL' else c_mktsegment end as c_mktsegment,
          case when c_custkey % 70 = 0 then 0.5 else c_acctbal end as c_acctbal from customer
    """,
    "integrity_fk": """
        select 'lineitem.order' as "check", count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders)
        union all select 'lineitem.part', count(*) from lineitem where l_partkey not in (select p_partkey from part)
        union all select 'orders.customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
        union all select 'customer.nation', count(*) from customer where c_nationkey not in (select n_nationkey from nation)
        union all select 'labels.document', count(*) from labels where doc_id not in (select doc_id from documents)
    """,
    "duplicate_key_check": """
        with k as (
          select 'orders' as c, cast(o_orderkey as varchar) as k from orders
          union all select 'lineitem', l_orderkey || '/' || l_linenumber from lineitem
          union all select 'part', cast(p_partkey as varchar) from part
          union all select 'events', cast(event_id as varchar) from events
          union all select 'documents', cast(doc_id as varchar) from documents
          union all select 'conversations', conv_id || '/' || turn from conversations
        ), d as (select c, k, count(*) as n from k group by 1, 2)
        select c as "check", count(*) filter (n > 1) as n from d group by 1
    """,
    "quality_vs_label": "select lang, quality, toxic, count(*) as n from documents join labels using (doc_id) group by 1, 2, 3",
    "turn_rollup": """
        select conv_id, count(*) as turns, count(*) filter (role = 'user') as user_turns, cast(sum(length(coalesce(text, ''))) as bigint) as chars,
          coalesce(max(case when role = 'assistant' then length(coalesce(text, '')) end), 0) as longest_answer, bool_or(role = 'system') as has_system
        from conversations group by 1
    """,
}
