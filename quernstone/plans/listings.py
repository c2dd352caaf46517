"""Queries in the shape of record listings: filters, access, pages, latest rows, top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.aggregates import with_counts
from quernstone.operators.listing import keyset_page, latest_per_key, list_filter, top_per_group, visible_to
from quernstone.operators.series import renumber

from .tables import table

DAY = "yyyy-MM-dd HH:mm:ss"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("issued", F.date_format("o_orderdate", DAY))


def keyset_page_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(_orders(spark, sf_dir).select("o_orderkey", "issued"), "issued", "o_orderkey", 30)


def keyset_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first: its cursor is the first page's last row, 30 rows at most."""
    rows = _orders(spark, sf_dir).select("o_orderkey", "issued")
    last = keyset_page(rows, "issued", "o_orderkey", 30).orderBy("issued", "o_orderkey").first()
    return keyset_page(rows, "issued", "o_orderkey", 30, (last.issued, last.o_orderkey))


def dynamic_filter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kept = list_filter(
        rows, equals={"o_orderstatus": "F", "c_mktsegment": None}, differs={"o_orderpriority": "5-LOW"},
        date_column=F.col("issued"), date_from="1996-01-01", date_to="1997-06-30", search=(["c_name", "c_mktsegment"], "BUILD-ING"),
    )
    return kept.select("o_orderkey", "c_name", "c_mktsegment", "issued", "o_orderpriority")


def acl_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the nations that a viewer may see: grants are the nations of a region, the viewer its key."""
    grants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("viewer"))
    return visible_to(table(spark, sf_dir, "customer"), grants, 2, "c_nationkey", "viewer").select("c_custkey", "c_nationkey", "c_acctbal")


def anti_join_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp'2001-05-01'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(lines, "p_partkey", "left_anti").select("p_partkey", "p_brand")


def left_join_filtered_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines only take part in the join; orders without any stay. Counts come first, so nothing fans out."""
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    n = back.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_returned"), F.sum("l_quantity").alias("quantity"))
    out = table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left")
    return out.select("o_orderkey", F.coalesce("n_returned", F.lit(0)).alias("n_returned"), "quantity")


def correlated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    both = with_counts(customers, orders, "c_custkey", "o_custkey", "n_orders")
    return with_counts(both, orders.filter("o_orderstatus = 'F'"), "c_custkey", "o_custkey", "n_final")


def latest_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "ts", "event_type", "value"])


def star_join_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    both = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name", "n_name").agg(F.count("*").alias("n_suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


def overview_topk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest orders of each state, and of those the newest overall."""
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "issued")
    return top_per_group(rows, ["o_orderstatus"], [F.col("issued").desc(), F.col("o_orderkey").desc()], 3, rank="position")


def trend_excluded_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return top_per_group(rows, ["l_partkey"], [F.col("l_shipdate").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc()], 8, rank="position")


def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge of orders older than 30 days before a date would leave, by state."""
    cutoff = F.lit("1999-01-01").cast("timestamp") - F.expr("interval 30 days")
    kept = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") != "F") | (F.col("o_orderdate") >= cutoff))
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"))


def lease_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each job in its queue's order: by type, time and id."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    jobs = table(spark, sf_dir, "events").withColumn("rank", rank)
    return renumber(jobs, ["user_id"], ["rank", "ts", "event_id"], "position").select("user_id", "position", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        keyset_page_1, keyset_page_2, dynamic_filter_list, acl_semi_join, anti_join_unused, left_join_filtered_on, correlated_counts,
        latest_row_per_key, star_join_order, overview_topk_union, trend_excluded_top8, retention_purge, lease_claim_order,
    )
}

_ISSUED = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
_PAGE = f"select o_orderkey, {_ISSUED} as issued from orders order by issued desc nulls last, o_orderkey desc"

SQL = {
    "keyset_page_1": f"{_PAGE} limit 30",
    "keyset_page_2": f"{_PAGE} limit 30 offset 30",
    "dynamic_filter_list": f"""
        select o_orderkey, c_name, c_mktsegment, {_ISSUED} as issued, o_orderpriority
        from orders join customer on o_custkey = c_custkey
        where o_orderstatus = 'F' and o_orderpriority <> '5-LOW' and {_ISSUED} >= '1996-01-01' and {_ISSUED} <= '1997-06-30'
          and (lower(c_name) like '%building%' or lower(c_mktsegment) like '%building%')
    """,
    "acl_semi_join": """
        select c_custkey, c_nationkey, c_acctbal from customer
        where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)
    """,
    "anti_join_unused": """
        select p_partkey, p_brand from part
        where not exists (select 1 from lineitem where l_partkey = p_partkey and l_shipdate >= timestamp '2001-05-01')
    """,
    "left_join_filtered_on": """
        select o_orderkey, count(l_orderkey) as n_returned, sum(l_quantity) as quantity
        from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' group by o_orderkey
    """,
    "correlated_counts": """
        select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders,
               (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as n_final
        from customer
    """,
    "latest_row_per_key": """
        select user_id, event_id, ts, event_type, value from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
    """,
    "star_join_order": """
        select r_name, n_name, count(*) as n_suppliers, round(sum(s_acctbal), 2) as balance
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name
    """,
    "overview_topk_union": f"""
        select o_orderkey, o_orderstatus, {_ISSUED} as issued,
               cast(row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey desc) as integer) as position
        from orders qualify position <= 3
    """,
    "trend_excluded_top8": """
        select l_partkey, l_orderkey, l_linenumber, l_shipdate,
               cast(row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as integer) as position
        from lineitem qualify position <= 8
    """,
    "retention_purge": """
        select o_orderstatus, count(*) as n, min(o_orderdate) as oldest from orders
        where o_orderstatus <> 'F' or o_orderdate >= timestamp '1999-01-01' - interval 30 day group by o_orderstatus
    """,
    "lease_claim_order": """
        select user_id, cast(row_number() over (partition by user_id order by
                 case event_type when 'error' then 0 when 'purchase' then 1 else 2 end, ts, event_id) as integer) as position, event_id, event_type
        from events
    """,
}
