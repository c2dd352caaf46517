"""Queries in the shape of changes: edits, links, pages, reminders, members, the trash, upserts.

Reports are orders, members customers, pages of reports and facts events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import diffs as X
from quernstone.operators import edits as E
from quernstone.operators import jobs as J
from quernstone.operators import reports as P

from .tables import table

NOW = "2024-02-01 00:00:00"
STRINGS = "array<string>"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("processing")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("member_id"), state.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.lit(None).cast("string").alias("deleted_at"),
        F.col("o_orderpriority").alias("title"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return _events(spark, sf_dir).select(i.alias("id"), F.floor(i / 10).alias("report_id"), (i % 10 + 1).cast("int").alias("page_number"), F.concat(F.lit("p/"), i % 700).alias("storage_path"), F.col("value"))


def pins_after_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins are the series of purchases; views of even users toggle them; then some keys move."""
    e = _events(spark, sf_dir).select((F.col("user_id") % 5).alias("user_id"), (F.col("user_id") % 7).alias("member_id"), (F.col("event_id") % 40).cast("string").alias("series_key"), "event_type")
    pins = e.filter("event_type = 'purchase'").drop("event_type").distinct()
    asked = e.filter("event_type = 'view' and user_id % 2 = 0").drop("event_type")
    moved = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("old_key"), (F.col("n_nationkey") % 3).cast("string").alias("new_key"))
    return E.migrate_pins(E.toggle_pins(pins, asked), moved)


def facts_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts; errors edit the value of an earlier fact, signups remove one; the newest edit of a field counts."""
    e = _events(spark, sf_dir)
    facts = e.select(F.col("event_id").alias("fact_id"), F.col("event_type").alias("name"), "value", F.array().cast(STRINGS).alias("manual_fields"), F.lit(False).alias("is_deleted"))
    target = F.floor(F.col("event_id") / 9).alias("fact_id")
    values = e.filter("event_type = 'error'").select(target, F.lit("value").alias("field"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("at"))
    names = e.filter("event_type = 'click'").select(target, F.lit("name").alias("field"), F.concat(F.lit("n"), "user_id").alias("value"), F.col("event_id").alias("at"))
    gone = e.filter("event_type = 'signup'").select(target, F.lit("is_deleted").alias("field"), F.lit("true").alias("value"), F.col("event_id").alias("at"))
    out = E.apply_edits(facts, values.unionByName(names).unionByName(gone), ["name", "value"])
    return out.select("fact_id", "name", "value", F.array_join("manual_fields", ",").alias("manual"), "is_deleted")


def findings_not_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "error", F.array(F.lit("ignored"))).when(F.col("event_type") == "view", F.array(F.lit("value"))).alias("manual_fields"))
    return E.not_ignored(e).select("event_id", F.coalesce(F.size("manual_fields"), F.lit(-1)).alias("n"))


def sections_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of reports of another kind go, unless a person touched them."""
    i = F.col("event_id")
    kind = F.get(F.array(F.lit("checkup_summary"), F.lit("outpatient_plan"), F.lit("inpatient_course"), F.lit("general")), (i % 4).cast("int"))
    sections = _events(spark, sf_dir).select(
        i.alias("id"), F.floor(i / 3).alias("report_id"), kind.alias("section_key"), F.when(i % 5 == 0, "manual").otherwise("ai").alias("source"), F.when(i % 7 == 0, F.array(F.lit("content"))).alias("manual_fields")
    )
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "checkup").when(F.col("o_orderkey") % 3 == 1, "outpatient").otherwise("laboratory").alias("report_type"))
    return E.repair_sections(sections, reports).select("id", "report_id", "section_key")


def events_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of jobs with their unit: by key, else by an index that one unit has."""
    i = F.col("event_id")
    units = _events(spark, sf_dir).filter(i % 4 == 0).select(F.floor(i / 40).alias("job_id"), (i % 40).cast("string").alias("unit_key"), (i % 12).alias("unit_index"), i.alias("unit_id"))
    events = _events(spark, sf_dir).filter(i % 3 == 0).select(i.alias("id"), F.floor(i / 40).alias("job_id"), F.when(i % 2 == 0, (i % 40).cast("string")).alias("unit_key"), (i % 12).alias("unit_index"))
    return E.attach_events(events, units).select("id", F.coalesce("unit_id", F.lit(-1)).alias("unit_id"))


def pages_by_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("page_number"))
    return E.lookup_pages(_pages(spark, sf_dir), wanted).select("id", "report_id", "page_number")


def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of priorities in a fixed order; what isn't listed comes last: its place in the order is given."""
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    rows = E.fixed_order(n, "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"])
    return rows.withColumn("place", F.monotonically_increasing_id()).select("o_orderpriority", "n", F.row_number().over(_by("place")).alias("place"))


def _by(*columns: str):
    from pyspark.sql.window import Window

    return Window.orderBy(*columns)  # of a report of a few rows


def results_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results against the cells that they were read from."""
    i = F.col("event_id")
    cell = F.get(F.array(F.lit(" --"), F.concat(F.lit("<"), F.col("user_id")), F.lit("弱阳性 (+)"), F.lit("见备注"), F.concat(F.lit(" "), F.col("user_id"), F.lit(".5 ↑"))), (i % 5).cast("int"))
    rows = _events(spark, sf_dir).select("event_id", E.corrected_result(F.col("event_type"), cell).alias("result"))
    return rows.select("event_id", F.coalesce("result", F.lit("")).alias("result"))


def members_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members; orders change the segment of some and bring new ones, the newest change counts."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    members = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    changes = o.groupBy((F.col("o_custkey") * 3).alias("id"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderpriority").alias("kind"))
    return E.members_after(members, changes)


def permissions_after_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    p = c.select(F.col("c_custkey").alias("member_id"), F.concat(F.lit("u"), "c_nationkey").alias("user_id"), F.lit("viewer").alias("permission"))
    members = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, NOW).alias("deleted_at"))
    return E.rebind_admin(p, members, "u7")


def pages_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of reports, with as many pages as their quantity says; pages are numbered through."""
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("position")).agg(F.max("l_quantity").cast("int").alias("page_count"))
    pages = P.expand_pages(i)
    return pages.groupBy("report_id").agg(F.count("*").alias("n"), F.max("page_number").alias("last"), F.sum(F.col("page_number").cast("long") * F.col("source_page_number")).alias("check"))


def reports_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).filter("id % 37 <> 5").select("report_id", "page_number", (F.col("id") % 11).cast("int").alias("source_page_number"), F.lit(9).alias("source_page_count"))
    return P.incomplete_files(p)


def pages_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after the report 2 was merged into the report 1, and every 7th page was removed."""
    p = _pages(spark, sf_dir)
    merged = P.merge_reports(p.withColumn("report_id", F.col("report_id").cast("string")), "2", "1")
    return P.without_pages(merged, p.filter("id % 7 = 0")).select("id", "report_id", "page_number")


def reminders_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders that recommendations of reports ask for, where there is none yet."""
    i = F.col("id")
    said = F.get(F.array(F.lit("3个月后复查"), F.lit("10天后复诊"), F.lit(" "), F.lit("请于2025-01-15复查"), F.lit("定期随访")), (i % 5).cast("int"))
    reports = _orders(spark, sf_dir).select("id", said.alias("recommendation"), F.when(i % 2 == 0, F.col("created_at")).alias("report_issued_at"), "created_at")
    reminders = _events(spark, sf_dir).select((F.col("event_id") * 4).alias("report_id"))
    return P.due_reminders(reports, reminders)


def notices_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices for reports whose state changed: those of even members were confirmed, some failed."""
    before = _orders(spark, sf_dir)
    done = P.confirm(before, before.filter("member_id % 2 = 0").select("id"))
    after = done.withColumn("status", F.when(F.col("id") % 13 == 0, "failed").otherwise(F.col("status")))
    return P.notices(before, after)


def reports_in_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders(spark, sf_dir)
    out = P.trash(r, r.filter("member_id % 9 = 0").select("id"), F.lit(NOW).cast("timestamp"))
    return out.groupBy("status", F.coalesce("deleted_at", F.lit("")).alias("deleted_at"), F.coalesce("purge_after", F.lit("")).alias("purge_after")).agg(F.count("*").alias("n"))


def files_to_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nothing needs once the reports of some members are purged, with the rows that are left counted."""
    pages = _pages(spark, sf_dir)
    left, files = P.purge({"report_pages": pages}, pages.filter("report_id % 2 = 0").select(F.col("report_id").alias("id")).distinct())
    return files.select(F.col("path"), F.lit("file").alias("kind")).unionByName(left["report_pages"].groupBy().agg(F.count("*").cast("string").alias("path")).withColumn("kind", F.lit("rows left")))


def progress_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    jobs = _events(spark, sf_dir).select(
        F.floor(i / 8).alias("report_id"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing").alias("status"), (i % 6).alias("units_total"), (i % 3).alias("units_done")
    )
    return P.page_progress(jobs)


def reports_read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of some members are read again: fields that nobody set by hand are cleared."""
    r = _orders(spark, sf_dir).withColumn("manual_fields", F.when(F.col("id") % 3 == 0, F.array(F.lit("title"))))
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.when(F.col("l_linestatus") == "O", "queued").otherwise("completed").alias("status"))
    again, queue = P.reprocess(r, jobs, r.filter("member_id % 4 = 1").select("id"), ["title"])
    cancelled = queue.filter("status = 'cancelled'").groupBy(F.col("report_id").alias("id")).agg(F.count("*").alias("cancelled"))
    return again.join(cancelled, "id", "left").select("id", "status", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("cancelled", F.lit(0)).alias("cancelled"))


def notices_of_a_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 notices that a user's list shows: unread first, then the newest."""
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit("u").alias("user_id"), F.when(F.col("event_type") != "error", F.col("ts")).alias("read_at"), F.col("ts").alias("created_at"))
    return P.notifications(e, "u").select("id")


def rows_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert leaves: the newest event of each user and type."""
    return X.newest_rows(_events(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def rows_inserted_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation's number as new customers, where that number isn't taken: a row for each key."""
    base = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.lit("old").alias("state"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit("new").alias("state"))
    return X.insert_absent(base, new, ["key"])


def derived_rows_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived rows of the reports that were read anew; rows edited by hand stay."""
    old = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 5).alias("report_id"), F.col("event_type").alias("item"), (F.col("event_type") == "signup").alias("manual"))
    new = table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("report_id"), F.col("l_returnflag").alias("item"), F.lit(False).alias("manual"))
    return X.replace_derived(old, new, "report_id", "manual").groupBy("report_id", "item", "manual").agg(F.count("*").alias("n"))


def versions_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps among versions: the days of the year 1999 on which something was ordered by a few customers."""
    o = table(spark, sf_dir, "orders").filter("o_custkey % 40 = 3 and o_orderdate >= timestamp'1999-01-01' and o_orderdate < timestamp'2000-01-01'")
    return X.version_gaps(o.select(F.dayofyear("o_orderdate").alias("version")), "version")


def snapshot_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between two versions of the parts: some gone, some renamed, some new."""
    p = table(spark, sf_dir, "part")
    old, new = p.filter("p_partkey % 11 <> 0"), p.filter("p_partkey % 13 <> 0").withColumn("p_brand", F.when(F.col("p_size") == 7, F.lit(None)).otherwise(F.col("p_brand")))
    return X.snapshot_diff(old, new, "p_partkey", ["p_brand", "p_size"])


def jobs_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose report was trashed or whose page moved."""
    i = F.col("event_id")
    jobs = _events(spark, sf_dir).select(i.alias("id"), F.floor(i / 10).alias("report_id"), F.when(i % 3 != 0, i).alias("page_id"), F.when(F.col("event_type") == "view", "processing").otherwise("queued").alias("status"))
    reports = _orders(spark, sf_dir).select("id", F.when(F.col("id") % 5 == 0, "trashed").otherwise(F.col("status")).alias("status"))
    pages = _pages(spark, sf_dir).select("id", F.when(F.col("id") % 17 == 0, F.col("report_id") + 1).otherwise(F.col("report_id")).alias("report_id"))
    return J.cancelled_in_flight(jobs, reports, pages)


def reports_to_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose local jobs are done, with text, without a certain duplicate or an extraction."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type").isin("error", "signup"), "thumbnail").when(F.col("event_type") == "purchase", "ai_extract").otherwise("ocr")
    state = F.when(i % 19 == 0, "failed").when(i % 23 == 0, "queued").when(i % 29 == 0, "cancelled").otherwise("completed")
    jobs = _events(spark, sf_dir).select(F.floor(i / 4).alias("report_id"), kind.alias("job_type"), state.alias("status"))
    text = _events(spark, sf_dir).select(F.floor(i / 4).alias("report_id"), F.when(i % 5 == 0, F.length("props")).otherwise(0).alias("text_length"))
    same = _orders(spark, sf_dir).select(F.col("id").alias("report_id"), F.when(F.col("id") % 6 == 0, "high").otherwise("medium").alias("confidence"))
    return J.ready_for_extraction(jobs, text, same)


def history_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of orders as jobs; a job without any has one made from its state."""
    jobs = _orders(spark, sf_dir).select("id", "status", F.lit(1).alias("attempts"), "created_at")
    e = _events(spark, sf_dir).select(
        (F.col("event_id") * 3).alias("job_id"), "event_type", F.lit("processing").alias("status"), F.lit(2).alias("attempt"), F.col("props").alias("message"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    )
    return J.event_history(jobs, e).groupBy("event_type", "status", "attempt").agg(F.count("*").alias("n"), F.count("message").alias("with_message"), F.min("created_at").alias("first"))


def units_to_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose stored result still fits, and those left to do."""
    units = _pages(spark, sf_dir).select("id", F.md5("storage_path").alias("input_hash"))
    done = _events(spark, sf_dir).filter("event_type = 'view'").select(F.md5(F.concat(F.lit("p/"), F.col("event_id") % 700)).alias("input_hash"), F.when(F.col("event_id") % 2 == 0, "v2").otherwise("v1").alias("prompt_version"))
    fits, left = J.resumable(units, done, "v2")
    return fits.select("id", F.lit(True).alias("fits")).unionByName(left.select("id", F.lit(False).alias("fits")))


def files_tried_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _events(spark, sf_dir).select("event_id", (F.col("event_id") % 8).alias("attempts"))
    return J.gc_next(q, F.lit(NOW).cast("timestamp")).select("event_id", F.date_format("next_try_at", "yyyy-MM-dd HH:mm:ss").alias("next_try"))


def reports_to_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of 50 trashed reports that a purge takes next."""
    r = _orders(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "trashed").otherwise("ready").alias("status"), F.col("created_at").alias("deleted_at"))
    return J.purgeable(r, F.lit("1999-01-01 00:00:00").cast("timestamp")).select("id")


def finished_tasks_to_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("task_type"), F.when(F.col("user_id") % 3 > 0, F.col("ts")).alias("finished_at"))
    return J.finished_to_drop(t).select("id", "task_type")


QUERIES = {
    f.__name__: f
    for f in (
        pins_after_toggle, facts_after_edits, findings_not_ignored, sections_repaired, events_of_units, pages_by_pairs, orders_by_priority, results_corrected, members_after_changes, permissions_after_restore,
        pages_expanded, reports_incomplete, pages_after_merge, reminders_due, notices_of_changes, reports_in_trash, files_to_remove, progress_of_reports, reports_read_again, notices_of_a_user, rows_upserted,
        rows_inserted_if_absent, derived_rows_replaced, versions_missing, snapshot_of_parts, jobs_cancelled, reports_to_extract, history_of_jobs, units_to_resume, files_tried_again, reports_to_purge, finished_tasks_to_drop,
    )
}

_ORDERS = """r as (select o_orderkey as id, o_custkey as member_id, case o_orderstatus when 'F' then 'ready' when 'O' then 'needs_review' else 'processing' end as status,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as created_at, o_orderpriority as title from orders)"""
_PAGES = "p as (select event_id as id, event_id // 10 as report_id, cast(event_id % 10 + 1 as integer) as page_number, 'p/' || event_id % 700 as storage_path from events)"
_ROLL = "strftime(date_trunc('month', d) + to_months({0}) + to_days(cast(extract('day' from d) - 1 as integer)), '%Y-%m-%d')"

SQL = {
    "pins_after_toggle": """
        with e as (select user_id % 5 as user_id, user_id % 7 as member_id, cast(event_id % 40 as varchar) as series_key, event_type from events),
        p as (select distinct user_id, member_id, series_key from e where event_type = 'purchase'), a as (select distinct user_id, member_id, series_key from e where event_type = 'view' and user_id % 2 = 0),
        t as ((select * from p except select * from a) union all (select * from a except select * from p))
        select distinct user_id, member_id, case when cast(series_key as integer) < 25 then cast(cast(series_key as integer) % 3 as varchar) else series_key end as series_key from t
    """,
    "facts_after_edits": """
        with v as (select event_id // 9 as fact_id, arg_max(cast(event_id as double), event_id) filter (event_type = 'error') as value, arg_max('n' || user_id, event_id) filter (event_type = 'click') as name,
          bool_or(event_type = 'signup') as gone from events where event_type in ('error', 'click', 'signup') group by 1)
        select event_id as fact_id, coalesce(v.name, e.event_type) as name, coalesce(v.value, e.value) as value,
          concat_ws(',', case when gone then 'is_deleted' end, case when v.name is not null then 'name' end, case when v.value is not null then 'value' end) as manual, coalesce(gone, false) as is_deleted
        from events e left join v on fact_id = event_id
    """,
    "findings_not_ignored": "select event_id, case event_type when 'view' then 1 else -1 end as n from events where event_type <> 'error'",
    "sections_repaired": """
        with s as (select event_id as id, event_id // 3 as report_id, ['checkup_summary', 'outpatient_plan', 'inpatient_course', 'general'][event_id % 4 + 1] as section_key, event_id % 5 <> 0 and event_id % 7 <> 0 as loose from events)
        select id, report_id, section_key from s left join orders on o_orderkey = report_id
        where not (loose and o_orderkey is not null and section_key <> 'general' and split_part(section_key, '_', 1) <> case o_orderkey % 3 when 0 then 'checkup' when 1 then 'outpatient' else 'laboratory' end)
    """,
    "events_of_units": """
        with u as (select event_id // 40 as job_id, cast(event_id % 40 as varchar) as unit_key, event_id % 12 as unit_index, event_id as unit_id from events where event_id % 4 = 0),
        s as (select job_id, unit_index, min(unit_id) as unit_id from u group by 1, 2 having count(*) = 1),
        e as (select event_id as id, event_id // 40 as job_id, case when event_id % 2 = 0 then cast(event_id % 40 as varchar) end as unit_key, event_id % 12 as unit_index from events where event_id % 3 = 0)
        select id, coalesce(u.unit_id, s.unit_id, -1) as unit_id from e left join u on u.job_id = e.job_id and u.unit_key = e.unit_key left join s on s.job_id = e.job_id and s.unit_index = e.unit_index
    """,
    "pages_by_pairs": f"with {_PAGES} select id, report_id, page_number from p where exists (select 1 from lineitem where l_orderkey = report_id and l_linenumber = page_number)",
    "orders_by_priority": """
        select o_orderpriority, count(*) as n, cast(row_number() over (order by case o_orderpriority when '5-LOW' then 1 when '1-URGENT' then 2 when '3-MEDIUM' then 3 else 4 end, o_orderpriority) as integer) as place from orders group by 1
    """,
    "results_corrected": "select event_id, [ '', '<' || user_id, '弱阳性', event_type, user_id || '.5' ][event_id % 5 + 1] as result from events",
    "members_after_changes": """
        with c as (select o_custkey * 3 as id, arg_max(p, d) as kind from (select o_custkey, o_orderdate as d, max(o_orderpriority) as p from orders group by 1, 2) group by 1)
        select coalesce(c.id, c_custkey) as id, coalesce(c.kind, c_mktsegment) as kind from customer full join c on c.id = c_custkey
    """,
    "permissions_after_restore": """
        select c_custkey as member_id, 'u' || c_nationkey as user_id, 'viewer' as permission from customer where c_nationkey <> 7 union all select c_custkey, 'u7', 'manager' from customer where c_acctbal >= 0
    """,
    "pages_expanded": """
        with f as (select l_orderkey as report_id, l_linenumber as position, greatest(cast(trunc(max(l_quantity)) as integer), 1) as n from lineitem group by 1, 2),
        b as (select *, coalesce(sum(n) over (partition by report_id order by position rows between unbounded preceding and 1 preceding), 0) as before from f), p as (select report_id, before, unnest(range(1, n + 1)) as s from b)
        select report_id, count(*) as n, cast(max(before + s) as integer) as last, cast(sum((before + s) * s) as bigint) as "check" from p group by 1
    """,
    "reports_incomplete": f"""
        with {_PAGES} select report_id from p where id % 37 <> 5 group by 1 having count(*) <> max(page_number) or count(distinct page_number) <> count(*) or max(id % 11) > 9
    """,
    "pages_after_merge": f"""
        with {_PAGES}, m as (select id, case when report_id = 2 then 1 else report_id end as report_id, case when report_id = 2 then page_number + (select max(page_number) from p where report_id = 1) else page_number end as n from p)
        select id, cast(report_id as varchar) as report_id, cast(row_number() over (partition by report_id order by n, id) as integer) as page_number from m where id % 7 <> 0
    """,
    "reminders_due": f"""
        with {_ORDERS}, s as (select id, cast(substring(created_at, 1, 10) as date) as d, ['3个月后复查', '10天后复诊', null, '请于2025-01-15复查', '定期随访'][id % 5 + 1] as note from r)
        select id as report_id, case id % 5 when 0 then {_ROLL.format(3)} when 1 then strftime(d + interval 10 day, '%Y-%m-%d') when 3 then '2025-01-15' else {_ROLL.format(3)} end as due_date, note from s
        where note is not null and not exists (select 1 from events where event_id * 4 = id)
    """,
    "notices_of_changes": f"""
        with {_ORDERS}, a as (select id, status as was, case when id % 13 = 0 then 'failed' when member_id % 2 = 0 and status = 'needs_review' then 'ready' else status end as now from r)
        select id as report_id, case now when 'failed' then 'processing_failed' when 'ready' then 'filed' end as kind from a where now <> was
    """,
    "reports_in_trash": f"""
        with {_ORDERS} select case when member_id % 9 = 0 then 'trashed' else status end as status, case when member_id % 9 = 0 then '{NOW}' else '' end as deleted_at, case when member_id % 9 = 0 then '2024-03-02 00:00:00' else '' end as purge_after, count(*) as n from r group by all
    """,
    "files_to_remove": f"""
        with {_PAGES} select storage_path as path, 'file' as kind from p group by 1 having bool_and(report_id % 2 = 0) union all select cast(count(*) as varchar), 'rows left' from p where report_id % 2 <> 0
    """,
    "progress_of_reports": """
        select event_id // 8 as report_id, cast(floor(100 * sum(case when event_type in ('purchase', 'error') then 1.0::double when event_id % 6 > 0 then (event_id % 3)::double / (event_id % 6) else 0 end) / count(*) + 0.5) as integer) as percent from events group by 1
    """,
    "reports_read_again": f"""
        with {_ORDERS}, j as (select l_orderkey, count(*) as n from lineitem where l_linestatus = 'O' group by 1)
        select id, case when member_id % 4 = 1 then 'processing' else status end as status, case when member_id % 4 = 1 and id % 3 <> 0 then '' else title end as title, case when member_id % 4 = 1 then coalesce(n, 0) else 0 end as cancelled from r left join j on l_orderkey = id
    """,
    "notices_of_a_user": "select event_id as id from events order by event_type = 'error' desc, ts desc, event_id limit 100",
    "rows_upserted": "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2",
    "rows_inserted_if_absent": """
        with b as (select c_custkey as key from customer where c_custkey % 3 <> 0) select key, 'old' as state from b union all select distinct o_custkey, 'new' from orders where o_custkey not in (select key from b)
    """,
    "derived_rows_replaced": """
        with n as (select l_orderkey as report_id, l_returnflag as item from lineitem where l_orderkey % 2 = 0),
        u as (select event_id // 5 as report_id, event_type as item, event_type = 'signup' as manual from events where event_type = 'signup' or event_id // 5 not in (select report_id from n) union all select report_id, item, false from n)
        select report_id, item, manual, count(*) as n from u group by all
    """,
    "versions_missing": """
        with v as (select distinct cast(dayofyear(o_orderdate) as integer) as version from orders where o_custkey % 40 = 3 and year(o_orderdate) = 1999)
        select version, lag(version) over (order by version) as previous from v qualify version <> previous + 1
    """,
    "snapshot_of_parts": """
        select p_partkey, case when p_partkey % 11 = 0 then 'added' when p_partkey % 13 = 0 then 'removed' else 'updated' end as change from part
        where (p_partkey % 11 = 0) <> (p_partkey % 13 = 0) or (p_partkey % 11 <> 0 and p_partkey % 13 <> 0 and p_size = 7)
    """,
    "jobs_cancelled": """
        select event_id as id from events left join orders on o_orderkey = event_id // 10 where event_type = 'view' and (o_orderkey is null or o_orderkey % 5 = 0 or (event_id % 3 <> 0 and event_id % 17 = 0))
    """,
    "reports_to_extract": """
        with j as (select event_id // 4 as report_id, case when event_type in ('error', 'signup') then 'thumbnail' when event_type = 'purchase' then 'ai_extract' else 'ocr' end as t,
          case when event_id % 19 = 0 then 'failed' when event_id % 23 = 0 then 'queued' when event_id % 29 = 0 then 'cancelled' else 'completed' end as s, case when event_id % 5 = 0 then length(props) else 0 end as n from events)
        select report_id from j group by 1 having count(*) filter (t <> 'ai_extract' and s in ('queued', 'failed')) = 0 and count(*) filter (t = 'ocr' and s = 'completed') > 0
          and count(*) filter (t = 'ai_extract' and s <> 'cancelled') = 0 and sum(n) > 0 and report_id not in (select o_orderkey from orders where o_orderkey % 6 = 0)
    """,
    "history_of_jobs": f"""
        with {_ORDERS}, h as (select event_type, 'processing' as status, 2 as attempt, props as message, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at from events
          union all select 'snapshot', status, 1, null, created_at from r where not exists (select 1 from events where event_id * 3 = id))
        select event_type, status, attempt, count(*) as n, count(message) as with_message, min(created_at) as first from h group by all
    """,
    "units_to_resume": f"with {_PAGES} select id, storage_path in (select 'p/' || event_id % 700 from events where event_type = 'view' and event_id % 2 = 0) as fits from p",
    "files_tried_again": "select event_id, case when event_id % 8 >= 5 then '2024-02-02 00:00:00' else '2024-02-01 01:00:00' end as next_try from events",
    "reports_to_purge": f"with {_ORDERS} select id from r where id % 2 = 0 and created_at < '1998-12-02 00:00:00' order by created_at, id limit 50",
    "finished_tasks_to_drop": """
        select event_id as id, event_type as task_type from events where user_id % 3 > 0 qualify row_number() over (partition by event_type order by ts desc, event_id desc) > 50
    """,
}
