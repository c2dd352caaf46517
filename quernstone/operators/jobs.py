"""The work queue as tables: what may be claimed, retried, resumed, retired or purged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.numeric import retry_delay

# The order in which types of jobs are claimed, and tries that a job has.
PRIORITY = {"pdf_extract": 0, "thumbnail": 1, "ocr": 2, "ai_extract": 3}
MOST_ATTEMPTS = 3


def priority(job_type: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in PRIORITY.items():
        out = out.when(job_type == name, rank)
    return out.otherwise(len(PRIORITY))


def expire_leases(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose lease ran out go back to the queue, or fail after the last try."""
    lost = (F.col("status") == "processing") & (F.col("lease_expires_at") < now)
    spent = F.col("attempts") >= MOST_ATTEMPTS
    status = F.when(lost & spent, "failed").when(lost, "queued").otherwise(F.col("status"))
    return jobs.withColumns({"lease_expires_at": F.when(~lost, F.col("lease_expires_at")), "status": status})


def claimable(jobs: DataFrame, now: Column, lanes: str | None = None) -> DataFrame:
    """Queued jobs that are due, with their place in the queue (of each lane, if there are several)."""
    due = jobs.filter((F.col("status") == "queued") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    w = Window.partitionBy(*([lanes] if lanes else [F.lit(0)])).orderBy(priority(F.col("job_type")), "created_at", "id")
    return due.withColumn("place", F.row_number().over(w))


def claim(jobs: DataFrame, now: Column, n: int = 1, lease_minutes: int = 5) -> DataFrame:
    """The queue after the next ``n`` jobs were claimed: leased, with one try more."""
    free = expire_leases(jobs, now)
    due = free.filter((F.col("status") == "queued") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))
    next_ = due.orderBy(priority(F.col("job_type")), "created_at", "id").limit(n).select(F.col("id").alias("__c"))
    out = free.join(F.broadcast(next_), F.col("id") == F.col("__c"), "left")  # n rows
    mine = F.col("__c").isNotNull()
    return out.withColumns(
        {
            "status": F.when(mine, "processing").otherwise(F.col("status")),
            "attempts": F.col("attempts") + mine.cast("int"),
            "lease_expires_at": F.when(mine, now + F.make_interval(mins=F.lit(lease_minutes))).otherwise(F.col("lease_expires_at")),
        }
    ).drop("__c")


def after_failure(jobs: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """The queue after some jobs (``id``) failed: a delay of 30, 120 or 600 seconds, or the end after the last try."""
    out = jobs.join(failed.select(F.col("id").alias("__f")).distinct(), F.col("id") == F.col("__f"), "left")
    mine, last = F.col("__f").isNotNull(), F.col("attempts") >= MOST_ATTEMPTS
    return out.withColumns(
        {
            "status": F.when(mine & last, "failed").when(mine, "queued").otherwise(F.col("status")),
            "next_retry_at": F.when(mine & ~last, F.timestamp_add("SECOND", retry_delay(F.col("attempts")), now)).otherwise(F.col("next_retry_at")),
            "lease_expires_at": F.when(~mine, F.col("lease_expires_at")),
        }
    ).drop("__f")


def ready_for_extraction(jobs: DataFrame, text: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Reports whose local jobs are all done, that have text, no certain duplicate and no extraction yet: ``report_id``.

    ``text``: ``report_id, text_length``; ``duplicates``: ``report_id, confidence``.
    """
    local, kind, status = F.col("job_type") != "ai_extract", F.col("job_type"), F.col("status")
    state = jobs.groupBy("report_id").agg(
        F.count_if(local & status.isin("queued", "processing")).alias("active"), F.count_if(local & (status == "failed")).alias("failed"),
        F.count_if((kind == "ocr") & (status == "completed")).alias("read"), F.count_if(~local & (status != "cancelled")).alias("asked"),
    )
    ready = state.filter("active = 0 and failed = 0 and read > 0 and asked = 0").select("report_id")
    ready = ready.join(text.groupBy("report_id").agg(F.sum("text_length").alias("n")).filter("n > 0"), "report_id", "left_semi")
    return ready.join(duplicates.filter("confidence = 'high'"), "report_id", "left_anti")


def resumable(units: DataFrame, done: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Units whose stored result still fits (same input and prompt version), and those that are left to do."""
    fits = done.filter(F.col("prompt_version") == version).select("input_hash").distinct()
    return units.join(fits, "input_hash", "left_semi"), units.join(fits, "input_hash", "left_anti")


def sync_units(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """A plan against what is stored: ``unit_key, action`` (insert, keep, revive or supersede)."""
    p, s = planned.select(F.col("unit_key").alias("p")), stored.select(F.col("unit_key").alias("s"), "status")
    both = p.join(s, F.col("p") == F.col("s"), "full_outer")
    action = F.when(F.col("s").isNull(), "insert").when(F.col("p").isNull(), "supersede").when(F.col("status") == "superseded", "revive").otherwise("keep")
    return both.select(F.coalesce("p", "s").alias("unit_key"), action.alias("action"), "status").filter("not (action = 'supersede' and status = 'superseded')").drop("status")


def cancelled_in_flight(jobs: DataFrame, reports: DataFrame, pages: DataFrame) -> DataFrame:
    """Running jobs whose report was trashed or whose page moved to another report: their results are dropped."""
    r, p = reports.select(F.col("id").alias("report_id"), F.col("status").alias("r_status")), pages.select(F.col("id").alias("page_id"), F.col("report_id").alias("now_report"))
    out = jobs.filter("status = 'processing'").join(r, "report_id", "left").join(p, "page_id", "left")
    gone = F.coalesce(F.col("r_status") == "trashed", F.lit(True)) | (F.col("page_id").isNotNull() & ~F.col("now_report").eqNullSafe(F.col("report_id")))
    return out.filter(gone).select("id")


def event_history(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each job; a job without any has one made from its state."""
    seen = events.select("job_id", "event_type", "status", "attempt", "message", "created_at")
    none = jobs.join(events.select(F.col("job_id").alias("id")), "id", "left_anti")
    made = none.select(F.col("id").alias("job_id"), F.lit("snapshot").alias("event_type"), "status", F.col("attempts").alias("attempt"), F.lit(None).cast("string").alias("message"), "created_at")
    return seen.unionByName(made)


def finished_to_drop(tasks: DataFrame, keep: int = 50) -> DataFrame:
    """Finished tasks beyond the newest ``keep`` of their type."""
    w = Window.partitionBy("task_type").orderBy(F.col("finished_at").desc(), F.col("id").desc())
    return tasks.filter("finished_at is not null").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") > keep).drop("__r")


def gc_next(queue: DataFrame, now: Column) -> DataFrame:
    """When a file that couldn't be removed is tried again: after an hour, from the fifth try on after a day."""
    hours = F.when(F.col("attempts") >= 5, 24).otherwise(1)
    return queue.withColumn("next_try_at", now + F.make_interval(hours=hours))


def purgeable(reports: DataFrame, now: Column, days: int = 30, most: int = 50) -> DataFrame:
    """Trashed reports that are due to be purged, oldest first; a batch is limited by design."""
    due = reports.filter((F.col("status") == "trashed") & (F.col("deleted_at").cast("timestamp") < now - F.make_interval(days=F.lit(days))))
    return due.orderBy("deleted_at", "id").limit(most)


def reference_counts(paths: list[tuple[DataFrame, str]]) -> DataFrame:
    """How many rows of several tables refer to each path: ``path, n``."""
    out = None
    for df, column in paths:
        part = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("path"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("path").agg(F.count("*").alias("n"))
