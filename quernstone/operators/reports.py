"""Reports: what is shown of them, what state they are in, and how pages, reminders and notices follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.dates import follow_up_date
from quernstone.functions.text import content_key

# Titles that say nothing of a report.
GENERIC_TITLES = ("健康报告", "检查报告", "检验报告", "体检报告", "医疗报告", "报告", "报告单", "未命名报告")
#: Pages that one file may have.
MOST_PAGES = 500


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def display_department(performing: Column, visit: Column, reporting: Column, ordering: Column, report_type: Column) -> Column:
    """The first department that is known; a checkup without one is a general checkup."""
    return F.coalesce(performing, visit, reporting, ordering, F.when(report_type == "checkup", "综合体检"))


def is_generic_title(title: Column) -> Column:
    t = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", "")
    return (t == "") | t.isin(*GENERIC_TITLES)


def similar_title(a: Column, b: Column, least: int = 8) -> Column:
    """Equal titles, or one within the other when both have ``least`` characters or more; titles that say nothing are like none."""
    x, y = content_key(a), content_key(b)
    within = (F.least(F.length(x), F.length(y)) >= least) & (F.contains(x, y) | F.contains(y, x))
    return (x != "") & ~is_generic_title(a) & ~is_generic_title(b) & ((x == y) | within)


def report_title(title: Column, report_type: Column, subtype: Column, body_part: Column, department: Column, section: Column, observation: Column, ward: Column, medication: Column, vaccine: Column) -> Column:
    """A title that says something: the report's own, or one made for its type; 80 characters at most."""
    join = lambda *parts: F.concat_ws("", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    subject = F.coalesce(subtype, section, observation)
    lab = F.when(subject.rlike("(检验|检查)$"), F.concat(subject, F.lit("报告"))).when(subject.rlike("报告$"), subject).otherwise(join(subject, "检验报告"))
    made = (
        F.when(report_type == "checkup", join(F.coalesce(subtype, F.lit("综合")), "体检报告"))
        .when(report_type == "laboratory", lab)
        .when(report_type == "imaging", join(body_part, F.coalesce(subtype, F.lit("影像")), "报告"))
        .when(report_type == "functional", join(F.coalesce(body_part, subtype), "功能检查报告"))
        .when(report_type == "pathology", join(body_part, "病理报告"))
        .when(report_type == "outpatient", join(department, "门诊记录"))
        .when(report_type == "inpatient", join(F.coalesce(ward, department), "住院记录"))
        .when(report_type == "prescription", join(F.coalesce(medication, department), "处方"))
        .when(report_type == "billing", F.lit("医疗票据"))
        .when(report_type == "vaccination", join(F.coalesce(vaccine, observation), "接种记录"))
        .otherwise(F.coalesce(subtype, title, F.lit("健康报告")))
    )
    return F.substring(F.when(is_generic_title(title), made).otherwise(title), 1, 80)


def expand_pages(files: DataFrame) -> DataFrame:
    """One row for each page of a file: ``report_id, page_number, source_page_number, source_page_count``.

    ``files``: ``report_id, position, page_count`` (1 to 500). Pages of a report are numbered through in the order of its files; the
    offset is a sum over files, so no page is a row of any window.
    """
    n = F.least(F.greatest("page_count", F.lit(1)), F.lit(MOST_PAGES))
    before = F.coalesce(F.sum(n).over(Window.partitionBy("report_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumn("__before", before).select("report_id", "position", "__before", n.alias("source_page_count"))
    pages = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("source_page_count"))).alias("source_page_number"))
    return pages.select("report_id", (F.col("__before") + F.col("source_page_number")).cast("int").alias("page_number"), "source_page_number", "source_page_count")


def incomplete_files(pages: DataFrame) -> DataFrame:
    """Reports that lack pages of a file, or whose page numbers have gaps: ``report_id``."""
    w = pages.groupBy("report_id").agg(F.count("*").alias("n"), F.max("page_number").alias("last"), F.count_distinct("page_number").alias("d"), F.max(F.col("source_page_number") > F.col("source_page_count")).alias("odd"))
    return w.filter("n <> last or d <> n or odd").select("report_id")


def merge_reports(pages: DataFrame, source: str, target: str) -> DataFrame:
    """Pages after the source report was merged into the target: its pages come behind the target's."""
    last = pages.filter(F.col("report_id") == target).agg(F.coalesce(F.max("page_number"), F.lit(0))).first()[0]
    moved = F.col("report_id") == source
    number = F.when(moved, F.col("page_number") + F.lit(last)).otherwise(F.col("page_number"))
    return pages.withColumns({"page_number": number, "report_id": F.when(moved, target).otherwise(F.col("report_id"))})


def without_pages(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Pages that are left when some are removed (``id``), numbered anew."""
    left = pages.join(removed.select("id"), "id", "left_anti")
    return left.withColumn("page_number", F.row_number().over(Window.partitionBy("report_id").orderBy("page_number", "id")))


def due_reminders(reports: DataFrame, reminders: DataFrame) -> DataFrame:
    """Reminders for recommendations that have none yet: ``report_id, due_date, note``."""
    said = reports.filter(blank_to_null(F.col("recommendation")).isNotNull()).join(reminders.select(F.col("report_id").alias("id")), "id", "left_anti")
    issued = F.to_date(F.substring(F.coalesce("report_issued_at", "created_at"), 1, 10))
    return said.select(F.col("id").alias("report_id"), follow_up_date(F.col("recommendation"), issued).alias("due_date"), F.substring("recommendation", 1, 500).alias("note"))


def notices(before: DataFrame, after: DataFrame) -> DataFrame:
    """Notices for reports whose status changed into one that is worth telling: ``report_id, kind``."""
    o, n = before.select("id", F.col("status").alias("was")), after.select("id", "status")
    both = n.join(o, "id", "left").filter(~F.col("was").eqNullSafe(F.col("status")))
    kind = F.when(F.col("status") == "needs_review", "ready_for_review").when(F.col("status") == "failed", "processing_failed").when(F.col("status") == "ready", "filed")
    return both.select(F.col("id").alias("report_id"), kind.alias("kind")).filter("kind is not null")


def trash(reports: DataFrame, ids: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Move reports to the trash; they are purged after some days."""
    out = reports.join(ids.select(F.col("id").alias("__t")).distinct(), F.col("id") == F.col("__t"), "left")
    mine = F.col("__t").isNotNull()
    return out.withColumns({"status": F.when(mine, "trashed").otherwise(F.col("status")), "deleted_at": F.when(mine, now.cast("string")).otherwise(F.col("deleted_at")), "purge_after": F.when(mine, (now + F.make_interval(days=F.lit(days))).cast("string"))}).drop("__t")


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of purged reports (``id``), and the files that nothing needs any more: ``path``."""
    ids = gone.select(F.col("id").alias("report_id"))
    left = {name: df.join(ids, "report_id", "left_anti") for name, df in tables.items()}
    pages = tables["report_pages"]
    files = pages.join(ids, "report_id", "left_semi").select(F.col("storage_path").alias("path")).distinct()
    return left, files.join(left["report_pages"].select(F.col("storage_path").alias("path")), "path", "left_anti")


def page_progress(jobs: DataFrame) -> DataFrame:
    """How far each report is, in percent: completed jobs, running extractions by their finished units."""
    part = F.when(F.col("status").isin("completed", "failed", "cancelled"), 1.0).when(F.col("units_total") > 0, F.col("units_done") / F.col("units_total")).otherwise(0.0)
    return jobs.groupBy("report_id").agg(F.floor(100 * F.sum(part) / F.count("*") + 0.5).cast("int").alias("percent"))


# Names of report types, which a model may put where data belongs.
INTERNAL_TOKENS = ("checkup", "laboratory", "imaging", "functional", "pathology", "outpatient", "inpatient", "prescription", "billing", "vaccination", "other", "unknown", "null", "none")


def meaningful(text: Column) -> Column:
    """A text, unless it is blank or one of the engine's own names."""
    t = blank_to_null(text)
    return F.when(~F.regexp_replace(F.lower(t), r"[\s_-]", "").isin(*INTERNAL_TOKENS), t)


def shown_body_part(report_type: Column, subtype: Column, body_part: Column, department: Column, section: Column, observation: Column, ward: Column) -> Column:
    """What a report is of, for its card: by its type, from what is known of it."""
    s = meaningful(subtype)
    return (
        F.when(report_type == "checkup", F.coalesce(s, F.lit("综合体检")))
        .when(report_type == "laboratory", F.coalesce(s, section, observation, F.lit("检验项目")))
        .when(report_type == "functional", F.coalesce(body_part, s, F.lit("功能检查")))
        .when(report_type == "pathology", F.coalesce(body_part, s, F.lit("病理标本")))
        .when(report_type == "outpatient", F.coalesce(department, F.lit("门诊")))
        .when(report_type == "inpatient", F.coalesce(ward, department, F.lit("住院")))
        .when(report_type == "prescription", F.lit("用药"))
        .when(report_type == "billing", F.lit("费用"))
        .when(report_type == "vaccination", F.coalesce(observation, F.lit("疫苗接种")))
        .otherwise(s)
    )


def reprocess(reports: DataFrame, jobs: DataFrame, ids: DataFrame, columns: list[str], manual: str = "manual_fields") -> tuple[DataFrame, DataFrame]:
    """Reports and jobs after some reports (``id``) are to be read again: fields that nobody set by hand are cleared, queued jobs cancelled."""
    once = ids.select(F.col("id").alias("__r")).distinct()
    r = reports.join(once, F.col("id") == F.col("__r"), "left")
    again = F.col("__r").isNotNull()
    locked = lambda c: F.coalesce(F.array_contains(manual, c), F.lit(False))
    made = {c: F.when(again & ~locked(c), F.lit(None)).otherwise(F.col(c)) for c in columns} | {"status": F.when(again, "processing").otherwise(F.col("status"))}
    waits = F.coalesce(F.col("status") == "queued", F.lit(False))  # other jobs stay as they are and meet no report
    j = jobs.filter(waits).join(once, F.col("report_id") == F.col("__r"), "left")
    j = j.withColumn("status", F.when(F.col("__r").isNotNull(), "cancelled").otherwise("queued")).drop("__r")
    j = j.unionByName(jobs.filter(~waits))
    return r.select(*[made.get(c, F.col(c)).alias(c) for c in reports.columns]), j


def confirm(reports: DataFrame, ids: DataFrame) -> DataFrame:
    """Reports after some that waited for review were confirmed."""
    out = reports.join(ids.select(F.col("id").alias("__r")).distinct(), F.col("id") == F.col("__r"), "left")
    return out.withColumn("status", F.when(F.col("__r").isNotNull() & (F.col("status") == "needs_review"), "ready").otherwise(F.col("status"))).drop("__r")


def notifications(rows: DataFrame, user: str, most: int = 100) -> DataFrame:
    """A user's notices, unread first, then the newest; a list is limited by design."""
    return rows.filter(F.col("user_id") == user).orderBy(F.col("read_at").isNull().desc(), F.col("created_at").desc(), "id").limit(most)
