"""What is shown: rollups by section and issue, page ranges, labels, audit sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import island_label, islands


def sections(series: DataFrame) -> DataFrame:
    """Series by group and subgroup: counts, those that need attention, and their keys in the order shown."""
    item = F.struct(F.col("name"), F.col("series_key").alias("key"))
    sub = series.groupBy("group", "subgroup").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "abnormal").alias("abnormal"), F.array_sort(F.collect_list(item)).alias("items"))
    row = F.struct("subgroup", "n", "abnormal", F.transform("items", lambda x: x["key"]).alias("keys"))
    return sub.groupBy("group").agg(F.sum("n").alias("n"), F.sum("abnormal").alias("abnormal"), F.array_sort(F.collect_list(row)).alias("subgroups"))


def issues(unmatched: DataFrame) -> DataFrame:
    """Unmatched names with their units and sections united: ``name, n, units, sections, latest``."""
    return unmatched.groupBy("name").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_set("unit")).alias("units"), F.array_sort(F.collect_set("section_name")).alias("sections"), F.max("latest").alias("latest")
    )


def page_ranges(units: DataFrame, key: str = "unit_id", page: str = "page_number") -> DataFrame:
    """The pages of each unit in short: ``1-3、5``."""
    runs = islands(units, [key], page).withColumn("label", island_label(F.col("first"), F.col("last")))
    ordered = F.array_sort(F.collect_list(F.struct("first", "label")))
    return runs.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["label"]), "、").alias("pages"))


def unit_labels(units: DataFrame) -> DataFrame:
    """A running number for each unit among those of its kind: adds ``label``; supplements come last."""
    w = Window.partitionBy("report_id", "mode").orderBy(F.col("supplement"), "first_page", "unit_index", "unit_id")
    return units.withColumn("label", F.concat_ws(" ", "mode", F.row_number().over(w)))


def job_rollup(attempts: DataFrame, units: DataFrame) -> DataFrame:
    """Extraction of each report in one row: attempts, tokens, seconds, units by state, pages done of all: a page is, once a unit with it is.

    ``attempts``: ``report_id, unit_id, input_tokens, output_tokens, elapsed_ms``; ``units``: ``report_id, unit_id, status, pages`` (array).
    """
    a = attempts.groupBy("report_id").agg(F.count("*").alias("attempts"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.round(F.coalesce(F.sum("elapsed_ms"), F.lit(0)) / 1000, 3).alias("seconds"))
    s = F.col("status")
    u = units.groupBy("report_id").agg(F.count_if(s == "done").alias("done"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("queued", "processing")).alias("open"))
    p = units.select("report_id", (s == "done").alias("d"), F.explode("pages").alias("page")).groupBy("report_id", "page").agg(F.bool_or("d").alias("d"))
    p = p.groupBy("report_id").agg(F.count_if("d").alias("pages_done"), F.count("*").alias("pages"))
    return u.join(p, "report_id", "left").join(a, "report_id", "left").fillna(0, ["attempts", "input_tokens", "output_tokens", "seconds", "pages", "pages_done"])


def usage_summary(sources: DataFrame) -> DataFrame:
    """One row over united sources of model use: calls, failures, tokens, mean seconds; zeros on empty input."""
    calls = F.coalesce(F.nullif("attempts", F.lit(0)), F.lit(1))
    return sources.agg(
        F.coalesce(F.sum(calls), F.lit(0)).alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.round(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)) / 1000, 3).alias("mean_seconds"),
    )


def audit_labels(audit: DataFrame, names: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Audit rows with the names of what their JSON details refer to: one column for each kind of reference.

    ``names`` maps a key in the details to a table of ``id`` and the column of its name.
    """
    out = audit
    for key, (df, column) in names.items():
        ref = F.get_json_object("detail_json", f"$.{key}")
        n = df.select(F.col("id").alias("__id"), F.col(column).alias(f"{key}_name"))
        out = out.withColumn("__ref", ref).join(n, F.col("__ref") == F.col("__id"), "left").drop("__id")
        out = out.withColumn(f"{key}_name", F.coalesce(f"{key}_name", F.when(F.col("__ref").isNotNull(), abbreviated(F.col("__ref"))))).drop("__ref")
    return out


def abbreviated(id_: Column) -> Column:
    return F.when(F.length(id_) <= 12, id_).otherwise(F.concat(F.substring(id_, 1, 6), F.lit("…"), F.substring(id_, -4, 4)))


def audit_sentence(action: Column, parts: list[Column]) -> Column:
    """An action and what is known of it in one line; parts that are null leave no mark."""
    return F.concat_ws(" · ", action, *[F.nullif(F.trim(p), F.lit("")) for p in parts])


# What a log line is about, by its message.
LOG_KINDS = ((r"(?i)ocr|worker", "ocr"), (r"(?i)extract|model|ai[_ ]", "extraction"), (r"(?i)upload|import", "upload"), (r"(?i)backup|restore", "backup"), (r"(?i)migrat|schema|database", "database"), (r"(?i)dictionary", "dictionary"))


def log_kind(message: Column) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, kind in LOG_KINDS:
        out = out.when(message.rlike(pattern), kind)
    return out.otherwise("system")


def log_page(log: DataFrame, level: str | None = None, size: int = 50, after: tuple | None = None) -> DataFrame:
    """A page of a log, the newest first; level ``important`` means warnings and errors."""
    from .listing import after_key

    if level == "important":
        log = log.filter(F.col("level").isin("warn", "error"))
    elif level:
        log = log.filter(F.col("level") == level)
    if after is not None:
        log = log.filter(after_key(F.col("ts"), F.col("id"), *after))
    return log.withColumn("kind", log_kind(F.col("message"))).orderBy(F.col("ts").desc(), F.col("id").desc()).limit(max(1, min(100, size)))


def comparable_series(morphology: DataFrame) -> DataFrame:
    """Pairs of a member's finding series that may be the same: sides don't conflict, organ or type is equal: ``a, b``.

    Blocked by member; conflicting sides are left and right, and a midline against either.
    """
    x, y = morphology.alias("x"), morphology.alias("y")
    c = lambda n: (F.col(f"x.{n}"), F.col(f"y.{n}"))
    side_a, side_b = c("side")
    conflict = (side_a != side_b) & (side_a != "unspecified") & (side_b != "unspecified") & (side_a != "bilateral") & (side_b != "bilateral")
    same = (F.col("x.organ") == F.col("y.organ")) | (F.col("x.type") == F.col("y.type"))
    on = (F.col("x.member_id") == F.col("y.member_id")) & (F.col("x.group_id") < F.col("y.group_id")) & ~conflict & same
    return x.join(y, on).select(F.col("x.group_id").alias("a"), F.col("y.group_id").alias("b"))


def series_name(side: Column, organ: Column, region: Column, kind: Column) -> Column:
    """Side, organ, region and type of a finding as a name, without saying anything twice."""
    said = F.when(side == "left", "左侧").when(side == "right", "右侧").when(side == "bilateral", "双侧").otherwise("")
    place = F.when(F.contains(organ, F.coalesce(region, F.lit(""))) | region.isNull(), organ).otherwise(F.concat(organ, region))
    return F.concat(F.when(F.substring(organ, 1, 1).isin("左", "右", "双"), "").otherwise(said), place, F.when(F.contains(place, kind), "").otherwise(kind))
