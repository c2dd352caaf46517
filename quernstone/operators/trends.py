"""Series operators: one series for each combination of keys, points ordered by time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.numeric import attention

from .listing import top_per_group
from .series import drop_near_points, drop_repeated_points


def series_summary(points: DataFrame, keys: list[str], time: str, value: str, tie: str) -> DataFrame:
    """Count, first and last time, latest and previous value, change, and range of each series.

    Counts and range are one hash aggregate. The two newest points are a ranking, of which each task passes on two rows
    for each series, so a series with a third of all points is no burden on any. Points without a value are left out.
    """
    used = points.filter(F.col(value).isNotNull())
    stats = used.groupBy(*keys).agg(
        F.count("*").alias("point_count"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.min(value).alias("min_value"), F.max(value).alias("max_value")
    )
    newest = _newest_two(used, keys, [F.col(time), F.col(tie)], {"value": F.col(value)})
    latest, previous = F.col("new.value"), F.col("old.value")
    return _beside(stats, newest, keys).select(
        *keys, "point_count", "first_ts", "last_ts",
        latest.alias("latest_value"), previous.alias("previous_value"), F.round(latest - previous, 6).alias("delta"),
        "min_value", "max_value",
    )


def _newest_two(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``new`` and ``old`` of each group: structs of values of its last and last but one row."""
    made = df.select(*keys, F.struct(*[v.alias(c) for c, v in values.items()]).alias("__v"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__o"))
    top = top_per_group(made, keys, [F.col("__o").desc()], 2, rank="__r")
    return top.groupBy(*keys).agg(F.max(F.when(F.col("__r") == 1, F.col("__v"))).alias("new"), F.max(F.when(F.col("__r") == 2, F.col("__v"))).alias("old"))


def _beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two tables of one row for each key; null keys meet too."""
    other = b.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return a.join(other, reduce(lambda x, y: x & y, on)).drop(*[f"__k{i}" for i in range(len(keys))])


def trend_points(observations: DataFrame, normalizations: DataFrame, reports: DataFrame) -> DataFrame:
    """Observations with their canonical key, value and unit, their report's date, and why one is left out of trends.

    Only high and medium matches are used; a lower one is kept as a raw name. Trashed reports are left out.
    """
    r = reports.filter("status <> 'trashed'").select(F.col("id").alias("report_id"), "member_id", "status", F.coalesce("report_issued_at", "examined_at", "created_at").alias("sort_date"))
    n = normalizations.select(F.col("id"), "canonical_key", "display_name", "canonical_value", "canonical_unit", "quality", "excluded_reason")
    out = observations.join(r, "report_id").join(n, "id", "left")
    sure = F.coalesce(F.col("quality").isin("high", "medium"), F.lit(False))
    reason = F.when(F.col("quality") == "excluded", F.coalesce("excluded_reason", F.lit("excluded"))).when(~sure, "uncertain_match").when(F.coalesce("canonical_value", "numeric_value").isNull(), "no_number")
    return out.select(
        "id", "report_id", "member_id", "status", "sort_date", "item_name", "reference_low", "reference_high", "abnormal_flag",
        F.when(sure, F.col("canonical_key")).alias("series_key"), F.coalesce(F.when(sure, F.col("display_name")), "item_name").alias("series_name"),
        F.when(sure, F.coalesce("canonical_value", "numeric_value")).alias("value"), F.when(sure, F.coalesce("canonical_unit", "unit")).alias("series_unit"), "quality", reason.alias("left_out"),
    )


def trend_series(points: DataFrame, same: Column | None = None, most_left_out: int = 8, most_names: int = 8) -> DataFrame:
    """Series of a member by key and unit: counts, dates, latest and previous value, range, names, attention, points left out.

    Repeated points are dropped first: equal day and value by default, or by any condition ``same`` between aliases ``p`` and
    an earlier ``o``. The first in the order of date, filed reports, match quality and ids stays. Each day of a series is
    summed up before the series is, so a long one is no single task's sort.
    """
    keys = ["member_id", "series_key", "series_unit"]
    used = points.filter("left_out is null and series_key is not null").withColumns({
        "__day": F.substring("sort_date", 1, 10),
        "__at": F.struct("sort_date", F.when(F.col("status") == "ready", 0).otherwise(1).alias("filed"), F.when(F.col("quality") == "high", 0).otherwise(1).alias("sure"), "report_id", "id"),
    })
    if same is not None:
        kept = drop_repeated_points(used, keys, "__at", same)
    else:
        kept = drop_near_points(used.withColumn("__dated", F.when(F.col("__day").isNotNull(), F.col("value"))), [*keys, "__day"], "__dated", "__at", 1e-9)
    a = attention(F.col("value"), F.col("reference_low"), F.col("reference_high"), F.col("abnormal_flag"))
    newest = F.row_number().over(Window.partitionBy(*keys, "__day").orderBy(F.col("__at").desc()))
    at = lambda n: F.max(F.when(F.col("__d") == n, F.struct("value", "__a", "series_name")))
    names = lambda c: F.slice(F.array_sort(c), 1, most_names).alias("names")
    days = kept.withColumn("__d", newest).withColumn("__a", F.struct(a["level"].alias("level"), a["boundary"].alias("boundary"))).groupBy(*keys, "__day").agg(
        at(1).alias("new"), at(2).alias("old"), F.count("*").alias("point_count"), F.min("sort_date").alias("first_date"), F.max("sort_date").alias("last_date"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        names(F.collect_set("item_name")),
    )
    last = Window.partitionBy(*keys).orderBy(F.col("__day").desc())
    days = days.withColumns({"__d": F.row_number().over(last), "old": F.coalesce("old", F.lead("new").over(last))})
    of_last = lambda c: F.max(F.when(F.col("__d") == 1, F.col(c))).alias(c)
    out = days.groupBy(*keys).agg(
        of_last("new"), of_last("old"), F.sum("point_count").alias("point_count"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        names(F.array_distinct(F.flatten(F.collect_list("names")))),
    )
    new, old = F.col("new"), F.col("old")
    out = out.select(
        *keys, new["series_name"].alias("name"), "point_count", "first_date", "last_date", new["value"].alias("latest_value"), old["value"].alias("previous_value"), F.round(new["value"] - old["value"], 6).alias("delta"),
        "min_value", "max_value", "names", new["__a"]["level"].alias("level"), new["__a"]["boundary"].alias("boundary"),
    )
    lost = points.filter("left_out is not null")
    newest = Window.partitionBy("member_id", "item_name").orderBy(F.col("sort_date").desc(), "id")
    lost = lost.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= most_left_out)
    by_name = lost.groupBy(F.col("member_id").alias("__m"), F.col("item_name").alias("__n")).agg(F.array_sort(F.collect_list(F.struct("sort_date", "id", "left_out"))).alias("left_out"))
    return out.join(by_name, (F.col("member_id") == F.col("__m")) & (F.col("name") == F.col("__n")), "left").drop("__m", "__n")


def in_shown_order(series: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Series with several points first, the newest first, then by name in pinyin order.

    With ``names``, by their order instead; names that it lacks come behind.
    """
    by_name = F.collate("name", "zh") if names is None else F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("name")), F.lit(0)).asc_nulls_last()
    return series.orderBy((F.col("point_count") > 1).desc(), F.col("last_date").desc(), by_name, "series_key")
