"""Order-dependent operators over series: first-wins duplicates, carry-forward, islands, changes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_wins(df: DataFrame, keys: list[str], priority: list[Column]) -> DataFrame:
    """One row for each combination of keys: the first in the order of ``priority``.

    An aggregate of structs rather than a window: copies combine before the shuffle.
    """
    names = df.columns
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(priority)])
    best = F.min_by(F.struct(*names), rank).alias("__b")
    out = df.groupBy(*keys).agg(best)
    return out.select(*[c if c in keys else F.col(f"__b.{c}").alias(c) for c in names])


def drop_repeated_points(points: DataFrame, series: list[str], rank: str, same: Column) -> DataFrame:
    """Drop points that repeat an earlier one of their series, dropped or not, by any rule ``same``.

    ``same`` is a condition between aliases ``p`` (a point) and ``o`` (an earlier one). Every
    earlier point counts, so the outcome doesn't depend on the order of dropping.
    """
    p, o = points.alias("p"), points.alias("o")
    match = [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in series] + [F.col(f"o.{rank}") < F.col(f"p.{rank}"), same]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return p.join(o, cond, "left_anti").select("p.*")


def drop_near_points(points: DataFrame, series: list[str], value: str, order: str, apart: float) -> DataFrame:
    """Drop points whose value lies less than ``apart`` from that of an earlier one of their series, dropped or not.

    As ``drop_repeated_points`` with that rule, but no two points of a series are compared unless they are about that near.
    ``order`` is a column that tells all points of a series apart; points without a finite value stay. Copies of a value
    are folded first. Values are dealt into cells narrower than ``apart``, of which only the first point can stay; it goes
    if an earlier point in one of the two cells on either side is near enough, so each point meets at most five others.
    """
    width = 2.0 ** (math.ceil(math.log2(apart)) - 1)  # a power of two, so that no cell is off by rounding
    v, row, no = F.col("__v"), [c for c in points.columns if c not in series], lambda c: F.coalesce(c, F.lit(False))
    lone = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == math.inf)
    once = points.withColumns({"__v": F.col(value).cast("double"), "__lone": F.when(lone, F.col(order))})
    once = once.groupBy(*series, "__lone", "__v").agg(F.min_by(F.struct(*row), F.col(order)).alias("__row"), F.min(order).alias("__at"))
    by_value = Window.partitionBy(*series).orderBy("__v")
    near = no(v - F.lag("__v").over(by_value) < apart) | no(F.lead("__v").over(by_value) - v < apart)
    cell = F.when(F.abs(v) < 2.0**53 * width, F.rint(v / width) * width).otherwise(v)
    around = F.array_distinct(F.array(*[F.col("__cell") + k * width for k in (0, -2, -1, 1, 2)]))
    dealt = once.withColumns({"__near": near, "__cell": cell}).withColumn("__in", F.explode(F.when(F.col("__near"), around).otherwise(F.array("__cell"))))
    dealt = dealt.withColumn("__guest", ~F.col("__in").eqNullSafe(F.col("__cell")))
    first = F.first(F.struct("__at", "__v")).over(Window.partitionBy(*series, "__lone", "__in").orderBy("__guest", "__at"))
    dealt = dealt.withColumn("__first", first)
    hit = F.col("__guest") & (F.col("__at") < F.col("__first.__at")) & (F.abs(v - F.col("__first.__v")) < apart)
    kept = dealt.groupBy(*series, "__lone", "__in").agg(F.min_by(F.struct("__guest", "__row"), F.struct("__guest", "__at")).alias("__b"), F.max(no(hit)).alias("__hit"))
    return kept.filter(~F.col("__hit") & ~F.col("__b.__guest")).select(*[c if c in series else F.col(f"__b.__row.{c}").alias(c) for c in points.columns])


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, include_current: bool = True) -> DataFrame:
    """The last non-null value so far (or so far, but before this row)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if include_current else -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers of each group: first, last and length."""
    once = df.select(*keys, F.col(number).alias("__n")).distinct()
    step = once.withColumn("__g", F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy("__n")))
    return step.groupBy(*keys, "__g").agg(F.min("__n").alias("first"), F.max("__n").alias("last"), F.count("*").alias("length")).drop("__g")


def island_label(first: Column, last: Column) -> Column:
    """``3`` or ``3-5``."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))


def renumber(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 1, without gaps."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def status_changes(df: DataFrame, keys: list[str], order: list[str], status: str, name: str = "previous") -> DataFrame:
    """Rows whose status differs from the one before; the first row of a series is a change."""
    before = F.lag(status).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, before).filter(~F.col(name).eqNullSafe(F.col(status)))


def size_change(latest: Column, previous: Column, floor: float = 1.0, share: float = 0.05) -> Column:
    """``new``, ``increased``, ``decreased`` or ``stable``: a change must exceed a floor and a share of the previous size."""
    band = F.greatest(F.lit(floor), F.abs(previous) * share)
    return (
        F.when(previous.isNull(), "new")
        .when(latest - previous > band, "increased")
        .when(previous - latest > band, "decreased")
        .otherwise("stable")
    )


def finding_change(latest: Column, previous: Column) -> Column:
    """How a tracked finding changed: presence, then classification, then size, then description.

    Both are structs with ``presence, classification, size_mm, description``; ``previous`` may be null.
    """
    gone = (previous["presence"] != "absent") & (latest["presence"] == "absent")
    came = (previous["presence"] == "absent") & (latest["presence"] != "absent")
    regrade = latest["classification"].isNotNull() & previous["classification"].isNotNull() & (latest["classification"] != previous["classification"])
    sized = latest["size_mm"].isNotNull() & previous["size_mm"].isNotNull()
    change = size_change(latest["size_mm"], previous["size_mm"])
    said = F.coalesce(latest["description"], F.lit("")) != F.coalesce(previous["description"], F.lit(""))
    return (
        F.when(previous.isNull(), "first")
        .when(gone, "resolved")
        .when(came, "appeared")
        .when(regrade, "classification_changed")
        .when(sized & (change != "stable"), change)
        .when(sized, "stable")
        .when(said, "description_changed")
        .otherwise("stable")
    )


def richest_per_report(findings: DataFrame, keys: list[str], richness: Column, tie: list[str]) -> DataFrame:
    """The richest row of each (group, report); the first in input order on ties."""
    return first_wins(findings, keys, [(-richness).alias("__rich"), *[F.col(t) for t in tie]])


def infer_if_unique(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Fill a missing value from the group's others if they have just one; ``ambiguous`` where they have several.

    Distinct values are counted by an aggregate and joined, so a large group isn't one task's window.
    """
    known = df.groupBy(*keys).agg(F.count_distinct(column).alias("__n"), F.min(column).alias("__v"))
    out = df.join(known, keys, "left")
    filled = F.coalesce(F.col(column), F.when(F.col("__n") == 1, F.col("__v")))
    return out.withColumn(name, filled).withColumn("ambiguous", F.col(column).isNull() & (F.coalesce("__n", F.lit(0)) > 1)).drop("__n", "__v")


def scaled(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Min-max scale the points of each series; a flat series lies at one half.

    Ranges are an aggregate and joined, so a large series isn't one task's window.
    """
    span = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    out = df.join(span, reduce(lambda a, b: a & b, on))
    height = F.when(F.col("__hi") == F.col("__lo"), 0.5).otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return out.withColumn(name, height).drop("__lo", "__hi", *[f"__k{i}" for i in range(len(keys))])
