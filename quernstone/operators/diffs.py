"""Differences between two versions of a keyed table, overrides, and integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, change`` (added, removed or updated) of rows that differ between two snapshots.

    Rows are compared by a hash of the columns as JSON, so the join carries two narrow columns a side.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"{name}_key"), F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias(f"{name}_hash"))

    both = side(old, "old").join(side(new, "new"), F.col("old_key") == F.col("new_key"), "full_outer")
    change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "updated")
    return both.select(F.coalesce("new_key", "old_key").alias(key), change.alias("change")).filter("change is not null")


def reconcile(listed: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Compare a manifest with what is there: ``missing``, ``extra`` or ``mismatched``."""
    a = listed.select(F.col(key).alias("a_key"), F.col(value).alias("a_value"))
    b = found.select(F.col(key).alias("b_key"), F.col(value).alias("b_value"))
    state = (
        F.when(F.col("b_key").isNull(), "missing")
        .when(F.col("a_key").isNull(), "extra")
        .when(~F.col("a_value").eqNullSafe(F.col("b_value")), "mismatched")
    )
    both = a.join(b, F.col("a_key") == F.col("b_key"), "full_outer")
    return both.select(F.coalesce("a_key", "b_key").alias(key), state.alias("state")).filter("state is not null")


def apply_overrides(base: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Put manual values over a table's; ``overrides`` has ``key, field, value``, the newest row of a field last by ``at``.

    Overrides are pivoted once to a row for each key, then joined; fields without one keep their value.
    """
    newest = overrides.groupBy(key, "field").agg(F.max_by("value", "at").alias("value"))
    wide = newest.groupBy(F.col(key).alias("__k")).agg(*[F.max(F.when(F.col("field") == c, F.struct("value"))).alias(f"__o_{c}") for c in columns])
    out = base.join(wide, F.col(key) == F.col("__k"), "left")
    kinds = dict(base.dtypes)
    made = {c: F.when(F.col(f"__o_{c}").isNotNull(), F.col(f"__o_{c}.value").try_cast(kinds[c])).otherwise(F.col(c)) for c in columns}
    return out.select(*[made[c].alias(c) if c in made else F.col(c) for c in base.columns])


def apply_extraction(base: DataFrame, extracted: DataFrame, key: str, columns: list[str], manual: str = "manual_fields") -> DataFrame:
    """Update columns from an extraction: a manual field stays, an empty new value changes nothing."""
    new = extracted.select(F.col(key).alias("__k"), *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(f"__n_{c}") for c in columns])
    out = base.join(new, F.col(key) == F.col("__k"), "left")
    locked = lambda c: F.coalesce(F.array_contains(manual, c), F.lit(False))
    made = {c: F.when(locked(c), F.col(c)).otherwise(F.coalesce(f"__n_{c}", c)) for c in columns}
    return out.select(*[made[c].alias(c) if c in made else F.col(c) for c in base.columns])


def field_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each field that an edit changed: ``key, field, before, after``."""
    o = old.select(F.col(key), *[F.col(c).cast("string").alias(f"__o_{c}") for c in columns])
    n = new.select(F.col(key), *[F.col(c).cast("string").alias(f"__n_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"__o_{c}").alias("before"), F.col(f"__n_{c}").alias("after")) for c in columns])
    each = o.join(n, key).select(key, F.explode(rows).alias("x")).select(key, "x.*")
    return each.filter(~F.col("before").eqNullSafe(F.col("after")))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """How many rows refer to no parent: ``check, n``."""
    lost = child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("__k")), F.col(child_key) == F.col("__k"), "left_anti")
    return lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def repeated_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many keys occur more than once: ``check, n``."""
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def version_gaps(df: DataFrame, version: str) -> DataFrame:
    """Versions that don't follow on the one before: ``version, previous``."""
    v = df.select(F.col(version).alias("version")).distinct()
    return v.withColumn("previous", F.lag("version").over(Window.orderBy("version"))).filter("previous is not null and version <> previous + 1")


def newest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: what an upsert leaves behind."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__b")
    return df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(best).select("__b.*")


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet, one for each key, added to ``base``."""
    fresh = new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def replace_derived(old: DataFrame, new: DataFrame, key: str, is_manual: str) -> DataFrame:
    """Replace the derived rows of the keys in ``new``; rows edited by hand stay."""
    touched = new.select(key).distinct()
    untouched = old.join(touched, key, "left_anti")
    manual = old.filter(F.col(is_manual)).join(touched, key, "left_semi")
    return untouched.unionByName(manual).unionByName(new.select(*old.columns))
