"""Summaries: conditional counts, histograms, votes, distinct lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts_where(df: DataFrame, tests: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Count rows that meet each test, in one pass; an empty input counts 0."""
    return df.groupBy(*(keys or [])).agg(*[F.count_if(t).alias(name) for name, t in tests.items()])


def with_counts(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """Add how many rows of another table each row has: grouped first, so nothing fans out."""
    n = other.groupBy(F.col(other_key).alias("__k")).agg(F.count("*").alias(name))
    return df.join(n, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(0)))


def distinct_list(df: DataFrame, keys: list[str], column: str, name: str, sep: str = ",") -> DataFrame:
    """Sorted distinct values of each group in one string; distinct pairs are made before grouping."""
    pairs = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("string").alias("__v")).distinct()
    return pairs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__v")), sep).alias(name))


def majority(df: DataFrame, keys: list[str], vote: str, weight: str | None = None, name: str = "choice") -> DataFrame:
    """The most frequent value of each group; ties go to the larger weight, then the smaller value.

    Votes are counted for each (group, value) before groups are compared, so a group of any
    size comes down to one row for each of its values.
    """
    best = F.max(weight) if weight else F.lit(0)
    votes = df.groupBy(*keys, vote).agg(F.count("*").alias("votes"), best.alias("__w"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("votes").desc(), F.col("__w").desc(), F.col(vote)))
    return votes.withColumn("__r", at).filter("__r = 1").select(*keys, F.col(vote).alias(name), "votes")


def status_of(counts: DataFrame, failed: str = "failed", active: str = "active") -> Column:
    """A report's state from its jobs': any failed, else any active, else waiting for review."""
    return F.when(F.col(failed) > 0, "failed").when(F.col(active) > 0, "processing").otherwise("needs_review")


def ordered_distinct(items: Column, most: int) -> Column:
    """The first distinct non-blank strings of an array, in order."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), 1, most)


def merge_rows(df: DataFrame, keys: list[str], columns: list[str], rank: Column) -> DataFrame:
    """Coalesce the rows of each group: every column takes its first non-null value in the order of ``rank``.

    One aggregate: the smallest (rank, value) struct among rows where the value is there.
    """
    each = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*each)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements of two arrays of distinct elements, and their shares of the smaller and larger array."""
    shared = F.size(F.array_intersect(a, b))
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.struct(shared.alias("shared"), F.try_divide(shared, low).alias("of_min"), F.try_divide(shared, high).alias("of_max"))


def strong_overlap(o: Column) -> Column:
    """Enough shared observations to call two reports the same."""
    n, lo, hi = o["shared"], o["of_min"], o["of_max"]
    return (n >= 10) | ((n >= 6) & (lo >= 0.75) & (hi >= 0.3)) | ((n >= 3) & (lo >= 0.9) & (hi >= 0.5))


def signature(df: DataFrame, keys: list[str], parts: list[str], required: str, name: str = "signature") -> DataFrame:
    """A group's parts, sorted and joined; null where a row lacks the required part."""
    part = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    out = df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(part)), "|").alias("__s"), F.bool_and(F.col(required).isNotNull()).alias("__all"))
    return out.select(*keys, F.when(F.col("__all"), F.col("__s")).alias(name))


def classify_pages(scores: DataFrame, doc: str = "doc_id", page: str = "page", kind: str = "kind", score: str = "score") -> DataFrame:
    """Classify documents from page scores: the first two pages weigh 1.4 times as much.

    Returns one row for each document: the best and second type with their scores, and whether
    the second counts too (at least 6 and 0.55 of the top).
    """
    weighted = F.sum(F.col(score) * F.when(F.col(page) <= 2, 1.4).otherwise(1.0))
    total = scores.groupBy(doc, kind).agg(F.round(weighted, 6).alias("total")).filter("total > 0")
    at = Window.partitionBy(doc).orderBy(F.col("total").desc(), F.col(kind))
    ranked = total.withColumn("r", F.row_number().over(at)).filter("r <= 2")
    out = ranked.groupBy(doc).agg(
        F.max(F.when(F.col("r") == 1, F.col(kind))).alias("top"),
        F.max(F.when(F.col("r") == 1, F.col("total"))).alias("top_score"),
        F.max(F.when(F.col("r") == 2, F.col(kind))).alias("second"),
        F.max(F.when(F.col("r") == 2, F.col("total"))).alias("second_score"),
    )
    return out.withColumn("both", F.coalesce(F.col("second_score") >= F.greatest(F.lit(6.0), F.col("top_score") * 0.55), F.lit(False)))


def readable_length(pages: DataFrame, key: str = "report_id") -> DataFrame:
    """Characters of recognised text of each report; a page of which only the lines are known counts 1: ``key, n``."""
    lines = F.col("lines_json")
    n = F.when(F.col("text_length").isNotNull(), F.col("text_length")).when(lines.isNotNull() & ~lines.isin("", "[]"), 1).otherwise(0)
    return pages.groupBy(key).agg(F.sum(n).cast("long").alias("n"))


def merged_histogram(parts: list[DataFrame], key: str, n: str = "n") -> DataFrame:
    """Histograms added up: ``key, n``."""
    out = parts[0].select(key, n)
    for p in parts[1:]:
        out = out.unionByName(p.select(key, n))
    return out.groupBy(key).agg(F.sum(n).alias(n))


def log_volume(files: DataFrame, current: str) -> DataFrame:
    """One row over log files (``name, bytes``): all bytes, those of the current file, files, and archives among them."""
    mine = F.col("name") == current
    return files.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.max(F.when(mine, F.col("bytes"))), F.lit(0)).alias("current_bytes"), F.count("*").alias("files"), F.count_if(~mine).alias("archives")
    )
