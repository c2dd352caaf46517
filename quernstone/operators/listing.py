"""Listings: optional filters, row-level access, keyset pages, top rows of each group."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contains_any(columns: Iterable[str], query: str) -> Column:
    """Whether any column holds the query, whatever the case; punctuation is dropped on both sides."""

    def bare(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\p{P}\p{S}]+", "")

    return reduce(lambda a, b: a | b, [F.contains(bare(F.col(c)), bare(F.lit(query))) for c in columns])


def list_filter(
    df: DataFrame,
    equals: dict[str, object] | None = None,
    differs: dict[str, object] | None = None,
    date_column: Column | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    search: tuple[list[str], str] | None = None,
) -> DataFrame:
    """Keep the rows that meet all arguments that are set.

    Dates compare as text, so an upper bound of a day leaves out later times of that day.
    An argument that is None adds no predicate, so that the scan gets only what matters.
    """
    tests = [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    tests += [F.col(c) != v for c, v in (differs or {}).items() if v is not None]
    if date_column is not None and date_from is not None:
        tests.append(date_column >= date_from)
    if date_column is not None and date_to is not None:
        tests.append(date_column <= date_to)
    if search and search[1]:
        tests.append(contains_any(*search))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def visible_to(df: DataFrame, permissions: DataFrame, user: object, on: str = "member_id", user_col: str = "user_id") -> DataFrame:
    """Keep the rows of members that a user may see; a semi join, so grants never multiply rows."""
    return df.join(permissions.filter(F.col(user_col) == user).select(on), on, "left_semi")


def encode_cursor(*parts: object) -> str:
    """A cursor: the parts joined by a bar, URL-safe base64 without padding."""
    return base64.urlsafe_b64encode("|".join("" if p is None else str(p) for p in parts).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> list[str]:
    """The parts of a cursor."""
    return base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().split("|")


def after_key(sort: Column, tie: Column, last_sort: object, last_tie: object) -> Column:
    """Rows that come after a key in descending order, nulls last.

    With a null sort value the key is among the nulls, and only ties remain.
    """
    if last_sort is None:
        return sort.isNull() & (tie < F.lit(last_tie))
    return (sort < F.lit(last_sort)) | ((sort == F.lit(last_sort)) & (tie < F.lit(last_tie))) | sort.isNull()


def keyset_page(df: DataFrame, sort: str, tie: str, size: int = 30, after: tuple | None = None) -> DataFrame:
    """One page in descending order, of 1 to 50 rows, without skipping over earlier pages."""
    if after is not None:
        df = df.filter(after_key(F.col(sort), F.col(tie), *after))
    return df.orderBy(F.col(sort).desc_nulls_last(), F.col(tie).desc()).limit(max(1, min(50, size)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group. Spark limits each task's groups before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    name = rank or "__rank"
    out = df.withColumn(name, at).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the newest row of each key, by one hash aggregate instead of a sort."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{v}").alias(v) for v in values])


def with_page_text(reports: DataFrame, pages: DataFrame, query: str | None, report_id: str = "report_id", text: str = "lines_json") -> DataFrame:
    """Reports with a page whose recognised text holds the query, whatever the case of Latin letters; a blank query keeps all.

    A semi join on the pages that match, so a report with many such pages is there once.
    """
    q = (query or "").strip()
    if not q:
        return reports
    hits = pages.filter(F.contains(F.lower(text), F.lit(q.lower()))).select(F.col(report_id).alias("__r"))
    return reports.join(hits, F.col("id") == F.col("__r"), "left_semi")


def with_keyword(df: DataFrame, columns: list[str], query: str | None) -> DataFrame:
    """Rows of which any column holds the keyword, whatever the case; a blank keyword keeps all."""
    q = (query or "").strip().lower()
    return df.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q)) for c in columns])) if q else df


def with_attention(series: DataFrame, group: str = "all", attention: str = "all", level: str = "level") -> DataFrame:
    """Series of a group by the attention that they need: ``attention`` (any), ``unflagged`` (none), or one level."""
    if group != "all":
        series = series.filter(F.col("group") == group)
    some = F.col(level).isNotNull() & (F.col(level) != "none")
    return series if attention == "all" else series.filter(some if attention == "attention" else ~some if attention == "unflagged" else F.col(level) == attention)


def is_filled_list(json: Column) -> Column:
    """Whether a JSON array has an element; null and malformed JSON have none."""
    return F.coalesce(F.json_array_length(json), F.lit(0)) > 0


def page_order(page: Column) -> Column:
    """A page number to sort by; rows without one come last."""
    return F.coalesce(page, F.lit(999_999))
