"""Dates as written in documents, and dates that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_part(text: Column) -> Column:
    return F.substring(text, 1, 10)


def valid_date_input(text: Column) -> Column:
    """``YYYY-MM-DD`` with an optional time, a T in between made a space; null for anything else."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$")
    return F.when(ok, F.translate(text, "T", " "))


def normal_date(text: Column) -> Column:
    """The first date of a text as ``YYYY-MM-DD`` or with a time ``YYYY-MM-DD HH:MM:SS``; null without one."""
    p = r"(\d{4})\s*[年./~-]\s*(\d{1,2})\s*[月./~-]\s*(\d{1,2})\s*日?(?:\s*[T ]?\s*(\d{1,2})[:：时](\d{1,2})(?:[:：分](\d{1,2}))?)?"
    g = lambda i: F.regexp_extract(text, p, i)
    two = lambda i: F.lpad(g(i), 2, "0")
    day = F.concat_ws("-", g(1), two(2), two(3))
    seconds = F.when(g(6) == "", "00").otherwise(two(6))
    return F.when(g(1) == "", F.lit(None)).when(g(4) == "", day).otherwise(F.concat(day, F.lit(" "), F.concat_ws(":", two(4), two(5), seconds)))


def labelled_date(text: Column, labels: list[str]) -> Column:
    """The date behind the first of the labels that has one."""
    tail = r"\s*[:：]?\s*(\d{4}\s*[年./~-]\s*\d{1,2}\s*[月./~-]\s*\d{1,2}\s*日?(?:\s*\d{1,2}[:：]\d{1,2}(?:[:：]\d{1,2})?)?)"
    return F.coalesce(*[normal_date(F.regexp_extract(text, label + tail, 1)) for label in labels])


def add_months_rolling(day: Column, months: Column) -> Column:
    """The same day of a later month; a day that the month lacks rolls over into the next one."""
    first = F.add_months(F.trunc(day, "month"), months)
    return F.date_add(first, F.dayofmonth(day) - 1)


def follow_up_date(advice: Column, issued: Column) -> Column:
    """When to come back: a date in the advice, so many months or days, else three months after the report."""
    months = F.regexp_extract(advice, r"(\d{1,2})\s*个?月", 1).try_cast("int")
    days = F.regexp_extract(advice, r"(\d{1,3})\s*[天日]", 1).try_cast("int")
    explicit = F.regexp_extract(advice, r"(\d{4}-\d{2}-\d{2})", 1)
    return (
        F.when(explicit != "", explicit)
        .when(months.isNotNull(), add_months_rolling(issued, months).cast("string"))
        .when(days.isNotNull(), F.date_add(issued, days).cast("string"))
        .otherwise(add_months_rolling(issued, F.lit(3)).cast("string"))
    )
