"""Documents as pages and lines: parsing, noise, repeated lines, quality, classes and packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quernstone.functions import report_rules as R
from quernstone.functions.rules import anchored, finish_classification, weighted_sum
from quernstone.functions.text import line_fingerprint, narrow

LINE = "array<struct<id:string,text:string,confidence:double,box:array<double>,variant:string>>"


def parse_lines(pages: DataFrame, lines_json: str = "lines_json", page: str = "page_number") -> DataFrame:
    """Explode the JSON lines of pages: blank texts go, ids are made up, confidence is cut to 0..1; malformed JSON has no lines."""
    parsed = F.coalesce(F.from_json(lines_json, LINE, {"mode": "PERMISSIVE"}), F.array().cast(LINE))
    out = pages.select(*[c for c in pages.columns if c != lines_json], F.posexplode(parsed).alias("line_no", "l"))
    text = F.trim(F.col("l.text"))
    out = out.filter(text.isNotNull() & (text != ""))
    number = F.concat(F.lit("p"), F.col(page), F.lit("l"), F.col("line_no") + 1)
    return out.withColumns(
        {
            "line_id": F.coalesce(F.nullif("l.id", F.lit("")), number),
            "text": text,
            "confidence": F.least(F.greatest(F.coalesce("l.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)),
            "box": F.col("l.box"),
        }
    ).drop("l")


def text_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank lines of documents with their numbers."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line")).filter("line <> ''")


def is_noise(text: Column, confidence: Column) -> Column:
    """Page marks, footers, lines without a letter or digit, and short lines of low confidence."""
    t = F.regexp_replace(narrow(text), r"\s+", "")
    mark = t.rlike(r"^(?:第?\d+页(?:共\d+页)?|\d+/\d+页?|-?\d+-?|本报告仅供.*|仅供临床参考.*|打印时间.*|打印日期.*|以下空白)$")
    return mark | ~t.rlike(r"[\p{L}\p{N}]") | ((confidence < 0.35) & (F.length(t) <= 2))


def line_frequency(lines: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """In how many documents each line occurs, by a fingerprint that masks numbers.

    Distinct (document, fingerprint) pairs combine on the map side, so a very common line is cheap.
    """
    pairs = lines.select(doc, F.xxhash64(line_fingerprint(F.col(line))).alias("fp"), line_fingerprint(F.col(line)).alias("key")).distinct()
    return pairs.groupBy("fp", "key").agg(F.count("*").alias("n_docs"))


def drop_repeated_lines(lines: DataFrame, doc: str, page: str, line_no: str, line: str = "line", share: float = 0.2, least: int = 3, edge: int = 4) -> DataFrame:
    """Drop headers and footers: lines near a page's edge that many pages of a document share; the first stays.

    A line is repeated when it is on ``least`` pages or more, and on a ``share`` of the document's pages.
    """
    fp = lines.withColumn("__fp", line_fingerprint(F.col(line)))
    ends = fp.groupBy(doc, page).agg(F.max(line_no).alias("__last"))
    total = ends.groupBy(doc).agg(F.count("*").alias("__pages"))
    fp = fp.join(ends, [doc, page]).withColumn("__edge", (F.col(line_no) < edge) | (F.col(line_no) > F.col("__last") - edge))
    often = fp.filter("__edge").groupBy(doc, "__fp").agg(F.count_distinct(page).alias("__n"), F.min(F.struct(page, line_no)).alias("__first"))
    often = often.join(total, doc).filter(F.col("__n") >= F.greatest(F.lit(least), F.ceil(F.col("__pages") * share)))
    out = fp.join(often.select(doc, "__fp", "__first"), [doc, "__fp"], "left")
    again = F.col("__first").isNotNull() & F.col("__edge") & (F.struct(page, line_no) != F.col("__first"))
    return out.filter(~again).select(*lines.columns)


def quality_ladder(n_lines: Column, n_chars: Column, n_digits: Column, useful: Column, confidence: Column) -> Column:
    """Score 0..100 and level of a page's text: lines, characters, digits, useful share and mean confidence."""
    points = (
        F.when(n_lines >= 20, 20).when(n_lines >= 8, 14).when(n_lines >= 3, 8).otherwise(0)
        + F.when(n_chars >= 600, 25).when(n_chars >= 200, 18).when(n_chars >= 60, 10).otherwise(0)
        + F.when(n_digits >= 20, 15).when(n_digits >= 5, 8).otherwise(0)
        + F.when(useful >= 0.75, 20).when(useful >= 0.5, 12).otherwise(0)
        + F.when(confidence >= 0.9, 20).when(confidence >= 0.75, 12).otherwise(0)
    )
    level = F.when(points >= 70, "good").when(points >= 45, "fair").when(n_chars > 0, "poor").otherwise("empty")
    return F.struct(points.alias("score"), level.alias("level"))


def page_scores(text: Column) -> Column:
    """Score of each kind of report for one page's text, in the fixed order of kinds."""
    t = F.trim(F.regexp_replace(narrow(text), r"\s+", " "))
    return F.array(*[F.struct(F.lit(k).alias("kind"), weighted_sum(t, rules).alias("score")) for k, rules in R.REPORT_KINDS.items()])


def classify_documents(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Kinds of documents from their pages: scores of the first two pages count 1.4 times, and a checkup's cover decides.

    One aggregate: each kind's score is a column of sums, so nothing is exploded.
    """
    t = F.trim(F.regexp_replace(narrow(F.col(text)), r"\s+", " "))
    weight = F.when(F.col(page) <= 2, 1.4).otherwise(1.0)
    sums = [F.sum(weighted_sum(t, rules) * weight).alias(k) for k, rules in R.REPORT_KINDS.items()]
    out = pages.groupBy(doc).agg(*sums, F.bool_or(F.col(text).rlike(R.CHECKUP_ANCHOR)).alias("__anchor"))
    scores = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in R.REPORT_KINDS])
    done = finish_classification(anchored(scores, "checkup", F.coalesce("__anchor", F.lit(False))))
    return out.select(doc, done["kinds"].alias("kinds"), done["confidence"].alias("confidence"))


def pack(df: DataFrame, keys: list[str], order: list[str], size: Column, most_size: int, most_items: int) -> DataFrame:
    """Pack the items of each group, in order, into units of bounded size and number; an item never splits.

    An item larger than the bound has a unit of its own. Items of a group stream through its task in order, and only
    the open unit's counts are held, so a group of any size needs no memory. A null key is a group.
    Returns keys, ``unit`` (from 1), ``items``, ``total`` and ``first`` (the place of its first item in the group, from 0).
    """
    rows = df.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.coalesce(size.cast("long"), F.lit(0)).alias("__size"))
    places = [f"__o{i}" for i in range(len(order))]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *places).select(*keys, "__size")
    made = ["unit", "items", "total", "first"]
    kinds = [to_arrow_type(rows.schema[k].dataType) for k in keys]

    def run(batches):
        now, unit, items, total, at, first = None, 0, 0, 0, 0, 0
        for batch in batches:
            done = []
            sizes = batch.column(len(keys)).to_pylist()
            for key, n in zip(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True), sizes, strict=True):
                if key != now or items >= most_items or total + n > most_size:
                    if items:
                        done.append((*now, unit, items, total, first))
                    if key != now:
                        now, unit, at = key, 0, 0
                    unit, items, total, first = unit + 1, 0, 0, at
                items, total, at = items + 1, total + n, at + 1
            if done:
                yield packed(done)
        if items:
            yield packed([(*now, unit, items, total, first)])

    def packed(done: list[tuple]) -> pa.RecordBatch:
        types = [*kinds, pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=[*keys, *made])

    fields = [*[rows.schema[k] for k in keys], StructField("unit", IntegerType()), StructField("items", LongType()), StructField("total", LongType()), StructField("first", IntegerType())]
    return rows.mapInArrow(run, StructType(fields))


def split_units(units: DataFrame, items: str) -> DataFrame:
    """Two halves of each unit that was too large."""
    half = F.ceil(F.size(items) / 2).cast("int")
    parts = F.array(F.slice(items, F.lit(1), half), F.slice(items, half + 1, F.size(items)))
    return units.withColumn(items, F.explode(F.filter(parts, lambda p: F.size(p) > 0)))
