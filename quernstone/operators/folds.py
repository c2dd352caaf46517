"""Order-dependent folds over the lines of a page or a document.

Those that need more than a window stream: a task gets its pages or documents in order, many to a batch, and holds the lines of a
page, or of a document only what is open, at a time.
"""

from __future__ import annotations

import itertools
import re
import statistics
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quernstone.functions import line_rules as L
from quernstone.functions.text import table_cells

from .screening import education_pages, label_of

#: Share of the smaller height by which rows overlap, and of the width by which cells of a row may.
ROW_OVERLAP, CELL_OVERLAP = 0.55, 0.25


def _overlap(a0: float, a1: float, b0: float, b1: float) -> float:
    """Share of the shorter of two intervals that both cover."""
    shorter = min(a1 - a0, b1 - b0)
    return max(0.0, min(a1, b1) - max(a0, b0)) / shorter if shorter > 0 else 0.0


def _streamed(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterator[dict]], schema: StructType) -> DataFrame:
    """Give ``fold`` each group's rows in order, one group after another; it yields rows of ``schema``."""
    kind = to_arrow_schema(schema)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        each = (row for batch in batches for row in batch.to_pylist())
        done: list[dict] = []
        for _, group in itertools.groupby(each, key=lambda r: tuple(r[k] for k in keys)):
            for row in fold(group):
                done.append(row)
                if len(done) >= 1024:
                    yield pa.RecordBatch.from_pylist(done, schema=kind)
                    done = []
        yield pa.RecordBatch.from_pylist(done, schema=kind)

    return rows.mapInArrow(run, schema)


def _joined(rows: list[list[dict]]) -> Iterator[dict]:
    """Rows of cells as one line each: texts in order, mean confidence, the box around all."""
    for i, row in enumerate(rows):
        row.sort(key=lambda c: (c["left"] is None, c["left"]))
        known = [c["confidence"] for c in row if c["confidence"] is not None]
        box = {s: f((c[s] for c in row if c[s] is not None), default=None) for f, s in ((min, "left"), (min, "top"), (max, "right"), (max, "bottom"))}
        yield {"row_no": i, "text": " | ".join(c["text"] or "" for c in row), "confidence": sum(known) / len(known) if known else None, **box, "line_ids": [c["line_id"] for c in row]}


def visual_rows(lines: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Put the cells of a page that lie side by side together into rows.

    Lines have ``line_id, text, confidence, left, top, right, bottom`` and are taken from top to bottom, then left to right, lines whose
    tops differ by less than 0.45 of a height counting as level. A line joins the last row that it overlaps
    vertically, if it overlaps none of the row's cells horizontally. Lines without a box are rows of their own, at the end.
    The sweep keeps a row open as long as a later line can still overlap it; a task holds one page's lines at a time.
    """

    def fold(group: Iterator[dict]) -> Iterator[dict]:
        cells = list(group)
        boxed = [c for c in cells if c["top"] is not None]
        height = statistics.median(c["bottom"] - c["top"] for c in boxed) if boxed else 1.0
        for c in boxed:
            c["level"] = round(c["top"] / max(height * 0.45, 1e-9))
        boxed.sort(key=lambda c: (c["level"], c["left"], c["line_id"]))
        rows: list[list[dict]] = []
        spans: list[list[float]] = []  # top and bottom of each row
        open_: list[int] = []
        for n, c in enumerate(boxed):
            lowest = c["top"] if n + 1 == len(boxed) else min(c["top"], (c["level"] - 1) * height * 0.45)
            open_ = [i for i in open_ if spans[i][1] >= lowest]  # lines come by level: none after this starts higher
            home = None
            for i in reversed(open_):
                if _overlap(*spans[i], c["top"], c["bottom"]) >= ROW_OVERLAP and all(_overlap(x["left"], x["right"], c["left"], c["right"]) < CELL_OVERLAP for x in rows[i]):
                    home = i
                    break
            if home is None:
                rows.append([c])
                spans.append([c["top"], c["bottom"]])
                open_.append(len(rows) - 1)
            else:
                rows[home].append(c)
                spans[home] = [min(spans[home][0], c["top"]), max(spans[home][1], c["bottom"])]
        rows += [[c] for c in sorted((c for c in cells if c["top"] is None), key=lambda c: (c["left"] is None, c["left"], c["line_id"]))]
        for row in _joined(rows):
            yield {doc: cells[0][doc], page: cells[0][page], **row}

    kinds = {f.name: f for f in lines.schema.fields}
    sides = [StructField(s, DoubleType()) for s in ("left", "top", "right", "bottom")]
    used = lines.select(doc, page, F.col("line_id").cast("string").alias("line_id"), "text", F.col("confidence").cast("double").alias("confidence"), *[F.col(s.name).cast("double").alias(s.name) for s in sides])
    made = [kinds[doc], kinds[page], StructField("row_no", IntegerType()), StructField("text", StringType()), StructField("confidence", DoubleType()), *sides, StructField("line_ids", ArrayType(StringType()))]
    return _streamed(used, [doc, page], [], fold, StructType(made))


def merge_wrapped(lines: DataFrame, doc: str = "doc_id", page: str = "page", least: int = 24) -> DataFrame:
    """Join lines that a page broke: text of ``least`` characters or more that doesn't end a sentence goes on in the next line.

    Table rows, headings (``boundary`` not null) and lines that start a list stay apart. Adds ``line_ids``.
    """
    kinds = {f.name: f for f in lines.schema.fields}
    ended, cell, item = re.compile(r"[。！？；;:：.!?]$"), re.compile(r"[|｜]"), re.compile(r"^\s*(?:[-•*]|\d{1,2}[.、)])")

    def fold(group: Iterator[dict]) -> Iterator[dict]:
        last: dict | None = None
        for r in group:
            text = r["text"] or ""
            goes_on = (
                last is not None and last["boundary"] is None and r["boundary"] is None and len(last["text"]) >= least
                and not (ended.search(last["text"]) or cell.search(last["text"]) or cell.search(text) or item.search(text))
            )
            if goes_on:
                last["text"] += text
                last["line_ids"].append(r["line_id"])
                continue
            if last is not None:
                yield last
            last = {doc: r[doc], page: r[page], "line_no": r["line_no"], "text": text, "boundary": r["boundary"], "line_ids": [r["line_id"]]}
        if last is not None:
            yield last

    used = lines.select(doc, page, "line_no", F.col("line_id").cast("string").alias("line_id"), "text", F.col("boundary").cast("string").alias("boundary"))
    made = [kinds[doc], kinds[page], kinds["line_no"], StructField("text", StringType()), StructField("boundary", StringType()), StructField("line_ids", ArrayType(StringType()))]
    return _streamed(used, [doc, page], ["line_no"], fold, StructType(made))


def fill_budget(lines: DataFrame, doc: str = "doc_id", budget: int = 8000) -> DataFrame:
    """Choose lines by priority until a document's character budget is spent; one that is too long is passed over, later ones still count.

    Input has ``priority`` (smaller first), ``line_no`` and ``text`` (null: empty); the chosen lines of a document come in its order. Lines
    longer than the budget can't be chosen and are not shuffled. Documents stream in order of priority; only what is left is held.
    """

    def fold(group: Iterator[dict]) -> Iterator[dict]:
        left = budget
        for row in group:
            n = len(row["text"] or "")
            if n <= left:
                left -= n
                yield row

    fit = lines.filter(F.length(F.coalesce("text", F.lit(""))) <= budget)
    return _streamed(fit, [doc], ["priority", "line_no"], fold, lines.schema).sortWithinPartitions(doc, "line_no")


def carry_context(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The section and table header that each line stands under, across pages: ``doc, page, line_no, section, table_header``.

    Lines have ``page, line_no, text, boundary`` (``section``, ``table_header`` or null) and ``candidate`` (a result row). A section ends the
    header before it. The next page inherits both only when the page before it ended with a result row and its own first
    line is one. So pages form runs, found on a row for each page; within a run context is the last boundary so far.
    """
    ends = lines.groupBy(doc, "page").agg(F.min_by("candidate", "line_no").alias("__first"), F.max_by("candidate", "line_no").alias("__last"))
    pages = Window.partitionBy(doc).orderBy("page")
    follows = (F.lag("page").over(pages) == F.col("page") - 1) & F.lag("__last").over(pages) & F.col("__first")
    ends = ends.withColumn("__new", (~F.coalesce(follows, F.lit(False))).cast("int"))
    ends = ends.select(F.col(doc).alias("__d"), F.col("page").alias("__p"), F.sum("__new").over(pages).alias("__run"))
    rows = lines.join(ends, (F.col(doc) == F.col("__d")) & (F.col("page") == F.col("__p")))
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_section, is_header = (F.coalesce(F.col("boundary") == b, F.lit(False)) for b in ("section", "table_header"))
    rows = rows.withColumn("section", F.last(F.when(is_section, F.col("text")), ignorenulls=True).over(so_far(doc, "__run")))
    rows = rows.withColumn("__part", F.sum(is_section.cast("int")).over(so_far(doc, "__run")))
    header = F.last(F.when(is_header, F.col("text")), ignorenulls=True).over(so_far(doc, "__run", "__part"))
    return rows.select(doc, "page", "line_no", "section", header.alias("table_header"))


def without_education(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines without general advice, which may run over several pages, and without what follows a heading of earlier results on a page.

    Lines have ``page, line_no, text, boundary``. A page of advice starts a run (``screening.education_pages``), of which only its
    headings among the first ten lines stay; a page with a table header, or with words among its first twelve lines that
    begin a report or a summary, ends it. The state is the last such event so far, on a row for each page.
    """
    at = F.row_number().over(Window.partitionBy(doc, "page").orderBy("line_no"))
    t = F.trim("text")
    bare = F.trim(F.regexp_replace(F.col("text"), r"^【\s*|\s*】$", ""))
    again = F.coalesce(F.col("boundary") == "table_header", F.lit(False)) | t.rlike(L.CONTENT_RESTART) | label_of(F.get(table_cells(F.col("text")), F.lit(0))).rlike(L.SUMMARY_HEADING)
    rows = lines.withColumn("__at", at)
    starts = education_pages(lines, [doc, "page"]).withColumn("__starts", F.lit(True))
    pages = rows.groupBy(doc, "page").agg(F.bool_or((F.col("__at") <= 12) & again).alias("__again"), F.min(F.when(bare.rlike(L.HISTORICAL_SECTION), F.col("__at"))).alias("__old"))
    pages = pages.join(starts, [doc, "page"], "left").withColumn("__starts", F.coalesce("__starts", F.lit(False)))
    event = F.when(F.col("__starts"), True).when(F.col("__again"), False)
    state = F.last(event, ignorenulls=True).over(Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pages = pages.withColumn("__advice", F.coalesce(state, F.lit(False)))
    advice = F.col("__starts") & (F.col("__at") <= 10) & t.rlike(L.EDUCATION_HEADING)
    keep = F.when(F.col("__advice"), advice).otherwise(F.col("__old").isNull() | (F.col("__at") < F.col("__old")))
    return rows.join(pages, [doc, "page"]).filter(keep).select(*lines.columns)
