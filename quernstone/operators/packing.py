"""Pages of long documents in units under several limits at once, by parallel next-fit.

A unit takes pages in order as long as all limits hold. Where the unit that starts at a page ends depends only on the pages after it, up to
the limit on pages, so it is found for every page at once from prefix sums. Which pages do start a unit follows by jumping from start to
start. A document is cut into blocks of pages, and a block's jumps are a map from the place where the first unit enters it to
the place where one enters the next block; these small maps are composed in order, and then each block knows its own starts. So a
document of any length is worked on by many tasks, none of which holds more than a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

#: Pages of a block.
BLOCK = 1024

#: The four measures of a page that limits are about.
MEASURES = ("pages", "characters", "candidate_rows", "morphology_rows")


@dataclass(frozen=True)
class Limits:
    """What a unit may hold. ``rows`` may be absent, ``pages`` not: it also bounds how far a task looks ahead."""

    pages: int = 12
    characters: int = 8_000
    tokens: int = 12_000
    rows: int | None = 60


#: Limits of units of tables and findings, and of narrative units.
SCALAR, NARRATIVE = Limits(), Limits(pages=24, rows=None)


def output_tokens(sums: np.ndarray) -> np.ndarray:
    """The output tokens that a unit is expected to need, from its sums of ``MEASURES``."""
    # Fixed values of the estimate: base, a page, a candidate row, a morphology row, and the most for text.
    return 768 + 96 * sums[..., 0] + 100 * sums[..., 2] + 180 * sums[..., 3] + np.minimum(768, -(-sums[..., 1] // 8))


def unit_ends(sizes: np.ndarray, limits: Limits, joint: int, ahead: int) -> np.ndarray:
    """For each item the place behind the unit that starts with it, ``ahead`` items at most. One that is too large on its own is a unit.

    The first measure is 1 where an item starts another page than the item before, else 0; a unit's first item starts a page for it.
    """
    n = len(sizes)
    before = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes, axis=0)])
    ends, open_ = np.arange(1, n + 1), np.ones(n, bool)
    for k in range(1, ahead):  # one more item for as long as it fits; limits only get tighter
        start = np.arange(n - k) if n > k else np.empty(0, np.int64)
        sums = before[start + k + 1] - before[start]
        sums[:, 0] += 1 - sizes[start, 0]
        sums[:, 1] += joint * k
        fits = (sums[:, 0] <= limits.pages) & (sums[:, 1] <= limits.characters) & (output_tokens(sums) <= limits.tokens)
        if limits.rows is not None:
            fits &= sums[:, 2] <= limits.rows
        open_ = open_[: len(start)] & fits
        if not open_.any():
            break
        ends[: len(start)][open_] = start[open_] + k + 1
    return ends


def pack_pages(pages: DataFrame, doc: str, limits: Limits = SCALAR, joint: int = 2, page: str | None = None) -> DataFrame:
    """``doc, unit, first, n_pages, characters, candidate_rows, morphology_rows``: the units of each document, counted from 1.

    Each row of ``pages`` is a page, or with ``page``, the column of its page, a block of one: blocks of a page follow one another, have a
    candidate row or more each, and the limit on rows bounds how many a unit takes.

    ``pages``: ``doc``, ``place`` (0, 1, 2, ... without gaps in each document), ``characters, candidate_rows, morphology_rows`` (null: 0). ``joint``
    characters stand between two pages of a unit and count against the limit, not in ``characters``. A document whose places are not dense
    is an error. Rows of a null document have no unit; an empty table gives an empty result.
    """
    names = ["characters", "candidate_rows", "morphology_rows"]
    if page and limits.rows is None:
        raise ValueError("blocks of pages need a limit on rows")
    reach_ahead = limits.rows if page else limits.pages
    rows = pages.filter(F.col(doc).isNotNull()).select(doc, F.col("place").cast("long").alias("place"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names], (F.col(page) if page else F.col("place")).alias("__page"))
    if page:
        rows = rows.withColumn("candidate_rows", F.greatest("candidate_rows", F.lit(1)))
    block = F.floor(F.col("place") / BLOCK)
    again = (F.col("place") % BLOCK < reach_ahead) & (F.col("place") >= BLOCK)
    seen = rows.withColumn("block", F.explode(F.when(again, F.array(block, block - 1)).otherwise(F.array(block))))
    key = rows.schema[doc]

    def blocks_of(batches, more: int):
        """Each block's document, number, own pages, sizes of these and of those ahead, and its further columns."""
        held, now = [], None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:2] != now:
                    if held:
                        yield block_of(now, held, more)
                    held, now = [], row[:2]
                held.append(row)
        if held:
            yield block_of(now, held, more)

    def block_of(now, held, more):
        places = np.array([r[2] for r in held])
        if (places != now[1] * BLOCK + np.arange(len(held))).any():
            raise ValueError(f"places of document {now[0]!r} have gaps or repeats")
        sizes = np.array([[int(k == 0 or r[6] != held[k - 1][6]), *r[3:6]] for k, r in enumerate(held)], np.int64)
        return now[0], now[1], min(len(held), BLOCK), sizes, held[0][7 : 7 + more]

    def maps(batches):
        out = []
        for name, number, own, sizes, _ in blocks_of(batches, 0):
            ends, leave, count = unit_ends(sizes, limits, joint, reach_ahead), [], []
            reach, units = np.zeros(own, np.int64), np.zeros(own, np.int64)
            for i in range(own - 1, -1, -1):  # jumps go forward, so a page's end is known before the page's
                e = int(ends[i])
                reach[i], units[i] = (e, 1) if e >= own else (reach[e], units[e] + 1)
            for entry in range(min(own, reach_ahead if number else 1)):
                leave.append(int(reach[entry]) - own)
                count.append(int(units[entry]))
            out.append((name, number, leave, count))
            if len(out) >= 256:
                yield table(out, map_fields)
                out = []
        yield table(out, map_fields)

    def table(rows: list[tuple], fields: StructType) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def entries(batches):
        now, entry, unit, number = None, 0, 0, 0
        for batch in batches:
            out = []
            for name, block, leave, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    now, entry, unit, number = name, 0, 0, 0
                if block != number:
                    raise ValueError(f"places of document {name!r} have gaps")
                out.append((name, block, entry, unit))
                if entry < len(leave):  # else the last unit has gone past a short last block
                    entry, unit = leave[entry], unit + count[entry]
                number += 1
            if out:
                yield table(out, entry_fields)

    def units(batches):
        out = []
        for name, number, own, sizes, (entry, unit) in blocks_of(batches, 2):
            ends, at = unit_ends(sizes, limits, joint, reach_ahead), entry
            while at < own:
                whole, unit = sizes[at : ends[at]].sum(axis=0).tolist(), unit + 1
                out.append((name, unit, number * BLOCK + at, whole[0] + 1 - int(sizes[at, 0]), *whole[1:]))
                at = int(ends[at])
            if len(out) >= 4096:
                yield table(out, unit_fields)
                out = []
        yield table(out, unit_fields)

    map_fields = StructType([key, StructField("block", LongType()), StructField("leave", ArrayType(IntegerType())), StructField("count", ArrayType(IntegerType()))])
    entry_fields = StructType([key, StructField("block", LongType()), StructField("entry", LongType()), StructField("unit", LongType())])
    unit_fields = StructType([key, *[StructField(n, LongType()) for n in ("unit", "first", "n_pages", *names)]])
    order = [doc, "block", "place"]

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition(doc, "block").sortWithinPartitions(*order)

    made = by_block(seen.select(*order, *names, "__page")).mapInArrow(maps, map_fields)
    met = made.repartition(doc).sortWithinPartitions(doc, "block").mapInArrow(entries, entry_fields)
    known = seen.join(met, [doc, "block"]).select(*order, *names, "__page", "entry", "unit")
    return by_block(known).mapInArrow(units, unit_fields)


def omission_units(missing: DataFrame, doc: str = "report_id", sizes: tuple[int, int] = (30, 16), limits: Limits = NARRATIVE) -> DataFrame:
    """Lines that no fact explains, in units for a second look, by document and mode: the columns of ``pack_pages`` and ``mode``.

    ``missing``: ``doc, page_number, line_no, text, mode`` (``scalar`` or ``morphology``). A page's lines of a mode are cut into blocks of
    30 or 16, and the blocks are packed into units, under the limits of pages, characters, tokens and rows (60 where ``limits`` has none).
    """
    size = F.when(F.col("mode") == "morphology", sizes[1]).otherwise(sizes[0])
    on_page = Window.partitionBy(doc, "mode", "page_number").orderBy("line_no")
    chunk = F.floor((F.row_number().over(on_page) - 1) / size)
    blocks = missing.withColumn("chunk", chunk).groupBy(doc, "mode", "page_number", "chunk").agg((F.sum(F.length("text") + 1) - 1).alias("characters"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(doc, "mode").orderBy("page_number", "chunk")) - 1
    is_morphology = F.col("mode") == "morphology"
    key = F.struct(F.col(doc).alias("doc"), F.col("mode").alias("mode"))
    items = blocks.select(F.to_json(key).alias("key"), place.alias("place"), "page_number", "characters", F.col("n").alias("candidate_rows"), F.when(is_morphology, F.col("n")).otherwise(0).alias("morphology_rows"))
    whole = Limits(limits.pages, limits.characters, limits.tokens, 60 if limits.rows is None else limits.rows)
    out = pack_pages(items, "key", whole, page="page_number").withColumn("k", F.from_json("key", blocks.select(key.alias("k")).schema["k"].dataType))
    return out.select(F.col("k.doc").alias(doc), F.col("k.mode").alias("mode"), "unit", "first", "n_pages", "characters", "candidate_rows", "morphology_rows")
