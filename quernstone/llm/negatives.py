"""Hard negatives by an inverted multi-index.

A vector's two halves are quantised by a codebook each, and the pair of codes is its cell. A query's inner product with
any row of a cell is at most the sum of two half scores: with the half's centre, plus the query half's length times the
radius of that code. A heap over the two sorted lists of half scores visits cells by falling bound and stops as soon as no
unvisited cell can change any of the query's score windows, so results are exact.

Rows are dealt to shards of neighbouring cells, and a query goes to the shards of which some cell's bound reaches its window.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut

#: Codes of a half, rows that fit them, rows of a shard, and queries that meet a shard at once.
CODES, SAMPLE_ROWS, SHARD_ROWS, BLOCK = 16, 4096, 2048, 2048

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Index:
    """Centres and radii of both halves, and where cells lie: first shard and number of shards."""

    width: int
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    places: dict[tuple[int, int], tuple[int, int]]

    def half_bounds(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each half, the largest part of an inner product that a row of a code can add: queries by codes."""
        out = []
        for q, centres, radii in zip(_halves(queries), self.centres, self.radii, strict=True):
            long, far = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(centres, axis=1)[None, :]
            out.append(q @ centres.T + long * radii * (1 + 1e-9) + long * far * 1e-9 + 1e-6)  # the last terms cover rounding
        return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _centres(x: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from the first rows; a centre without rows stays."""
    centres = x[:codes].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        code = _codes(x, centres)
        for k in range(len(centres)):
            if (code == k).any():
                centres[k] = x[code == k].mean(axis=0)
    return centres


def _codes(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """``id, label, v``: the rows that take part, with each component ``x`` as ``floor(scale * x)``.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that share an id, the
    one of smallest label, then vector, does. Components are held within what lets a hundred times an inner product fit a long.
    """
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    most = F.least(F.floor(F.sqrt(F.lit(float(1 << 55)) / F.greatest(F.size("x"), F.lit(1)))), F.lit((1 << 31) - 1))
    ints = F.transform("x", lambda c: F.greatest(-F.col("most"), F.least(F.col("most"), F.floor(c * scale))).cast("int"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.withColumn("most", most).select("id", "label", ints.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def build(rows: DataFrame, codes: int = CODES, sample: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[Index, DataFrame]:
    """The index over ``rows`` (``id, label, v``), and the rows with their codes and shard: ``id, label, v, c1, c2, shard``.

    Codebooks are fitted to at most ``sample`` rows, the first by a hash of the id; every row is indexed. The driver gets that
    sample and one row for each cell that has rows, of ``codes`` squared at most. A cell of more than ``shard_rows`` rows is dealt
    to several shards by a hash of the id; smaller neighbouring cells share one.
    """
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    x = _matrix(some.column("v"), width)
    centres = tuple(_centres(h, codes) for h in _halves(x))
    fields = StructType([StructField("id", LongType()), StructField("label", LongType()), StructField("v", ArrayType(IntegerType())), StructField("c1", IntegerType()), StructField("c2", IntegerType()), StructField("d1", DoubleType()), StructField("d2", DoubleType())])

    def coded(batches):
        for batch in batches:
            columns = list(batch.columns)
            found = [(h, c, _codes(h, c)) for h, c in zip(_halves(_matrix(batch.column(2), width)), centres, strict=True)]
            columns += [pa.array(code, pa.int32()) for _, _, code in found]
            columns += [pa.array(np.linalg.norm(h - c[code], axis=1), pa.float64()) for h, c, code in found]
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    indexed = cut(rows.mapInArrow(coded, fields))
    cells = indexed.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).orderBy("c1", "c2").collect()
    radii = tuple(np.zeros(len(c)) for c in centres)
    places, shard, held = {}, 0, 0
    for c in cells:
        radii[0][c.c1], radii[1][c.c2] = max(radii[0][c.c1], c.d1), max(radii[1][c.c2], c.d2)
        if held and held + c.n > shard_rows:
            shard, held = shard + 1, 0
        n = -(-c.n // shard_rows)
        places[c.c1, c.c2] = (shard, n)
        shard, held = (shard + n, 0) if n > 1 else (shard, held + c.n)
    spark = rows.sparkSession
    where = spark.createDataFrame([(*k, *v) for k, v in places.items()], "c1 int, c2 int, first long, n long")
    dealt = indexed.join(F.broadcast(where), ["c1", "c2"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("n")))
    return Index(width, centres, radii, places), dealt.select("id", "label", "v", "c1", "c2", "shard")


class _Shard:
    """The rows of a shard, cell by cell."""

    def __init__(self, rows: pa.Table, width: int):
        c1, c2 = (rows.column(c).to_numpy() for c in ("c1", "c2"))
        order = np.lexsort((c2, c1))
        self.ids, self.labels = (rows.column(c).to_numpy()[order] for c in ("id", "label"))
        self.x = _matrix(rows.column("v"), width)[order]
        self.most = np.abs(self.x).max(initial=0)
        self.codes = np.unique(c1), np.unique(c2)
        c1, c2 = c1[order], c2[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(c1) != 0) | (np.diff(c2) != 0)])
        self.cells = {(int(c1[a]), int(c2[a])): (int(a), int(b)) for a, b in zip(starts, np.r_[starts[1:], len(c1)], strict=True)}

    def scores(self, q: np.ndarray, start: int, end: int) -> np.ndarray:
        """Exact inner products: by doubles where every sum fits their 53 bits, else by longs."""
        if self.x.shape[1] * self.most * np.abs(q).max(initial=0) < 1 << 53:
            return (self.x[start:end] @ q).astype(np.int64)
        return self.x[start:end].astype(np.int64) @ q.astype(np.int64)

    def visits(self, first: np.ndarray, second: np.ndarray):
        """Multi-sequence order: cells by falling sum of the half bounds, each ``bound, start, end``."""
        one, two = (sorted(((float(b[c]), int(c)) for c in codes), reverse=True) for b, codes in ((first, self.codes[0]), (second, self.codes[1])))
        heap = [(-(one[0][0] + two[0][0]), 0, 0)]
        while heap:
            below, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-(one[i][0] + two[j + 1][0]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(one[i + 1][0] + two[0][0]), i + 1, 0))
            if cell := self.cells.get((one[i][1], two[j][1])):
                yield -below, *cell

    def best(self, q: np.ndarray, own: int, label: int, bounds: tuple[np.ndarray, np.ndarray], windows: list[tuple[int, int]], k: int, same: bool) -> tuple[list[list[tuple[int, int]]], int]:
        """For each window of scores its first ``k`` rows as ``(-score, id)``, and the number of cells visited."""
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        need, visited = [lo for lo, _ in windows], 0
        for bound, start, end in self.visits(*bounds):
            if bound < min(need):  # certified: neither this cell nor a later one can enter a window
                break
            visited += 1
            s = self.scores(q, start, end)
            ok = ((self.labels[start:end] == label) == same) & (s >= min(need))
            if same:
                ok &= self.ids[start:end] != own
            some = np.flatnonzero(ok)
            if not len(some):
                continue
            scores, ids = s[some], self.ids[start:end][some]
            for w, (lo, hi) in enumerate(windows):
                at = np.flatnonzero((scores >= need[w]) & (scores <= hi))
                if len(at):
                    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
                    found[w] = sorted(found[w] + list(zip((-scores[at]).tolist(), ids[at].tolist(), strict=True)))[:k]
                    if len(found[w]) == k:
                        need[w] = max(lo, -found[w][-1][0])
        return found, visited


_SENT = StructType([StructField("shard", LongType()), StructField("id", LongType()), StructField("label", LongType()), StructField("v", ArrayType(IntegerType())), StructField("lows", ArrayType(LongType())), StructField("highs", ArrayType(LongType()))])
_FOUND = StructType([StructField(n, LongType()) for n in ("anchor", "slot", "id", "score", "visited")])


def search(index: Index, rows: DataFrame, queries: DataFrame, k: int, same: bool, shards: DataFrame | None = None) -> DataFrame:
    """``anchor, slot, id, score``: for each score window of each query its first ``k`` rows, ties by smaller id.

    ``queries`` has ``id, label, v, lows, highs``; slot is a window's place in the two lists. ``same`` asks for
    other rows of the query's label, else for rows of any other label. A query is sent to the shards that its bounds let reach
    a window, or to those of ``shards`` (``id, shard``) only. Queries meet shards in blocks, so a task holds
    ``SHARD_ROWS`` rows and ``BLOCK`` queries or about as many; each shard's finds are cut to ``k`` and merged.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def routed(batches):
        index = shared.value
        cells = list(index.places.items())
        codes = np.array([c for c, _ in cells], dtype=np.int64).reshape(-1, 2)
        for batch in batches:
            one, two = index.half_bounds(_matrix(batch.column(2), index.width))
            reach = one[:, codes[:, 0]] + two[:, codes[:, 1]] if cells else np.zeros((len(batch), 0))
            least = np.array([min(lows) for lows in batch.column(3).to_pylist()])
            for q in range(len(batch)):
                to = sorted({s for c in np.flatnonzero(reach[q] >= least[q]) for s in range(cells[c][1][0], sum(cells[c][1]))})
                for start in range(0, len(to), 1024):
                    some = to[start : start + 1024]
                    again = batch.slice(q, 1).take(pa.array(np.zeros(len(some), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *again.columns], names=_SENT.names)

    def searched(held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if held.num_rows and asked.num_rows:
            index = shared.value
            shard, q = _Shard(held, index.width), _matrix(asked.column("q_v"), index.width)
            one, two = index.half_bounds(q)
            lists = [asked.column(f"q_{c}").to_pylist() for c in ("id", "label", "lows", "highs")]
            for i, (own, label, lows, highs) in enumerate(zip(*lists, strict=True)):
                found, visited = shard.best(q[i], own, label, (one[i], two[i]), list(zip(lows, highs, strict=True)), k, same)
                out += [(own, slot, row, -below, visited) for slot, rows in enumerate(found) for below, row in rows]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=_FOUND.names)

    queries = queries.select("id", "label", "v", "lows", "highs")
    sent = queries.join(shards, "id") if shards is not None else queries.mapInArrow(routed, _SENT)
    sent = sent.select(*[F.col(c).alias(f"q_{c}") for c in _SENT.names]).withColumn("q_block", F.pmod(F.xxhash64("q_id"), F.lit(blocks).cast("long")))
    held = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = held.groupBy("shard", "block").cogroup(sent.groupBy("q_shard", "q_block")).applyInArrow(searched, _FOUND)
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """Hard negatives of every anchor: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Scores are integer inner products, higher first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of its label; for each, the first ``negatives`` rows
    of another label whose score is from ``low`` to ``high`` per cent of the positive's are returned (a negative positive
    score leaves no such row). Fewer rows or none are returned where there are fewer; an empty table gives an empty result.
    Which rows take part, see ``whole_vectors``; vectors of different length are as if shorter ones ended in zeros. Other columns
    are not read.
    """
    index, rows = build(whole_vectors(vectors, id_col, vector_col, label_col, scale))
    rows = cut(rows)
    anchors = rows.filter(F.col("id") % every == 0)
    open_ = anchors.withColumn("lows", F.array(F.lit(_LEAST))).withColumn("highs", F.array(F.lit(_MOST)))
    # an anchor's own shard gives a score that its positives reach at least, so that far shards need not be asked
    near = search(index, rows, open_, positives, True, anchors.select("id", "shard"))
    reached = near.filter(F.col("at") == positives).select(F.col("anchor").alias("id"), F.array("score").alias("reached"))
    asked = open_.join(reached, "id", "left").withColumn("lows", F.coalesce("reached", "lows"))
    top = cut(search(index, rows, asked, positives, True).select(F.col("anchor").alias("id"), F.col("at").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("p")))
    # the least and the largest whole score of a window, by whole numbers only
    up, down = f"p * {low} div 100 + if(p * {low} % 100 > 0, 1, 0)", f"p * {high} div 100 - if(p * {high} % 100 < 0, 1, 0)"
    lists = top.withColumn("low", F.expr(up)).withColumn("high", F.expr(down)).filter("low <= high")
    slots = lists.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high", "positive_id", "p"))).alias("w"))  # ``positives`` at most
    asked = anchors.join(slots, "id").withColumn("lows", F.col("w.low")).withColumn("highs", F.col("w.high"))
    found = search(index, rows, asked, negatives, False).select("anchor", "slot", "at", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = slots.select(F.col("id").alias("anchor"), F.posexplode("w").alias("slot", "w"))
    return found.join(known.withColumn("slot", F.col("slot").cast("long")), ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), F.col("w.positive_id").alias("positive_id"), F.col("at").alias("rank"),
        "negative_id", F.col("w.p").alias("positive_score"), "negative_score",
    )
