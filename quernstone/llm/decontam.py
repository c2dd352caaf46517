"""Benchmark decontamination by winnowing.

A fingerprint is the smallest k-gram hash of each window of consecutive k-grams. With
k-grams of 5 words and windows of 6, any two texts that share 10 consecutive words select
the same k-gram from them, so looking up a document's fingerprints among the benchmark's
finds every shared span of at least 10 words. Each hit is then extended to the span's
10-word windows and compared word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from . import grams
from .common import cut, map_text, slices

#: Benchmark windows up to this many are sent to every task (about 200 bytes each); beyond
#: it, windows are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
#: Bits of a sieve of hashes (2 MB).
SIEVE = 1 << 24


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each run of ``window`` hashes; of equal ones the last."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        lower = hashes[j : j + n] <= best
        best = np.where(lower, hashes[j : j + n], best)
        at = np.where(lower, np.arange(j, j + n), at)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]  # positions never fall


def _windows(w: grams.Words, text: int, span: int) -> range:
    """First words of a benchmark item's windows: every ``span`` words, or the whole short item."""
    a, b = int(w.first[text]), int(w.first[text + 1])
    return range(a, max(a + 1, b - span + 1)) if b > a else range(0)


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, k: int, span: int) -> DataFrame:
    """Windows of the benchmark: ``item``, ``words`` (space-joined), ``n`` words, ``hash``, ``fp``.

    ``fp`` is the window's fingerprint: the smallest k-gram hash, or for a window of fewer
    than ``span`` words the hash of all its words. A window that an item holds twice is there twice.
    """

    def run(batches):
        for batch in batches:
            for first, piece in slices(batch.column(1)):
                w = grams.words(piece.cast(pa.binary()).to_pylist(), "alnum")
                ids, out = batch.column(0).slice(first, len(piece)).to_pylist(), ([], [], [], [], [])
                for t, item in enumerate(ids):
                    for i in _windows(w, t, span):
                        n = min(span, int(w.first[t + 1]) - i)
                        h = w.hash[i : i + n]
                        fp = grams.shingles(h, k).min() if n == span else grams.sequence_hash(h)
                        for column, value in zip(out, (item, _joined(w, i, n), n, int(grams.sequence_hash(h).view(np.int64)), int(fp.view(np.int64))), strict=True):
                            column.append(value)
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["item", "words", "n", "hash", "fp"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.filter("item is not null and text is not null").mapInArrow(run, "item string, words string, n long, hash long, fp long")


def _joined(w: grams.Words, i: int, n: int) -> str:
    return b" ".join(w.text(i, n)).decode("utf-8", "surrogateescape")


class _Benchmark:
    """The windows, as arrays to look up document fingerprints in."""

    def __init__(self, rows: list[tuple], k: int, span: int) -> None:
        self.k, self.span = k, span
        self.by_hash: dict[int, list[tuple[bytes, list[str]]]] = {}
        self.lengths = sorted({r[2] for r in rows if r[2] < span})
        self.fps = np.unique(np.array([r[4] for r in rows], np.int64).view(np.uint64))
        self.hashes = np.unique(np.array([r[3] for r in rows], np.int64).view(np.uint64))
        items: dict[tuple[int, bytes], set[str]] = {}
        for item, words, _, h, _ in rows:
            items.setdefault((h, words.encode("utf-8", "surrogateescape")), set()).add(item)
        for (h, words), names in items.items():
            self.by_hash.setdefault(h, []).append((words, sorted(names)))

    def _among(self, values: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return known[at] == values

    def hits(self, w: grams.Words) -> list[tuple[int, int, list[str]]]:
        """Occurrences of windows, in all texts of the batch: first word, words, items."""
        ends = np.repeat(w.first[1:], np.diff(w.first))  # of each word's text
        candidates = []
        for n in self.lengths:
            h = grams.shingles(w.hash, n)
            at = np.flatnonzero(self._among(h, self.fps))
            candidates.append((n, at, h))
        runs = grams.shingles(w.hash, self.k)
        wide = self.span - self.k + 1
        # Fingerprints first: which k-grams that some window of this batch selects are the benchmark's?
        picked = winnow(runs, wide)
        picked = picked[self._among(runs[picked], self.fps)]
        if len(picked):
            h = grams.shingles(w.hash, self.span)
            at = np.unique((picked[:, None] - np.arange(wide)[None, :]).ravel())  # extended to each window with it
            candidates.append((self.span, at[(at >= 0) & (at < len(h))], h))
        found = []
        for n, at, h in candidates:
            at = at[at + n <= ends[at]] if len(at) else at
            at = at[self._among(h[at], self.hashes)] if len(at) else at
            for i in at.tolist():
                words = b" ".join(w.text(i, n))
                found += [(i, n, items) for known, items in self.by_hash.get(int(h[i].view(np.int64)), ()) if known == words]
        return found


_FIELDS = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("n_items", LongType()),
        StructField("items_sha256", StringType()),
        StructField("contaminated", BooleanType()),
    ]
)


def _summary(w: grams.Words, found: list[tuple[int, int, list[str]]]) -> list[pa.Array]:
    hit = np.zeros(len(w.hash) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for i, n, names in found:
        hit[i] += 1
        hit[i + n] -= 1
        items.setdefault(int(np.searchsorted(w.first, i, "right")) - 1, set()).update(names)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
    n_words, n_hit = np.diff(w.first), np.diff(covered[w.first])
    empty = hashlib.sha256(b"").hexdigest()
    digest = [hashlib.sha256(",".join(sorted(items[t])).encode()).hexdigest() if t in items else empty for t in range(len(n_words))]
    return [pa.array(n_words), pa.array(n_hit), pa.array([len(items.get(t, ())) for t in range(len(n_words))]), pa.array(digest, pa.string()), pa.array(n_hit > 0)]


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    bench_id: str = "item_id",
    bench_text: str = "text",
    k: int = 5,
    span: int = 10,
    keep: list[str] | None = None,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Mark the words of each document that lie in a window of the benchmark.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A window is
    ``span`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Adds ``n_words, n_hit, n_items, items_sha256, contaminated`` to the columns ``keep``
    (default: all); an input column of such a name is replaced.

    * A null or empty text has no words and no hit. Items without words or with a null id are ignored.
    * Repeated items and repeated rows change nothing for other rows. Ids of documents are not read.
    * An empty benchmark leaves every document clean; an empty table gives an empty result.
    * A benchmark of more than ``broadcast_windows`` windows is joined by a shuffle instead of being
      sent to every task, with the same result.
    """
    windows = benchmark_windows(benchmark, bench_id, bench_text, k, span)
    some = windows.limit(broadcast_windows + 1).collect()
    if len(some) > broadcast_windows:
        return _by_join(df, windows, text_col, k, span, keep)
    return map_text(df, text_col, _FIELDS, _look_up(df, some, k, span), keep)


def drop_contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    bench_id: str = "item_id",
    bench_text: str = "text",
    k: int = 5,
    span: int = 10,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Keep the documents without a hit, with all their columns as they were, whatever their names.

    Cases are those of ``decontaminate``: null and empty texts are clean, repeated rows stay or go together, an empty
    benchmark drops nothing.
    """
    windows = benchmark_windows(benchmark, bench_id, bench_text, k, span)
    some = windows.limit(broadcast_windows + 1).collect()
    if len(some) <= broadcast_windows:
        return map_text(df, text_col, _CLEAN, _look_up(df, some, k, span, clean=True), only="clean")
    names = [f"c{i}" for i in range(len(df.columns))]
    marked = _by_join(df.toDF(*names), windows, names[df.columns.index(text_col)], k, span, names)
    return marked.filter(~F.col("contaminated")).select(names).toDF(*df.columns)


_CLEAN = StructType([StructField("clean", BooleanType())])


def _look_up(df: DataFrame, rows: list, k: int, span: int, clean: bool = False):
    known = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def factory():
        bench = _Benchmark(known.value, k, span)

        def work(column: pa.Array) -> list[pa.Array]:
            w = grams.words(column.cast(pa.binary()).to_pylist(), "alnum")
            made = _summary(w, bench.hits(w))
            return [pc.invert(made[-1])] if clean else made

        return work

    return factory


class _Sieve:
    """A bit for each of ``SIEVE`` hash ranges; tells which hashes may be known."""

    def __init__(self, buckets: list) -> None:
        bits = np.zeros(SIEVE // 8, np.uint8)
        for bucket, part in buckets:
            bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
        self._bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(SIEVE - 1)).astype(np.int64)
        return (self._bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sieve(hashes: DataFrame, column: str) -> list:
    """The occupied ranges as bitmaps of 4096 bytes, ``SIEVE / 8`` bytes at most."""
    place = (F.col(column).bitwiseAND(F.lit(SIEVE - 1)) + 1).alias("place")
    bits = hashes.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")))
    return [(r[0], bytes(r[1])) for r in bits.collect()]


def _by_join(df: DataFrame, windows: DataFrame, text_col: str, k: int, span: int, keep: list[str] | None) -> DataFrame:
    """The same for a benchmark too large to send to every task.

    Bitmaps of a fixed size, of the benchmark's fingerprints and window hashes, sieve each document's fingerprints
    and the windows around them where the text is read. What passes leaves the task as its words and meets the
    benchmark's windows in a shuffle join on those. A checkpoint of the documents with their candidates fixes a number
    for each row, by which hits come back; ids of documents may repeat. The items of a set of windows are looked up
    once, however many documents have that set; a set's list of items is one row.
    """
    windows = cut(windows.distinct())
    lengths = sorted(r.n for r in windows.select("n").filter(F.col("n") < span).distinct().collect())  # span - 1 rows at most
    kind = pa.list_(pa.struct([("i", pa.int64()), ("n", pa.int64()), ("words", pa.string())]))
    sent = df.sparkSession.sparkContext.broadcast([_sieve(windows, c) for c in ("fp", "hash")])
    wide = span - k + 1

    def factory():
        may_fp, may_hash = map(_Sieve, sent.value)

        def work(column: pa.Array) -> list[pa.Array]:
            w = grams.words(column.cast(pa.binary()).to_pylist(), "alnum")
            ends = np.repeat(w.first[1:], np.diff(w.first))
            runs, whole = grams.shingles(w.hash, k), grams.shingles(w.hash, span)
            picked = winnow(runs, wide)
            picked = picked[may_fp(runs[picked])]
            at = np.unique((picked[:, None] - np.arange(wide)[None, :]).ravel())
            tries = [(span, at[(at >= 0) & (at < len(whole))], whole)]
            for n in lengths:
                h = grams.shingles(w.hash, n)
                tries.append((n, np.arange(len(h)), h))
            found: list[list[dict]] = [[] for _ in range(len(column))]
            for n, at, h in tries:
                at = at[at + n <= ends[at]] if len(at) else at
                at = at[may_hash(h[at])] if len(at) else at
                for i, t in zip(at.tolist(), (np.searchsorted(w.first, at, "right") - 1).tolist(), strict=True):
                    found[t].append({"i": i - int(w.first[t]), "n": n, "words": _joined(w, i, n)})
            return [pa.array(np.diff(w.first)), pa.array(found, kind)]

        return work

    window = StructType([StructField("i", LongType()), StructField("n", LongType()), StructField("words", StringType())])
    fields = StructType([StructField("n_words", LongType()), StructField("__candidates", ArrayType(window))])
    own = {c: f"c{i}" for i, c in enumerate(df.columns)}  # names that none of the columns below has
    passed = [c for c in df.columns if c not in _FIELDS.names and (keep is None or c in keep)]
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    rows = cut(map_text(df, own[text_col], fields, factory, [own[c] for c in passed]).withColumn("__id", F.monotonically_increasing_id()))
    tried = rows.filter(F.size("__candidates") > 0).select("__id", F.inline("__candidates"))
    # both sides are plain shuffles, so a window that a third of all documents have is split
    hits = cut(tried.join(cut(windows.select("words").distinct()), "words", "left_semi"))
    # Words under overlapping windows count once: each window adds what lies beyond the ends of those before it.
    before = Window.partitionBy("__id").orderBy("i", "n").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("i") + F.col("n")).over(before), F.lit(0))
    fresh = hits.select("__id", F.greatest(F.lit(0), F.col("i") + F.col("n") - F.greatest("i", reach)).alias("fresh"))
    n_hit = fresh.groupBy("__id").agg(F.sum("fresh").alias("n_hit"))
    sets = hits.groupBy("__id").agg(F.array_sort(F.collect_set("words")).alias("words")).withColumn("set", F.sha2(F.array_join("words", ","), 256))
    items = sets.groupBy("set").agg(F.any_value("words").alias("words")).select("set", F.explode("words").alias("words"))
    items = items.join(windows.select("words", "item"), "words").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    out = rows.join(n_hit, "__id", "left").join(sets.select("__id", "set").join(items, "set"), "__id", "left")
    return out.select(
        *[F.col(own[c]).alias(c) for c in passed],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(b""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
