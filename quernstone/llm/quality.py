"""A quality classifier that compresses.

Two zstandard dictionaries are made from labelled texts, one from good and one from bad
ones. A text is compressed with either; the difference of the sizes, normalised by the
text's own, is calibrated to a probability by logistic regression on labelled texts that the
dictionaries have not seen. Nothing else enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .common import map_text

#: Labelled rows of each class that the fit uses at most, and the bytes of all of them together.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20
#: Bytes of labelled text in a dictionary, and the level at which texts are compressed.
DICTIONARY_BYTES, LEVEL = 1 << 20, 6


@dataclass
class Model:
    """Dictionaries and the calibration: intercept and slope."""

    good: bytes
    bad: bytes
    weights: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [_compressor(d) for d in (self.good, self.bad)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content)


def make_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of raw content: whole texts up to ``size``; where the first is longer, its end."""
    held, used = [], 0
    for t in samples:
        if used + len(t) <= size:
            held.append(t)
            used += len(t)
    return b"\n".join(held or samples[:1])[-size:]


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """How much smaller the good dictionary makes a text than the bad one, as a share of the text."""
    return (len(bad.compress(text)) - len(good.compress(text))) / (len(text) + 64)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression; the first column of ``x`` is constant.

    Newton's method on standardised columns. A step is halved until it lowers the loss, and a ridge keeps separable
    classes finite.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[scale < 1e-12] = 0.0, 1.0
    z, sign = (x - mean) / scale, 2 * y - 1
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -sign * (z @ w))).sum() + (penalty * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            break
        w = w - size * step
    out = w / scale
    out[0] -= (w * mean / scale)[1:].sum()
    return out


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit to the texts of at most ``rows`` labelled ids of each class, chosen by a hash of the id.

    Ids are chosen from the labels alone, so the texts are filtered by a broadcast of ``2 * rows`` ids and never
    shuffled. Null texts are left out; whole texts are used, and a class stops before the text that would
    take it over half of ``most_bytes``. Texts over a 64th of ``most_bytes`` come last, the shortest first, so
    they keep no shorter one out; where all texts of a class are over its half, the start of the shortest is used. Two of three texts make the dictionaries, the third calibrates;
    calibration weighs the classes by their counts over all labels. With one class only, or none,
    every text scores that class's (or an even) rate.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("o"), F.col(label_col).alias("y"))
    known = known.withColumn("h", F.xxhash64("o"))
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    some = [known.filter(F.col("y") == y).orderBy("h", "o").limit(rows) for y in (0, 1)]
    chosen = df.select(F.col(id_col).alias("o"), F.col(text_col).alias("t")).join(F.broadcast(some[0].unionByName(some[1])), "o").filter("t is not null")
    n, most = F.octet_length("t"), most_bytes // 2
    order = [F.when(n > most_bytes // 64, n).otherwise(0), "h", "o", "t"]
    by_class = Window.partitionBy("y").orderBy(*order)
    chosen = chosen.withColumn("size", F.sum(n).over(by_class)).withColumn("at", F.row_number().over(by_class)).filter((F.col("size") <= most) | (F.col("at") == 1))
    whole = F.when(n <= most, F.col("t")).otherwise(F.substring("t", 1, most // 4))  # a character has up to 4 bytes
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in chosen.orderBy("y", "at").select("y", whole.alias("t")).collect():
        texts[r.y].append(r.t.encode())
    if not texts[0] or not texts[1]:
        rate = 0.0 if not texts[0] and not texts[1] else 6.0 if texts[1] else -6.0
        return Model(b"", b"", np.array([rate, 0]))
    good, bad = (make_dictionary([t for i, t in enumerate(texts[y]) if i % 3] or texts[y]) for y in (1, 0))
    model = Model(good, bad, np.zeros(2))
    pair = model.compressors()
    unseen = [(t, y) for y in (0, 1) for i, t in enumerate(texts[y]) if i % 3 == 0]
    y = np.array([v for _, v in unseen], float)
    x = _columns([difference(t, *pair) for t, _ in unseen])
    share = {v: count[v] / sum(count.values()) / (y == v).mean() for v in (0, 1)}
    model.weights = _logistic(x, y, np.where(y == 1, share[1], share[0]))
    return model


def _columns(d: list[float]) -> np.ndarray:
    return np.stack([np.ones(len(d)), np.array(d, float)], axis=1)


_FIELDS = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("good", BooleanType())])


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (0 to 1, higher: good is likelier) and ``predicted`` (1 from ``threshold`` on).

    A null text counts as empty and is scored like any text; whole texts are compressed, however
    long. Input columns with the result's names are replaced; an empty table gives an empty result.
    """
    return map_text(df, text_col, StructType(_FIELDS.fields[:2]), _scorer(df, model, threshold, 2), keep)


def keep_good(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is ``threshold`` or more, with all their columns as they were, whatever their names.

    Cases are those of ``score``: a null text counts as empty, repeated rows stay or go together.
    """
    return map_text(df, text_col, _FIELDS, _scorer(df, model, threshold, 3), only="good")


def _scorer(df: DataFrame, model: Model, threshold: float, n: int):
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        model = shipped.value
        pair = model.compressors()

        def work(column: pa.Array) -> list[pa.Array]:
            x = _columns([difference(t or b"", *pair) for t in column.cast(pa.binary()).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(p >= threshold)][:n]

        return work

    return factory
