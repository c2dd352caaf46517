"""A toxicity classifier over bags of subwords.

A word is the mean of the embeddings of its character n-grams and of itself, a text the mean of its words, and a linear
softmax on that mean gives the classes. Embeddings and softmax are trained together, in numpy. An unseen spelling of a word shares most
of its n-grams with the spellings seen in training.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import map_text

#: Labelled texts of each class that the fit uses at most, and the bytes of text of both classes together.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 24 << 20
#: Lengths of n-grams, slots for them, and the length of an embedding.
GRAMS, SLOTS, WIDTH = (3, 4, 5), 1 << 18, 8
#: Words that a task remembers, the longest of them, and characters of a text that are split into words at once.
HELD_WORDS, HELD_LENGTH, PIECE = 200_000, 40, 1 << 20

#: Frequent words weigh less: a word with a share of p of all words weighs DAMPING / (DAMPING + p). GAIN only scales the parameters.
#: PADDING words that say nothing are part of every text, so a few words alone decide little.
DAMPING, GAIN, PADDING = 1e-3, 100.0, 10.0

_WORD, _END = re.compile(r"\w+"), re.compile(r"\W")


@dataclass
class Model:
    """The logit of the positive class by slot, its intercept, and the weights of frequent words."""

    slots: np.ndarray
    intercept: float
    common: dict[str, float]


def subwords(word: str) -> list[int]:
    """The slots of a word's n-grams, marked at both ends, and of the word itself."""
    marked = f"<{word}>"
    found = {marked}
    for n in GRAMS:
        found.update([marked[i : i + n] for i in range(len(marked) - n + 1)])
    return [zlib.crc32(g.encode()) % SLOTS for g in found]


def words_of(text: str):
    """The words of a text in lower case, piece by piece; pieces end between words."""
    start = 0
    while start < len(text):
        after = _END.search(text, start + PIECE) if start + PIECE < len(text) else None
        end = after.start() if after else len(text)
        yield _WORD.findall(text[start:end].lower())
        start = end


class _Mean:
    """A sparse matrix of which each row averages embeddings; products with it and its transpose by sums of runs."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.shape, self.forth = shape, (column, value.astype(np.float32)[:, None], *self._runs(row))
        order = np.argsort(column, kind="stable")
        self.back = (row[order], self.forth[1][order], *self._runs(column[order]))

    @staticmethod
    def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        return keys[starts], starts

    @staticmethod
    def _product(parts, dense: np.ndarray, n: int) -> np.ndarray:
        other, value, keys, starts = parts
        out = np.zeros((n, dense.shape[1]), np.float32)
        if len(starts):
            out[keys] = np.add.reduceat(dense[other] * value, starts, axis=0)
        return out

    def times(self, dense: np.ndarray) -> np.ndarray:
        return self._product(self.forth, dense, self.shape[0])

    def transposed_times(self, dense: np.ndarray) -> np.ndarray:
        return self._product(self.back, dense, self.shape[1])


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, rounds: int = 60, more: int = 100, rate: float = 0.1, lasso: float = 1.5, seed: int = 0) -> Model:
    """Embeddings and softmax together, by Adam over all texts at once; ``weight`` weighs texts.

    Slots outnumber texts by far, so the first rounds shrink each slot's embedding (a group lasso, by ``lasso`` times the typical gradient)
    until only slots that tell the classes apart are left; the other rounds train these without shrinking. Words of one or two
    texts are left out, so that no text is known by a word of its own.
    """
    bags = []
    for t in texts:
        counts: Counter[str] = Counter()
        for words in words_of(t):
            counts.update(words)
        bags.append(counts)
    every: Counter[str] = Counter()
    for b in bags:
        every.update(b)
    total = max(1, every.total())
    common = {w: DAMPING / (DAMPING + n / total) for w, n in every.items() if n / total > DAMPING / 20}
    seen = Counter(w for b in bags for w in b)
    vocabulary = {w: i for i, w in enumerate(w for w, n in seen.items() if n > 2)}
    rows, columns, values = [], [], []
    for i, b in enumerate(bags):
        whole = PADDING + sum(n * common.get(w, 1.0) for w, n in b.items())
        some = [w for w in b if w in vocabulary]
        rows.append(np.full(len(some), i))
        columns.append(np.fromiter((vocabulary[w] for w in some), np.int64, len(some)))
        values.append(np.fromiter((b[w] * common.get(w, 1.0) / whole for w in some), np.float32, len(some)))
        b.clear()
    row, column, value = (np.concatenate(x) for x in (rows, columns, values))
    del bags, seen, every, rows, columns, values
    in_texts = _Mean(row, column, value * GAIN, (len(texts), len(vocabulary)))
    lists = [np.array(subwords(w), np.int64) for w in vocabulary]
    sizes = np.array([len(x) for x in lists], np.int64)
    word = np.repeat(np.arange(len(lists)), sizes)
    used, at = np.unique(np.concatenate([np.empty(0, np.int64), *lists]), return_inverse=True)
    del lists
    each = 1 / sizes[word]
    in_words = _Mean(word, at, each, (len(vocabulary), len(used)))

    rng = np.random.default_rng(seed)
    what = [rng.normal(0, 0.01, (len(used), WIDTH)).astype(np.float32), rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)]
    what.append(np.log(np.maximum([weight[y == 0].sum(), weight[y == 1].sum()], 1e-9)).astype(np.float32))
    target, share = np.eye(2)[y.astype(int)], (weight / weight.sum())[:, None]
    for shrink, most in ((lasso, rounds), (0.0, more)):
        first, second, typical = [np.zeros_like(x) for x in what], [np.zeros_like(x) for x in what], None
        for k in range(1, most + 1):
            mean = in_texts.times(in_words.times(what[0]))
            logits = mean @ what[1] + what[2]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            off = ((p / p.sum(axis=1, keepdims=True) - target) * share).astype(np.float32)
            gradients = [in_words.transposed_times(in_texts.transposed_times(off @ what[1].T)), mean.T @ off, off.sum(axis=0)]
            typical = typical or [float(np.sqrt((g * g).mean())) + 1e-12 if g.size else 1.0 for g in gradients]
            for i, g in enumerate(gradients):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.99 * second[i] + 0.01 * g * g
                what[i] -= rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + typical[i])
            if shrink:
                size = np.linalg.norm(what[0], axis=1, keepdims=True)
                step = rate / (np.sqrt((second[0] / (1 - 0.99**k)).mean(axis=1, keepdims=True)) + typical[0])
                what[0] *= np.maximum(0, 1 - step * shrink * typical[0] * WIDTH**0.5 / np.maximum(size, 1e-12))
        if shrink:
            alive = np.flatnonzero(what[0].any(axis=1))
            kept = np.isin(at, alive)
            in_words = _Mean(word[kept], np.searchsorted(alive, at[kept]), each[kept], (len(vocabulary), len(alive)))
            used, what[0] = used[alive], what[0][alive]
    logit = np.zeros(SLOTS, np.float32)
    logit[used] = GAIN * (what[0] @ (what[1][:, 1] - what[1][:, 0]))
    return Model(logit, float(what[2][1] - what[2][0]), common)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit to whole texts of at most ``rows`` labelled ids of each class, the first by a hash of the id.

    An id with several labels has the largest. Ids are chosen from the labels alone and their texts found by a
    broadcast of ``2 * rows`` ids. Each class takes texts up to half of ``most_bytes``, in order of the hash, those over a 64th of
    ``most_bytes`` last and the shortest of these first, and at least one. Null texts are left out, equal texts of an id
    count once. Texts are weighed so that each class has its share of all labels. With one class only, or none, every
    text scores that class's (or an even) rate.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("o")).agg(F.max(label_col).cast("int").alias("y"))
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    h = F.xxhash64("o")
    some = [known.filter(F.col("y") == y).orderBy(h, "o").limit(rows) for y in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))
    texts = df.select(F.col(f"`{id_col}`").alias("o"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t is not null").join(ids, "o")
    n = F.octet_length("t")
    long = F.when(n > most_bytes // 64, n).otherwise(0)
    taken = []
    for y in (0, 1):  # sizes first, so that only texts within the bound reach the driver
        sizes = texts.filter(F.col("y") == y).select("o", F.xxhash64("t").alias("th"), n.alias("n"), long.alias("long")).distinct().orderBy("long", h, "o", "th").limit(2 * rows).collect()
        used = 0
        for k, r in enumerate(sizes):
            if k and used + r.n > most_bytes // 2:
                break
            used += r.n
            taken.append((r.o, r.th))
    if len(count) < 2 or not taken:
        rate = 0.0 if not count or not taken else 6.0 if 1 in count else -6.0
        return Model(np.zeros(SLOTS, np.float32), rate, {})
    wanted = df.sparkSession.createDataFrame(taken, known.select("o", F.lit(0).cast("long").alias("th")).schema)
    found = texts.withColumn("th", F.xxhash64("t")).join(F.broadcast(wanted), ["o", "th"]).dropDuplicates(["o", "th"]).orderBy("y", h, "o", "th").collect()
    y = np.array([r.y for r in found])
    share = {v: count[v] / sum(count.values()) / max(1, int((y == v).sum())) for v in (0, 1)}
    return train([r.t for r in found], y, np.where(y == 1, share[1], share[0]))


_FIELDS = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


class _Logits(dict):
    """The logit that a word adds, computed when first asked for; forgets all when it is full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.alive = {i: float(model.slots[i]) for i in np.flatnonzero(model.slots).tolist()}  # few: the fit leaves out the others

    def __missing__(self, word: str) -> tuple[float, float]:
        weight = self.model.common.get(word, 1.0)
        slots = subwords(word)
        found = weight * sum([self.alive[s] for s in slots if s in self.alive]) / len(slots), weight
        if len(word) <= HELD_LENGTH:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = found
        return found


def logit(text: str, words: _Logits) -> float:
    """The logit of a text: what its words add, averaged over them and the padding."""
    added, whole = 0.0, PADDING
    for piece in words_of(text):
        for a, w in map(words.__getitem__, piece):
            added, whole = added + a, whole + w
    return words.model.intercept + added / whole


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, higher: toxic is likelier) and ``predicted`` (1 from ``threshold`` on).

    Whole texts are read, in pieces that end between words. A null text counts as empty, an empty one scores the rate of
    the labels; repeated rows score alike. Input columns with the result's names are replaced; an empty table gives an
    empty result.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        words = _Logits(shipped.value)

        def work(column: pa.Array) -> list[pa.Array]:
            z = np.array([logit(t or "", words) for t in column.to_pylist()], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

        return work

    return map_text(df, text_col, _FIELDS, factory, keep)
