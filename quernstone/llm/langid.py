"""Language identification with bit-sliced Bloom filters of byte n-grams.

One filter answers for all languages at once: each slot holds a bit mask of languages (a
64-bit word for each 64 of them), an n-gram's languages are the AND of its slots. A document's score for a language is the
number of its n-grams that the language contains, less those that a filter this full
would report by chance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .common import cut, map_text

GRAM = 4  #: bytes
HASHES = 3
#: Slots of a filter at most (8 bytes each for each 64 languages), whatever the corpus: six for each of 1.4 million n-grams.
MOST_SLOTS = 1 << 23
#: Bytes of text whose n-grams are looked up at once.
PIECE = 256 << 10
#: Distinct n-grams that a task holds before it passes them on.
HELD = 1_000_000

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _fold() -> np.ndarray:
    """A-Z lower-cased; other ASCII that is no letter becomes a space; other bytes stay."""
    byte = np.arange(256)
    low = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    return np.where((low >= 128) | ((low >= 97) & (low <= 122)), low, 32).astype(np.uint8)


_FOLD = _fold()


def text_grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of each text, back to back, and the text that each belongs to.

    A text is padded with a space before and two after, so its ends count as word ends;
    runs of nothing but spaces are left out.
    """
    parts = [t or b"" for t in texts]
    size = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    if not size.sum():
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    code, inside = _codes(b"".join(b" " + p + b"  " for p in parts))
    n = len(code)
    owner = np.repeat(np.arange(len(parts)), size + 3)[:n]
    ends = np.cumsum(size + 3)  # a gram must not reach into the next text
    for back in (1, 2, 3):
        at = ends[:-1] - back
        inside[at[at < n]] = False
    return code[inside], owner[inside]


def _codes(padded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The code of each run of four bytes, and whether it is more than spaces."""
    raw = _FOLD[np.frombuffer(padded, np.uint8)].astype(np.uint32)
    n = len(raw) - 3
    code = raw[:n] << 24 | raw[1 : n + 1] << 16 | raw[2 : n + 2] << 8 | raw[3 : n + 3]
    return code, (code != 0x20202020) & ((raw[1 : n + 1] != 32) | (raw[2 : n + 2] != 32))


def gram_runs(texts: list[bytes | None], piece: int = PIECE):
    """``text_grams`` in runs of bounded size: several texts, or a part of a long one."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if held and size + n > piece:
            code, owner = text_grams(held)
            yield code, owner + first
            held, size = [], 0
        if n > piece:
            padded = b" " + t + b"  "
            for a in range(0, n, piece):  # parts overlap by three bytes, so each gram is in one of them
                code, inside = _codes(padded[a : min(a + piece, n) + 3])
                yield code[inside], np.full(int(inside.sum()), i)
            continue
        first = first if held else i
        held.append(t)
        size += n
    if held:
        code, owner = text_grams(held)
        yield code, owner + first


def slots_of(code: np.ndarray, bits: int) -> np.ndarray:
    """The slots of each code, one row for each hash."""
    out = np.empty((HASHES, len(code)), np.uint32)
    for i, m in enumerate(_MULTIPLIERS):
        h = (code ^ (code >> np.uint32(15 - i))) * m
        h ^= h >> np.uint32(13)
        out[i] = (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)
    return out


@dataclass
class Filters:
    """Trained filters: languages in order of their bits, and the slots' masks, a row for each 64 languages."""

    langs: list[str]
    bits: int
    masks: np.ndarray
    fallback: str

    def __post_init__(self) -> None:
        self._chance = self.by_chance()

    def by_chance(self) -> np.ndarray:
        """For each language, the share of unknown n-grams that its filter reports."""
        full = np.array([((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.langs))])
        return full**HASHES

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total, seen = np.zeros(len(texts)), np.zeros((len(self.langs), len(texts)))
        for code, owner in gram_runs([t.encode() if t else None for t in texts]):
            slots = slots_of(code, self.bits)
            total += np.bincount(owner, minlength=len(texts))
            for word, masks in enumerate(self.masks):
                mask = masks[slots[0]]
                for s in slots[1:]:
                    mask &= masks[s]
                for i in range(64 * word, min(64 * word + 64, len(self.langs))):
                    seen[i] += np.bincount(owner[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
        chance = self._chance[:, None]
        votes = np.maximum(0, (seen - total * chance) / np.maximum(1e-9, 1 - chance))
        best = votes.argmax(axis=0)
        top = votes[best, np.arange(len(texts))]
        second = np.sort(votes, axis=0)[-2] if len(self.langs) > 1 else np.zeros(len(texts))
        out, score = [], []
        for t, b, x, y in zip(texts, best.tolist(), top.tolist(), second.tolist(), strict=True):
            if not t or not any(map(str.isalpha, t)):
                out.append("und")
                score.append(0.0)
            elif x <= 0:
                out.append(self.fallback)
                score.append(0.0)
            else:
                out.append(self.langs[b])
                score.append(x / (x + y))
        return out, score


def count_grams(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """How often each n-gram occurs in each language: ``lang, gram, n``, summed over all rows."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged():
            for lang, runs in held.items():
                gram, at = np.unique(np.concatenate([g for g, _ in runs]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in runs])).astype(np.int64)
                yield lang, gram, n

        def rows(found):
            for lang, gram, n in found:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for code, owner in gram_runs(texts):
                of = langs[owner]
                for lang in set(of):
                    gram, n = np.unique(code[of == lang], return_counts=True)
                    held.setdefault(lang, []).append((gram, n))
                    size += len(gram)
                if size > HELD:
                    held = {lang: [(g, n)] for lang, g, n in merged()}
                    size = sum(len(r[0][0]) for r in held.values())
                    if size > HELD:
                        yield from rows(merged())
                        held, size = {}, 0
        yield from rows(merged())

    return df.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = 0.02, least: int = 2, most_slots: int = MOST_SLOTS) -> Filters:
    """Fit filters to all rows with a text and a language.

    A language contains an n-gram that occurs in it ``least`` times or more, and relatively
    at least ``share`` times as often as in the language where it is most common; this keeps
    out words of other languages that a text quotes. What comes to the driver is a row for each language, and a
    mask for each slot, ``most_slots`` at most for each 64 languages. Beyond a sixth as many n-grams the filters fill
    up: every n-gram keeps its slots, and more unknown ones are reported, which ``by_chance`` takes off the counts.
    Rows without a text or a language teach nothing; without any, every text is ``und``.
    """
    known = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = cut(count_grams(known.select(text_col, lang_col), text_col, lang_col))
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], 3, np.zeros((1, 8), np.uint64), "und")
    spark = df.sparkSession
    size = spark.createDataFrame([(lang, float(sizes[lang]), i) for i, lang in enumerate(langs)], "lang string, total double, bit int")
    rate = counts.join(F.broadcast(size), "lang").withColumn("rate", F.col("n") / F.col("total"))
    rate = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
    grams = rate.filter((F.col("n") >= least) & (F.col("rate") >= share * F.col("top")))
    masks = grams.groupBy("gram", (F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask"))
    n = masks.select("gram").distinct().count()
    bits = int(np.clip(np.ceil(np.log2(max(8, 6 * n))), 3, np.log2(most_slots)))

    def deal(batches):
        for batch in batches:
            slots = slots_of(batch.column(0).to_numpy().astype(np.uint32), bits)
            made = [np.tile(batch.column(i).to_numpy(), HASHES) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(slots.ravel().astype(np.int64)), *map(pa.array, made)], names=["slot", "word", "mask"])

    filled = masks.select("gram", "word", "mask").mapInArrow(deal, "slot long, word int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(((len(langs) + 63) // 64, 1 << bits), np.uint64)
    table[filled.word.to_numpy(np.int64), filled.slot.to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters(langs, bits, table, max(langs, key=lambda x: (sizes[x], x)))


_FIELDS = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predict(df: DataFrame, filters: Filters, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1: the best language's share of the two best counts).

    ``und`` with score 0 for a null text or one without a letter; a text with letters none of
    whose n-grams is known gets the most common language with score 0. Ties go to the first
    language in alphabetical order. Texts of any length are read whole; an empty table gives an
    empty result; input columns with the result's names are replaced.
    """
    shipped = df.sparkSession.sparkContext.broadcast(filters)

    def factory():
        def work(column: pa.Array) -> list[pa.Array]:
            if not shipped.value.langs:
                return [pa.array(["und"] * len(column), pa.string()), pa.array([0.0] * len(column))]
            lang, score = shipped.value.decide(column.to_pylist())
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return work

    return map_text(df, text_col, _FIELDS, factory, keep)
