"""Spelling variants of a corpus's words, by PartEnum signatures.

A word's letters are a multiset, and a multiset is a binary vector: one dimension for each letter and occurrence.
Words that differ by one replaced letter have vectors at Hamming distance two, words that differ by one inserted letter
at distance one. The dimensions are dealt into parts; of vectors at distance k all but k parts are equal, so two words
share one of the signatures that leave out each choice of k parts. Signatures are equi-joined and candidates verified
where the join meets them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import cut, slices

#: Parts of the dimensions for words of one length (two parts are left out) and of lengths that differ by one (one is).
SAME_PARTS, LONGER_PARTS = 6, 4
#: Words that a task counts before it hands them on, the text they may come from, and the characters taken at once.
HELD_WORDS, HELD_BYTES, PIECE = 100_000, 32 << 20, 256 << 10

_LETTERS = "A-Za-zÀ-ÿ"
_END = re.compile(f"[^{_LETTERS}]")


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, damage: int | None = None) -> DataFrame:
    """``word, n``: the words of all texts with ``shortest`` code points and more that occur ``least`` times and more.

    Words are maximal runs of Latin letters, with A to Z in lower case. With ``damage``, a word of a document whose crc32
    of ``id:word`` is a multiple of it loses the code point at that crc32 modulo its length, before lengths are
    looked at, wherever it stands in the document; so variants that are known can be planted. Null texts have no words, a
    null id counts as empty text, repeated rows count each time, other columns are not read. Texts are read in pieces
    that end between words; a task hands on its counts from time to time.
    """
    runs = re.compile(f"[{_LETTERS}]{{{shortest},}}")

    def pieces(text: str):
        start = 0
        while start < len(text):
            after = _END.search(text, start + PIECE) if start + PIECE < len(text) else None
            end = after.start() if after else len(text)
            yield text[start:end]
            start = end

    def handed(counts: Counter) -> pa.RecordBatch:
        some = {w: n for w, n in counts.items() if n > 0}
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(some.values(), pa.int64())], names=["word", "n"])

    def work(batches):
        counts: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for first, column in slices(batch.column(1)):
                ids = batch.column(0).slice(first, len(column)).to_pylist()
                for doc, raw in zip(ids, column.cast(pa.binary()).to_pylist(), strict=True):
                    if not raw:
                        continue
                    held += len(raw)
                    start = zlib.crc32(f"{doc or ''}:".encode())
                    for piece in pieces(raw.lower().decode()):  # of bytes, only A to Z have a lower case
                        found = runs.findall(piece)
                        counts.update(found)
                        for w in [w for w in set(found) if damage and zlib.crc32(w.encode(), start) % damage == 0]:
                            n, at = found.count(w), zlib.crc32(w.encode(), start) % len(w)
                            counts[w] -= n
                            if len(w) > shortest:
                                counts[w[:at] + w[at + 1 :]] += n
                if len(counts) > HELD_WORDS or held > HELD_BYTES:
                    yield handed(counts)
                    held = 0
        yield handed(counts)

    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    each = texts.mapInArrow(work, StructType([StructField("word", StringType()), StructField("n", LongType())]))
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


@lru_cache(1 << 16)
def _dimension(letter: str, occurrence: int, parts: int) -> tuple[int, int]:
    """The part of a dimension, and its hash: the mixing steps of splitmix64."""
    x = (ord(letter) << 32 | occurrence) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (ord(letter) + 5 * occurrence) % parts, x ^ x >> 31


def signatures(word: str, parts: int, left_out: int, length: int) -> list[int]:
    """A signature for each choice of ``left_out`` parts: the hash of the other parts, the choice, and ``length``."""
    sums, seen = [0] * parts, {}
    for c in word:
        seen[c] = n = seen.get(c, 0) + 1
        part, h = _dimension(c, n, parts)
        sums[part] += h
    whole, out = sum(sums), []
    for i, gone in enumerate(combinations(range(parts), left_out)):
        h = whole - sum(sums[p] for p in gone) + _dimension(chr(left_out), length << 8 | i, 1)[1]
        out.append((h + (1 << 63)) % (1 << 64) - (1 << 63))
    return out


_SIGNED = StructType([StructField(n, t) for n, t in (("sig", LongType()), ("word", StringType()), ("n", LongType()), ("size", IntegerType()), ("head", IntegerType()), ("tail", IntegerType()))])


def _signed(words: DataFrame, longer: bool) -> DataFrame:
    """A row for each signature of each word: those of its length, and those of it as the longer or the shorter of two.

    ``head`` and ``tail`` are hashes of the halves of which one is equal in two words that differ by one letter.
    """

    def half(text: str) -> int:
        return zlib.crc32(text.encode()) - (1 << 31)

    def work(batches):
        for batch in batches:
            for first in range(0, len(batch), 4096):
                some = batch.slice(first, 4096)
                out: list[list] = [[] for _ in _SIGNED]
                for w, n in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    same, short = len(w), len(w) - longer
                    for sigs, h, t in ((signatures(w, SAME_PARTS, 2, same), same // 2, same - same // 2), (signatures(w, LONGER_PARTS, 1, short), short // 2, short // 2)):
                        k, ends = len(sigs), (half(w[:h]), half(w[len(w) - t :]))
                        for column, values in zip(out, (sigs, [w] * k, [n] * k, [same] * k, [ends[0]] * k, [ends[1]] * k), strict=True):
                            column += values
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=_SIGNED.names)

    return words.select("word", "n").mapInArrow(work, _SIGNED)


def near_words(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words that differ by exactly one inserted, deleted or replaced code point, once.

    ``words`` has ``word`` (distinct, not null) and ``n``. Candidates share a signature; the join itself keeps those
    with an equal half and one edit, so no other pair leaves it. An empty table has no pairs.
    """
    a, b = _signed(words, False).alias("a"), _signed(words, True).alias("b")

    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    ordered = (of("a", "size") < of("b", "size")) | (of("a", "word") < of("b", "word"))
    half = (of("a", "head") == of("b", "head")) | (of("a", "tail") == of("b", "tail"))
    edit = F.levenshtein(of("a", "word"), of("b", "word"), 1) == 1
    pairs = a.join(b, (of("a", "sig") == of("b", "sig")) & ordered & half & edit)
    return pairs.select(of("a", "word").alias("a"), of("a", "n").alias("a_n"), of("b", "word").alias("b"), of("b", "n").alias("b_n")).distinct()


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``words`` (``word``, distinct and not null, and ``n``).

    A word's form is the near word of largest ``n`` (ties: the smallest in code-point order), if it occurs at least
    ``times`` as often; its root is where its forms end, the word itself if it has none. ``times`` is over 1, so forms
    can't go in circles. Words without a near word have ``n_near`` 0 and null ``form`` and ``form_n``. An empty table gives
    an empty result.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its variant")
    words = cut(words.select("word", "n"))
    pairs = near_words(words)
    each = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m"))))
    near = pairs.select(each.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    frequent = -F.col("best.m") >= times * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n"),
    )
    known = cut(known)
    roots = _roots(known.filter("form is not null").select("word", F.col("form").alias("root")))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """Follow ``root`` to the end by pointer jumping: each round doubles the steps that a row has gone."""
    roots = cut(forms)
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        gone = cut(roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        roots = gone.select("word", "root")
        if gone.filter("moved").isEmpty():
            return roots
