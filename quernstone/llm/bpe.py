"""Byte-level BPE: encoding by a tree of joins, decoding by concatenation.

A text is halved until its pieces are short, the pieces are encoded, and neighbours are
joined up the tree. Where two pieces meet, tokens may differ from those of the whole text.
A join therefore re-encodes a window around the seam. The window grows on either side
until it ends where a word character is followed by white space: no match of the pattern
holds a non-space and then a space, and no match looks beyond such a place, so the pattern
matches the two sides of it separately in whatever text surrounds it. Tokens outside the
window are then those of the whole text. Joining is associative: any tree gives the same
result.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import map_text, slices

#: Characters of a piece that is encoded at once (ids of one that is decoded at once), and of the first window on
#: each side of a seam.
LEAF, WINDOW = 512, 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeCodec:
    """Encode and decode texts by the tree of joins."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW) -> None:
        self._base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._leaf, self._window = leaf, window
        self._bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token

    def _piece(self, text: str) -> np.ndarray:
        return self._base.encode_to_numpy(text, disallowed_special=())

    def _left(self, text: str, lo: int, cut: int) -> int:
        """The start of the window: a place in [lo, cut) where both sides match separately, or lo."""
        size = self._window
        while True:
            a = max(lo, cut - size)
            for p in range(cut - 1, a, -1):
                if text[p].isspace() and not text[p - 1].isspace() and _plain(text[p], text[p - 1]):
                    return p
            if a == lo:
                return lo
            size *= 4

    def _right(self, text: str, cut: int, hi: int) -> int:
        size = self._window
        while True:
            b = min(hi, cut + size)
            for p in range(cut + 1, b):
                if text[p].isspace() and not text[p - 1].isspace() and _plain(text[p], text[p - 1]):
                    return p
            if b == hi:
                return hi
            size *= 4

    def _join(self, text: str, lo: int, cut: int, hi: int, left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
        """Tokens of ``text[lo:hi]`` from those of its two parts, as runs of arrays."""
        a, b = self._left(text, lo, cut), self._right(text, cut, hi)
        drop_left = len(self._piece(text[a:cut])) if a > lo else sum(map(len, left))
        drop_right = len(self._piece(text[cut:b])) if b < hi else sum(map(len, right))
        return [*_without_end(left, drop_left), self._piece(text[a:b]), *_without_start(right, drop_right)]

    def _tree(self, text: str, lo: int, hi: int) -> list[np.ndarray]:
        if hi - lo <= self._leaf:
            return [self._piece(text[lo:hi])]
        cut = (lo + hi) // 2
        return self._join(text, lo, cut, hi, self._tree(text, lo, cut), self._tree(text, cut, hi))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit integers."""
        runs = self._tree(text, 0, len(text))
        return runs[0] if len(runs) == 1 else np.concatenate(runs)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: halves are decoded recursively and concatenated up the tree; seams need no care."""
        if len(ids) <= self._leaf:
            return b"".join(map(self._bytes.__getitem__, ids.tolist()))
        cut = len(ids) // 2
        return self.decode(ids[:cut]) + self.decode(ids[cut:])


def _plain(space: str, before: str) -> bool:
    """Whether Python's and the pattern's idea of white space agree on both characters."""
    return space in " \n\t\r" and not ("\x1c" <= before <= "\x1f")


def _without_end(runs: list[np.ndarray], n: int) -> list[np.ndarray]:
    runs = list(runs)
    while n and runs:
        last = runs.pop()
        if len(last) > n:
            runs.append(last[: len(last) - n])
            break
        n -= len(last)
    return runs


def _without_start(runs: list[np.ndarray], n: int) -> list[np.ndarray]:
    for i, r in enumerate(runs):
        if len(r) > n:
            return [r[n:], *runs[i + 1 :]]
        n -= len(r)
    return []


@lru_cache(maxsize=4)
def _codec(content: bytes, pattern: str, leaf: int, window: int) -> TreeCodec:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return TreeCodec(ranks, pattern, leaf, window)


def _ship(df: DataFrame, ranks_path: str):
    """The rank file's bytes (about 1 MB, whatever the input) for all tasks."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit integers, packed) and ``n_tokens``.

    Ordinary text only: strings of special tokens are encoded as text. A null or empty text
    has no ids. Input columns named ``ids`` or ``n_tokens`` are replaced; repeated rows are
    encoded alike, and an empty table gives an empty result. Texts are handled by pieces
    of ``leaf`` characters, joined by windows that start with ``window`` on each side of a seam.
    """
    return map_text(df, text_col, _IDS, _encoder(_ship(df, ranks_path), pattern, leaf, window), keep)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """Add ``ids`` and ``n_tokens`` as ``encode`` does, and ``decoded``, the bytes that the ids stand for.

    The same as ``decode`` after ``encode``, in one step of Python: a text and its ids pass between the JVM and Python
    once. Cases are those of the two.
    """
    fields = StructType([*_IDS.fields, StructField("decoded", BinaryType())])
    return map_text(df, text_col, fields, _encoder(_ship(df, ranks_path), pattern, leaf, window, decoded=True), keep)


_IDS = StructType([StructField("ids", BinaryType()), StructField("n_tokens", LongType())])


def _encoder(content, pattern: str, leaf: int, window: int, decoded: bool = False):
    def factory():
        codec = _codec(content.value, pattern, leaf, window)

        def work(column: pa.Array) -> list[pa.Array]:
            made = [codec.encode(t or "") for t in column.to_pylist()]
            out = [pa.array([m.astype("<u4").tobytes() for m in made], pa.binary()), pa.array([len(m) for m in made], pa.int64())]
            return [*out, pa.array(map(codec.decode, made), pa.binary())] if decoded else out

        return work

    return factory


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that packed ids stand for; null ids give no bytes. Unknown ids are an error.

    An input column named ``out_col`` is replaced; repeated rows are decoded alike, and an empty table gives an empty result.
    """
    content = _ship(df, ranks_path)
    fields = StructType([*[f for f in df.schema.fields if f.name != out_col], StructField(out_col, BinaryType())])
    at, others = df.columns.index(ids_col), [i for i, c in enumerate(df.columns) if c != out_col]

    def run(batches):
        codec = _codec(content.value, pattern, LEAF, WINDOW)
        for batch in batches:
            for first, piece in slices(batch.column(at)):
                made = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in piece.to_pylist()]
                rest = batch.slice(first, len(piece))
                yield pa.RecordBatch.from_arrays([*[rest.column(i) for i in others], pa.array(made, pa.binary())], names=fields.names)

    return df.mapInArrow(run, fields)
