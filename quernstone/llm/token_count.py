"""Token counts of byte-level BPE without emitting ids.

Each word of the pattern starts as one symbol for each byte, held in a linked list. A heap
gives the adjacent pair of the lowest rank, the pair becomes one symbol, and pairs with its
neighbours are pushed. A word's count is its bytes minus the merges made.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import map_text

#: Words whose counts a Python worker remembers at most, half of them for certain the ones used last, and characters of
#: the longest of them.
REMEMBERED, LONGEST = 1_000_000, 64


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by the usual rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairCounter:
    """Counts tokens by heap-driven pair merging."""

    def __init__(self, tokenizer_json: str, pattern: str, remembered: int = REMEMBERED) -> None:
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or model.get("ignore_merges") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is counted here")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left id, right id) in one integer -> rank and new id in one integer
        self._rank = {vocab[a] << 32 | vocab[b]: i << 32 | vocab[a + b] for i, (a, b) in enumerate(pairs)}
        byte_id = [0] * 256
        for symbol, b in byte_symbols().items():
            byte_id[b] = vocab[symbol]
        self._byte_id = byte_id
        self._words = regex.compile(pattern).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        #: counts of words: those used since the last turnover, and those used before it
        self._known: dict[str, int] = {}
        self._older: dict[str, int] = {}
        self._half = remembered // 2

    def merges(self, word: bytes) -> int:
        """Merges that a word undergoes."""
        ids = [self._byte_id[b] for b in word]
        n, rank = len(ids), self._rank
        heap = []
        for i in range(n - 1):
            r = rank.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append((r, i))
        if not heap:
            return 0
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = 0
        while heap:
            r, i = heappop(heap)
            j = after[i]
            # a stale entry: its left symbol is gone or the pair is no longer this one
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 32 | ids[j]) != r:
                continue
            made += 1
            ids[i], ids[j] = r & 0xFFFFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(ids[i] << 32 | ids[k])
                if r is not None:
                    heappush(heap, (r, i))
            p = before[i]
            if p >= 0:
                r = rank.get(ids[p] << 32 | ids[i])
                if r is not None:
                    heappush(heap, (r, p))
        return made

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it is one token."""
        if self._special is None or not self._special.search(text):
            return self._count(text)
        parts = self._special.split(text)
        return sum(map(self._count, parts)) + len(parts) - 1

    def _count(self, text: str) -> int:
        known, words = self._known, self._words(text)
        new = {*words}.difference(known)  # looks each word up; subtracting a view would walk all that is known
        if new:
            if len(known) + len(new) > self._half:
                self._older, self._known = known, (known := {})
                new = {*words}
            older, long = self._older, {}
            for w in new:
                n = older.get(w)
                if n is None:
                    raw = w.encode()
                    n = len(raw) - self.merges(raw)
                (known if len(w) <= LONGEST else long)[w] = n
            if long:
                return sum(known[w] if w in known else long[w] for w in words)
        return sum(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def _counter(tokenizer_json: str, pattern: str) -> PairCounter:
    """One counter for each Python worker, so that tasks share the words it remembers."""
    return PairCounter(tokenizer_json, pattern)


_FIELDS = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])


def count_tokens(df: DataFrame, tokenizer_path: str, pattern: str, text_col: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Counts are those of the tokenizer file without added begin or end tokens, truncation or
    padding; the string of one of its special tokens counts as that token. A null or empty text
    has none. Texts of any length are counted whole. Input columns of the result's names are
    replaced; repeated rows count alike, and an empty table gives an empty result.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def factory():
        counter = _counter(content.value, pattern)

        def work(column: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in column.to_pylist()]
            tokens = pa.array([counter.count(t) for t in texts], pa.int64())
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), tokens, pc.greater(tokens, limit)]

        return work

    return map_text(df, text_col, _FIELDS, factory, keep)
