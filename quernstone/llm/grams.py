"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

Both word patterns used here treat every byte above 0x7F as part of a word, so working
on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_BYTE_CODE = _RANDOM.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            step = np.full(n, _BASE, np.uint64)
            step[0] = 1
            self.up = np.cumprod(step, dtype=np.uint64)
            step = np.full(n, _inverse(_BASE), np.uint64)
            step[0] = 1
            self.down = np.cumprod(step, dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lookup(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word, and its code after A-Z are lower-cased.

    ``alnum``: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing;
    ``space``: words are ``[^\\x20\\x09-\\x0D]+``.
    """
    byte = np.arange(256)
    low = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    if kind == "alnum":
        inside = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    elif kind == "space":
        inside = (low != 32) & ~((low >= 9) & (low <= 13))
    else:
        raise ValueError(f"unknown kind of words: {kind}")
    return inside, _BYTE_CODE[low]


@dataclass
class Words:
    """Words of a batch of texts: hash, byte span in ``data``, and first word of each text."""

    data: bytes
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  #: of length texts + 1

    def text(self, word: int, n: int) -> list[bytes]:
        """The bytes of ``n`` words from ``word`` on, with A-Z lower-cased."""
        return [self.data[self.start[i] : self.end[i]].lower() for i in range(word, word + n)]


def words(texts: list[bytes | None], kind: str) -> Words:
    """Split UTF-8 texts into words and hash each word; a null text has none.

    A word's hash is a polynomial in a random code for each byte, modulo 2**64, from
    prefix sums over the whole batch, so the cost is a few passes over the bytes.
    """
    inside, code = lookup(kind)
    parts = [t or b"" for t in texts]
    data = b" ".join(parts) + b" "
    at = np.concatenate([[0], np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))])
    raw = np.frombuffer(data, np.uint8)
    flag = inside[raw].astype(np.int8)
    step = np.diff(flag, prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers.to(len(raw) + 1)
    total = code[raw]
    total *= up[: len(raw)]
    np.cumsum(total, out=total)
    value = total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0))
    value *= down[start]
    value += (end - start).astype(np.uint64)
    return Words(data, mix(value), start, end, np.searchsorted(start, at))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; entry i starts at word i. Runs may cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k * int(_PLACE[63]) % 2**64, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _PLACE[j]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole run of words, equal to its entry in ``shingles``."""
    return shingles(hashes, len(hashes))[0]
