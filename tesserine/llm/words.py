"""Words and word hashes of whole texts, computed over Arrow buffers.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). Everything works on blocks of about a megabyte of text, so memory
does not depend on the batch; only a single text longer than that makes a longer block. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tesserine.llm.workers import release

BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for blocks of usual length only."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        made.append(np.cumprod(p))
    if n <= 4 * BLOCK:
        _powers = made[0], made[1]
    return made[0], made[1]


class Block:
    """Consecutive rows of a batch: rows [first, first + n), their bytes, and the words of row i at words[i]:words[i + 1]."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds, self.n = first, data, bounds, len(bounds) - 1
        ink = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = ink[:-1]
        self.starts = np.flatnonzero(ink & (~before | cut[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = ink[1:]
        self.ends = np.flatnonzero(ink & (~after | cut[1:])) + 1
        self.words = np.searchsorted(self.starts, bounds)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        data = _LOWER[self.data] if lower else self.data
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def shingles(self, hashes: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of ``size`` words, row after row, and where each row's begin.

        With ``short``, a row with fewer words gives its whole sequence as the only one; a row without words gives none.
        """
        n = np.diff(self.words)
        count = np.where(n >= size, n - size + 1, (n > 0) & short)
        at = np.zeros(self.n + 1, np.int64)
        np.cumsum(count, out=at[1:])
        whole = rolling(hashes, size)
        out = np.empty(at[-1], np.uint64)
        row = np.repeat(np.arange(self.n), count)
        begin = self.words[:-1][row] + np.arange(at[-1]) - at[:-1][row]
        full = n[row] >= size
        out[full] = whole[begin[full]]
        for i in np.flatnonzero((n > 0) & (n < size)) if short else ():
            out[at[i]] = sequence_hash(hashes[self.words[i]:self.words[i + 1]])
        return out, at


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place on; places too near the end are left out."""
    m = len(hashes) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, size, np.uint64)
    for k in range(size):
        acc = acc * np.uint64(0xD1342543DE82EF95) + hashes[k:k + m]
    return mix(acc)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """A hash of a whole sequence."""
    power, _ = _power_tables(len(hashes) + 1)
    return mix(np.sum(mix(hashes) * power[: len(hashes)], dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))[0]


def blocks(texts: pa.Array) -> Iterator[Block]:
    """The texts in blocks of about BLOCK bytes; each row is whole within one block."""
    release()
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield Block(first, raw[at[first]:at[last]], at[first:last + 1] - at[first])
        first = last
