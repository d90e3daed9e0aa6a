"""Edit distances of many pairs of strings at once: the columns of the table are bit vectors of 64 rows a word, after Myers and Hyyrö.

A step takes one more character of the shorter string and all words of the longer one. Pairs with equally many words, or nearly so, step together,
as vectors over pairs; a pair of very long strings, or without company, steps by itself over one large integer. Both are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 1 << 21  # words of a group's table of places
CLASSES = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48])  # words; the longest strings of a group
STEP, WORD, LARGE, LARGE_WORD = 14e-6, 18e-9, 0.7e-6, 11e-9  # seconds, roughly: of a word's step of a group and of each pair in it; of a large integer's step and of each word in it


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _single(long: np.ndarray, short: np.ndarray) -> int:
    n = len(long)
    places = {c: int.from_bytes(np.packbits(long == c, bitorder="little").tobytes(), "little") for c in set(short.tolist())}
    full, last = (1 << n) - 1, n - 1
    up, down, score = full, 0, n
    for c in short.tolist():
        eq = places[c]
        xv = eq | down
        xh = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (full ^ (xh | up)), up & xh
        score += (plus >> last) - (minus >> last)
        plus, minus = ((plus << 1) | 1) & full, (minus << 1) & full
        up, down = minus | (full ^ (xv | plus)), plus & xv
    return score


def _together(long: list[np.ndarray], short: list[np.ndarray], letters: int) -> np.ndarray:
    """Distances of pairs of strings of letters 0 to ``letters`` - 1, ordered by falling length of the shorter one."""
    n, m, pairs = np.array([len(x) for x in long]), np.array([len(x) for x in short]), len(long)
    words, ones = (int(n.max()) + 63) // 64, np.uint64(1)
    pair, at = np.repeat(np.arange(pairs), n), np.concatenate([np.arange(x) for x in n])
    places = np.zeros(words * pairs * letters, np.uint64)
    np.add.at(places, ((at >> 6) * pairs + pair) * letters + np.concatenate(long), ones << (at & 63).astype(np.uint64))
    places = places.reshape(words, pairs * letters)
    steps = np.zeros((pairs, int(m[0])), np.int64)
    steps[np.arange(m[0]) < m[:, None]] = np.concatenate(short)
    steps = np.ascontiguousarray((steps + np.arange(pairs)[:, None] * letters).T)
    active = np.searchsorted(-m, -np.arange(m[0]), side="left")  # pairs with more characters than so many
    ends = np.zeros((words, pairs), np.uint64)
    ends[(n - 1) >> 6, np.arange(pairs)] = ones << ((n - 1) & 63).astype(np.uint64)
    ending = ends.any(axis=1)
    up, down, score = np.full((words, pairs), 2**64 - 1, np.uint64), np.zeros((words, pairs), np.uint64), n.copy()
    room = np.empty((5, pairs), np.uint64)
    carries = np.empty((4, pairs), np.uint64)
    for j in range(len(steps)):
        k = active[j]
        step = steps[j, :k]
        eq, xv, xh, plus, minus = room[:, :k]
        plus_in, minus_in, plus_out, minus_out = carries[:, :k]
        plus_in.fill(1)
        minus_in.fill(0)
        for w in range(words):
            pv, mv = up[w, :k], down[w, :k]
            np.take(places[w], step, out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            np.bitwise_or(eq, minus_in, out=eq)
            np.bitwise_and(eq, pv, out=xh)
            np.add(xh, pv, out=xh)
            np.bitwise_xor(xh, pv, out=xh)
            np.bitwise_or(xh, eq, out=xh)
            np.bitwise_or(xh, pv, out=plus)
            np.invert(plus, out=plus)
            np.bitwise_or(plus, mv, out=plus)
            np.bitwise_and(pv, xh, out=minus)
            if ending[w]:
                end = ends[w, :k]
                score[:k] += (plus & end) != 0
                score[:k] -= (minus & end) != 0
            np.right_shift(plus, 63, out=plus_out)
            np.right_shift(minus, 63, out=minus_out)
            np.left_shift(plus, 1, out=plus)
            np.bitwise_or(plus, plus_in, out=plus)
            np.left_shift(minus, 1, out=minus)
            np.bitwise_or(minus, minus_in, out=minus)
            np.bitwise_or(xv, plus, out=pv)
            np.invert(pv, out=pv)
            np.bitwise_or(pv, minus, out=pv)
            np.bitwise_and(plus, xv, out=mv)
            plus_in, plus_out, minus_in, minus_out = plus_out, plus_in, minus_out, minus_in
    return score


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of a[i] and b[i], by code points."""
    n = len(a)
    codes = _codes([*a, *b])
    size = np.fromiter(map(len, [*a, *b]), np.int64, 2 * n)
    start = np.cumsum(size) - size
    met = np.zeros(0x110000, np.int64)
    met[codes] = 1
    letters = max(int(met.sum()), 1)
    codes = (np.cumsum(met) - 1)[codes]
    first = size[:n] >= size[n:]
    long, short = np.where(first, np.arange(n), np.arange(n) + n), np.where(first, np.arange(n) + n, np.arange(n))
    at = lambda i: codes[start[i]:start[i] + size[i]]
    out = size[long].copy()
    todo = np.array([i for i in range(n) if size[short[i]] and a[i] != b[i]], np.int64)
    out[[i for i in range(n) if a[i] == b[i]]] = 0
    words = (size[long[todo]] + 63) // 64
    kind = np.searchsorted(CLASSES, words)
    for c in np.unique(kind):
        group = todo[kind == c]
        group = group[np.argsort(-size[short[group]], kind="stable")]
        wide = int(CLASSES[c]) if c < len(CLASSES) else 0
        many = max(1, CELLS // (letters * wide)) if wide else 1
        for part in (group[i:i + many] for i in range(0, len(group), many)):
            m = size[short[part]]
            alone = (m * (LARGE + LARGE_WORD * ((size[long[part]] + 63) // 64))).sum()
            if wide and (m[0] * STEP + m.sum() * WORD) * wide < alone:
                out[part] = _together([at(i) for i in long[part]], [at(i) for i in short[part]], letters)
            else:
                out[part] = [_single(at(x), at(y)) for x, y in zip(long[part], short[part])]
    return out


def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distance of each pair of a batch; null where either is."""
    known = pc.and_(pc.is_valid(a), pc.is_valid(b))
    found = distances(a.filter(known).to_pylist(), b.filter(known).to_pylist())
    out, here = np.zeros(len(a), np.int32), known.to_numpy(zero_copy_only=False)
    out[here] = found
    return pa.array(out, mask=~here)
