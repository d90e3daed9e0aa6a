"""Periodic runs of words: maximal stretches that repeat themselves, and texts with each run collapsed to its first period.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least ``max(LEAST_WORDS, LEAST_PERIODS * q)`` words.
By the runs theorem every run has a Lyndon root that is the longest Lyndon word from its place on, in the order of the words or in the reversed one. So the
candidates are the longest Lyndon words at each place: they end at the next smaller suffix, and suffixes are ranked by walking an Ukkonen suffix tree. A candidate
is extended to both sides by the longest common extension of its two ends, which is the string depth of a lowest common ancestor: a range minimum over the
Euler tour of the tree, in constant time by a sparse table. Extensions to the left use the tree of the reversed words.

Trees are built over the stretches that can hold a run, and only there. A run of period q has at least ``2 q - 7`` (or 9) consecutive places whose eight words occur
again at most q words later; stretches of places that have no such further occurrence are cut out by counting, and no run is lost.

Work is per document and linear in its words. Memory is bounded by a batch and the largest periodic stretch of one text, about a kilobyte a word of it.

Defined cases: a null or empty text, or one of white space, has no words, no runs and collapses to the empty text; a null id is kept; repeated rows are judged each;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.words import mix, rolling

#: Least words of a run, and least repetitions of its period.
LEAST_WORDS, LEAST_PERIODS = 24, 3
GRAM = 8
#: Bytes of collapsed text after which a batch of results is passed on.
OUT_BYTES = 4 << 20


class Extensions:
    """Suffix tree of a sequence with constant-time longest common extensions.

    ``ranks`` has the order of the suffixes, and the one with the order of the symbols reversed; a prefix of a suffix comes before it in both.
    """

    def __init__(self, symbols: list[int], ranked: bool):
        word = [*symbols, -1]
        start, stop, kids = ukkonen(word)
        tour, first, leaves = euler(word, start, stop, kids, +1)
        self.first, self.n = first, len(symbols)
        self.ranks = [inverse(leaves), inverse(euler(word, start, stop, kids, -1)[2])] if ranked else []
        levels = [tour]
        while 2 << len(levels) - 1 <= len(tour):
            half = 1 << len(levels) - 1
            level = levels[-1].copy()
            np.minimum(level[:-half], levels[-1][half:], out=level[:-half])
            levels.append(level)
        self.table = np.stack(levels)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of what suffixes i and j, different ones, have in common at their front. The place after the last word has the empty suffix."""
        a, b = self.first[i], self.first[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, low], self.table[k, high - (1 << k) + 1])


def ukkonen(word: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """Suffix tree of a word with a last symbol of its own: where each node's edge starts and stops in the word, and its children by first symbol."""
    n = len(word)
    start, stop, link, kids = [0], [0], [0], [{}]
    node = edge = length = todo = 0
    for i, c in enumerate(word):
        todo += 1
        last = 0
        while todo:
            if not length:
                edge = i
            family = kids[node]
            child = family.get(word[edge])
            if child is None:
                family[word[edge]] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                kids.append(None)
                if last:
                    link[last] = node
                last = 0
            else:
                begin = start[child]
                span = min(stop[child], i + 1) - begin
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if word[begin + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                start += (begin, i)
                stop += (begin + length, n)
                link += (0, 0)
                kids += ({word[begin + length]: child, c: split + 1}, None)
                start[child] = begin + length
                family[word[edge]] = split
                if last:
                    link[last] = split
                last = split
            todo -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - todo + 1
    return start, stop, kids


def euler(word: list[int], start: list[int], stop: list[int], kids: list[dict | None], sign: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """String depths along the Euler tour, the place of each suffix in it, and the suffixes in the tour's order. ``sign`` -1 reverses the order of the symbols."""
    n = len(word)
    depth, tour, first, leaves = [0] * len(start), [], np.zeros(n, np.int64), []
    todo = [0]
    while todo:
        node = todo.pop()
        if node < 0:  # back from a child
            tour.append(depth[~node])
            continue
        here = depth[node]
        family = kids[node]
        if family is None:
            first[n - here] = len(tour)
            leaves.append(n - here)
        else:
            back = ~node
            order = sorted(family, key=None if sign > 0 else lambda c: (c >= 0, -c), reverse=True)
            for c in order:
                child = family[c]
                depth[child] = here + stop[child] - start[child]
                todo += (back, child)
        tour.append(here)
    return np.array(tour, np.int32), first, leaves


def inverse(order: list[int]) -> list[int]:
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out.tolist()


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix but the empty one, the next place whose suffix is smaller. What lies between is the longest Lyndon word from there on."""
    n = len(rank) - 1
    out = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:n], np.int64)


def runs_of(symbols: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers from 0 on."""
    n = len(symbols)
    ahead, behind = Extensions(symbols, True), Extensions(symbols[::-1], False)
    found = set()
    i = np.arange(n)
    for rank in ahead.ranks:
        end = next_smaller(rank)
        period = end - i
        right = ahead.lce(i, end)
        left = behind.lce(n - i, n - end)
        length = period + left + right
        good = length >= np.maximum(least, max(periods, 2) * period)
        found.update(zip((i - left)[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint parts [begin, end) of a sequence that together hold every run of LEAST_WORDS words and LEAST_PERIODS periods."""
    if len(ids) < LEAST_WORDS:
        return []
    grams = rolling(mix(ids.astype(np.uint64)), GRAM)
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    if not again.any():
        return []
    distance = np.zeros(len(grams) + 2, np.int64)  # to the next occurrence, from place 1 on; 0: none
    distance[order[:-1][again] + 1] = (order[1:] - order[:-1])[again]
    shortest = LEAST_WORDS - 2 * GRAM + 1
    while True:
        edges = np.flatnonzero(np.diff(distance > 0))
        begin, end = edges[::2], edges[1::2]  # places begin .. end - 1, counted from 0
        size = end - begin
        period = np.maximum(GRAM, (size + GRAM - 1) // 2)
        most = np.repeat(np.where(size >= shortest, period, 0), size)
        at = np.flatnonzero(distance)
        late = distance[at] > most
        if not late.any():
            break
        distance[at[late]] = 0
    out: list[tuple[int, int]] = []
    for b, e in zip(begin.tolist(), np.minimum(len(ids), end - 1 + period + GRAM).tolist(), strict=True):
        if out and b <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((b, e))
    return out


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start, then period."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    out = []
    for begin, end in stretches(ids):
        part = np.unique(ids[begin:end], return_inverse=True)[1].tolist()
        out += [(begin + s, length, period) for s, length, period in runs_of(part)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, drop in zip(words, np.cumsum(gone).tolist(), strict=False) if not drop]
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the words that stay, joined by one space."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first, size, runs, left = 0, 0, [], []
            for k in range(len(texts)):
                words = (texts[k].as_py() or "").encode().split()  # of bytes: exactly the ASCII white space
                found = text_runs(words)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                left.append(collapsed(words, found))
                size += len(left[-1])
                if size >= OUT_BYTES or k + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.slice(first, k + 1 - first), pa.array(runs, pa.list_(RUN)), pa.array(left, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])
                    first, size, runs, left = k + 1, 0, [], []

    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic end in the documents whose id has a CRC-32 that 10 divides: words from a on repeat the p words there.

    With g a tenth of that checksum and n words: ``a = g % n`` and ``p = 1 + (n - a) div (3 + g % 8)``. Other texts, and those of null ids, are unchanged.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr("filter(split(text, '[ \\t-\\r]+'), w -> w <> '')")
    df = docs.select("doc_id", "text", h.alias("h"))
    df = df.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.expr("h div 10"))
    df = df.withColumn("n", F.size("w")).withColumn("a", F.expr("int(g % nullif(n, 0))")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    changed = F.expr("array_join(concat(slice(w, 1, a), transform(slice(w, a + 1, n - a), (x, i) -> w[a + i % p])), ' ')")
    return df.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """Per document its number of runs, the one of most repetitions, and digests of all of them and of the collapsed text."""
    best = F.expr("""aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>),
        (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    df = found.withColumn("best", best)
    return df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                     F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
