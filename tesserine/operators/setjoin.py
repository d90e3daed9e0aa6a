"""Pairs of similar sets, without a row or a full set that travels for each pair.

A set is (key, shingles): a 64-bit key and distinct 64-bit hashes. Keys may repeat, as long as their shingles are the same; rows are made again from
the input whenever they are needed. Sets that share a key shingle (of their prefix, or a bucket) are linked to a home, the least id of those that meet
there, so a group of n gives n links. Members of a home are compared with one another by exact bounds, in tiles of a fixed size, and what is left is
verified on full sets, which travel once to each tile. A pair with several homes in common belongs to the least of them. Every bound is exact:

* Any order of shingles serves prefix filtering. This one takes a shingle's bucket, of a fixed number, by how often it is met,
  so that what is frequent is a join key only of sets without anything rarer, and no frequencies are joined back to sets.
* A shared shingle at places i and j leaves an overlap of 1 + min(n1 - 1 - i, n2 - 1 - j) at most, if it is the first.
* Parities of fixed length differ in no more bits than the sets differ in shingles.

What meets is told by 40 bits of a hash and sizes by 16 bits; that can add members to a home, but takes none away.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_dropped, stored

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS  # of the order; 4 MB
PARITY = 512  # bits
WORDS = PARITY // 64
SLICE = 1 << 14  # shingles hashed at a time
VALUES = 1 << 18  # shingles that are handled together
SLICES = 64  # of a sum over all tasks
REMEMBERED = 1 << 20  # keys a task has met
FILTER = 27  # bits of a filter's size, at most; 16 MB
ID = 40  # bits of a set's id and of what sets meet by
FLUSH = 1 << 20  # entries that are packed together
LARGEST = (1 << 16) - 1  # of sizes in entries
SMALL = 32  # members of a group that are tried pair by pair for company
TILE = 1 << 12  # members of a home that are compared with as many others in one place
CHUNK = 1 << 16  # pairs compared at a time
EPS = 1e-9


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _mapped(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers, which wait for other stages, give memory back when a task ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(run, schema)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key has not been met by this task, as far as it remembers."""
    seen: set[int] = set()
    for batch in batches:
        keys = batch["key"].to_numpy(zero_copy_only=False)
        fresh = np.zeros(len(keys), bool)
        fresh[np.unique(keys, return_index=True)[1]] = True
        fresh &= np.fromiter((k not in seen for k in keys.tolist()), bool, len(keys))
        if len(seen) < REMEMBERED:
            seen.update(keys[fresh].tolist())
        if fresh.any():
            yield batch if fresh.all() else batch.filter(pa.array(fresh))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, shingles and the size of each set, for some sets at a time."""
    for batch in _once(batches):
        key, (values, n) = batch["key"], _ragged(batch["shingles"])
        end = np.cumsum(n)
        for k in _pieces(n, VALUES):
            yield key.slice(k[0], len(k)), values[end[k[0]] - n[k[0]]:end[k[-1]]], n[k]


class _Total:
    """The sum (or what else adds up) of an array of fixed length that every task makes of its rows; compressed slices of it meet in tasks."""

    ROWS = "part int, blob binary"

    def __init__(self, kind: str, length: int, plus: np.ufunc = np.add):
        self.kind, self.length, self.step, self.plus = kind, length, -(-length // SLICES), plus

    def _load(self, blob: bytes, k: int) -> np.ndarray:
        size = min(self.step, self.length - k * self.step) * np.dtype(self.kind).itemsize
        return np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), self.kind)

    def _batch(self, parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        blobs = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in parts.values()]
        return pa.RecordBatch.from_arrays([pa.array([*parts], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def zeros(self) -> np.ndarray:
        return np.zeros(self.length, self.kind)

    def slices(self, total: np.ndarray) -> pa.RecordBatch:
        return self._batch({k: total[k * self.step:(k + 1) * self.step] for k in range(SLICES) if k * self.step < self.length})

    def meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b["part"].to_pylist(), b["blob"].to_pylist()):
                parts[k] = self.plus(parts[k], self._load(blob, k)) if k in parts else self._load(blob, k)
        if parts:
            yield self._batch(parts)

    def of(self, slices: DataFrame) -> np.ndarray:
        with shuffles_dropped(slices.sparkSession):
            rows = _mapped(slices.repartition(min(SLICES, _partitions(slices)), "part"), self.meet, self.ROWS).toArrow()
        out = self.zeros()
        for k, blob in zip(rows["part"].to_pylist(), rows["blob"].to_pylist()):
            out[k * self.step:(k + 1) * self.step] = self._load(blob, k)
        return out


_COUNTS = _Total("uint32", BUCKETS)


def _count(total: np.ndarray, values: np.ndarray) -> None:
    np.add.at(total, values & (BUCKETS - 1), np.uint32(1))


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each bucket; of copies, a task counts one."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _COUNTS.zeros()
        for _, values, _ in _sets(batches):
            _count(total, values)
        if total.any():
            yield _COUNTS.slices(total)

    return _COUNTS.of(_mapped(sets.select("key", "shingles"), count, _COUNTS.ROWS))


def among(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose ``key`` is one of the members', about once, and few others as long as FILTER bits suffice. Rows go through Python as they come, since a
    function of one column would hold the others back on disk.
    """
    bits = 1 << min(max(16, (10 * members.count()).bit_length()), FILTER)
    total = _Total("uint8", bits // 8, np.bitwise_or)

    def place(key: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            at = xxhash64_long(np.ascontiguousarray(key.to_numpy(zero_copy_only=False), np.int64)) & np.uint64(bits - 1)
        return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = total.zeros()
        for batch in batches:
            np.bitwise_or.at(out, *place(batch["key"]))
        if out.any():
            yield total.slices(out)

    marked = total.of(_mapped(members.select("key"), mark, total.ROWS))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bit = place(batch["key"])
            yield batch.filter(pa.array(marked[at] & bit != 0))

    return _mapped(rows, lambda batches: _once(found(batches)), rows.schema)


def _pieces(sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """The indices of sizes, cut where their sum passes a multiple of ``most``."""
    return [k for k in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1) if len(k)]


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the size of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _parities(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """PARITY bits a set, each the parity of the shingles that fall on it."""
    bits = np.bincount(row * PARITY + ((values >> 20) & (PARITY - 1)), minlength=n * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash64_long(values: np.ndarray) -> np.ndarray:
    """``xxhash64(value)`` of bigints."""
    k = _rotl(values.view(np.uint64) * _P2, 31) * _P1
    return _mixed(_rotl((np.uint64(42) + _P5 + np.uint64(8)) ^ k, 27) * _P1 + _P4)


def xxhash64_int(seeds: np.ndarray, k: int) -> np.ndarray:
    """``xxhash64(value, k)`` of an int k, where ``seeds`` are ``xxhash64(value)``."""
    h = (seeds + _P5 + np.uint64(4)) ^ (np.uint64(k) * _P1)
    return _mixed(_rotl(h, 23) * _P2 + _P3)


def _minima(values: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """For each set the least ``xxhash64(shingle, k)`` for every k below ``hashes``, one set after the other."""
    out = np.empty((len(starts), hashes), np.int64)
    cuts = np.flatnonzero(np.diff(starts // SLICE, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(starts)]):  # slices whose hashes stay in a core's cache
        seeds = xxhash64_long(values[starts[i]:starts[j] if j < len(starts) else None])
        for k in range(hashes):
            out[i:j, k] = np.minimum.reduceat(xxhash64_int(seeds, k).view(np.int64), starts[i:j] - starts[i])
    return out.ravel()


def _short(threshold: float, hashes: int, counts: np.ndarray, parities: bool = True) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], list[str]]:
    """What makes short rows of batches of sets, and their columns."""
    by_rank = np.argsort(counts, kind="stable").astype(np.uint32)
    rank = np.empty(BUCKETS, np.uint32)
    rank[by_rank] = np.arange(BUCKETS, dtype=np.uint32)
    high = np.uint64(64 - BUCKET_BITS)  # a shingle's bucket is in its low bits; with the bucket's rank on top of the others it is its place in the order
    names = ["key", "n", "prefix"] + ["parity"] * parities + ["minima"] * bool(hashes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for key, values, n in _sets(batches):
                end = np.cumsum(n)
                starts = end - n
                order = (rank[values & (BUCKETS - 1)].astype(np.uint64) << high) | (values.view(np.uint64) >> np.uint64(BUCKET_BITS))
                for i, j in zip(starts.tolist(), end.tolist()):
                    order[i:j].sort()
                keep = np.minimum(n - np.ceil(n * threshold - EPS).astype(np.int64) + 1, n)
                first = order[_spread(starts, keep)]
                prefix = ((first << np.uint64(BUCKET_BITS)) | by_rank[(first >> high).astype(np.int64)]).view(np.int64)
                out = [key, pa.array(n.astype(np.int32)), _lists(prefix, keep)]
                if parities:
                    out.append(_lists(_parities(values, np.repeat(np.arange(len(n)), n), len(n)), np.full(len(n), WORDS)))
                if hashes:
                    out.append(_lists(_minima(values, starts, hashes), np.full(len(n), hashes)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return cut, names


def short_rows(sets: DataFrame, threshold: float, hashes: int = 0) -> DataFrame:
    """key, n, prefix (rarest first), parity and, where asked for, the minima of so many hashes. Sets are not empty."""
    cut, names = _short(threshold, hashes, bucket_counts(sets))
    kinds = {"key": "bigint", "n": "int"}
    return _mapped(sets.select("key", "shingles"), cut, ", ".join(f"{c} {kinds.get(c, 'array<bigint>')}" for c in names))


def summaries(sets: DataFrame, bands: int = 0, band: int = 0) -> DataFrame:
    """What one pass over the sets can tell: rows of key, n and parity, and rows of part and blob, the counts of buckets. Where bands of minima are asked for,
    the former have ids of them, and the latter do not come. To be stored.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _COUNTS.zeros()
        for key, values, n in _sets(batches):
            parity = _lists(_parities(values, np.repeat(np.arange(len(n)), n), len(n)), np.full(len(n), WORDS))
            if bands:
                met = pa.array([x.tobytes() for x in _bands(values, n, bands, band)], pa.binary())
            else:
                met = pa.nulls(len(n), pa.binary())
                _count(total, values)
            yield pa.RecordBatch.from_arrays([key, pa.array(n.astype(np.int32)), parity, met, *(pa.nulls(len(n), kind) for kind in kinds[4:])], names=names)
        if total.any():
            part, blob = _COUNTS.slices(total).columns
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), kind) for kind in kinds[:4]), part, blob], names=names)

    names, kinds = ["key", "n", "parity", "met", "part", "blob"], [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
    return _mapped(sets.select("key", "shingles"), cut, f"key bigint, n int, parity array<bigint>, met binary, {_COUNTS.ROWS}")


def _bands(values: np.ndarray, n: np.ndarray, bands: int, band: int) -> np.ndarray:
    """For each set and band the ID bits of its minima, in bytes."""
    with np.errstate(over="ignore"):
        low = _minima(values, np.cumsum(n) - n, bands * band).reshape(len(n), bands, band)
        bucket = np.broadcast_to(np.arange(bands, dtype=np.int64), (len(n), bands))
        for r in range(band):
            bucket = xxhash64_long(np.ascontiguousarray(bucket)).view(np.int64) ^ low[:, :, r]
        return np.ascontiguousarray(_id(bucket)).view(np.uint8).reshape(len(n), bands, 8)[:, :, :ID // 8]


def counted(summary: DataFrame) -> np.ndarray:
    """The counts of buckets of ``summaries``."""
    return _COUNTS.of(summary.where("part IS NOT NULL").select("part", "blob"))


def sizes_and_parities(summary: DataFrame) -> DataFrame:
    """key, n and parity, a row for each key of ``summaries``."""
    return summary.where("part IS NULL").groupBy("key").agg(F.any_value("n").alias("n"), F.any_value("parity").alias("parity"))


def _id(values: np.ndarray) -> np.ndarray:
    return xxhash64_long(np.ascontiguousarray(values)) >> np.uint64(64 - ID)


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of numbers below 256 ** width, compressed byte by byte."""
    return pa.compress(b"".join(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for a, width in columns), codec="zstd", asbytes=True)


def _unpack(blob: bytes, rows: int, *widths: int) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(pa.decompress(blob, rows * sum(widths), codec="zstd", asbytes=True), np.uint8), 0, []
    for width in widths:
        wide = np.zeros((rows, 8), np.uint8)
        wide[:, :width] = raw[at:at + rows * width].reshape(width, rows).T
        out.append(wide.view("<u8").ravel())
        at += rows * width
    return out


_BLOB = "part int, rows int, blob binary"


def _dealt(parts: int, columns: list[np.ndarray], widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Blobs of rows whose first column (of ID bits) is near; it is kept as differences."""
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    edges = np.searchsorted(columns[0], ((np.arange(parts + 1, dtype=np.uint64) << np.uint64(ID)) + np.uint64(parts - 1)) // np.uint64(parts))
    full = np.flatnonzero(np.diff(edges))
    blobs = []
    for k in full:
        i, j = edges[k], edges[k + 1]
        first = columns[0][i:j]
        blobs.append(_pack((np.concatenate([first[:1], np.diff(first)]), widths[0]), *((c[i:j], w) for c, w in zip(columns[1:], widths[1:]))))
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.diff(edges)[full], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows", "blob"])


def _parts(batches: Iterator[pa.RecordBatch], *widths: int) -> Iterator[list[np.ndarray]]:
    """Columns of all blobs of a part; rows come sorted by part."""
    last, held = None, []
    for batch in batches:
        for part, rows, blob in zip(*(batch[c].to_pylist() for c in ("part", "rows", "blob"))):
            if part != last and held:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            last, columns = part, _unpack(blob, rows, *widths)
            held.append([np.cumsum(columns[0]), *(c if w > 2 else c.astype(np.uint16) for c, w in zip(columns[1:], widths[1:]))])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins; ends with the number of rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _sorted_once(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows sorted by the first two columns, without those that repeat in these."""
    order = np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    first = _runs(*columns[:2])[:-1]
    return [c[first] for c in columns]


def _has_company(edges: np.ndarray, n: np.ndarray, most: np.ndarray, small: int) -> np.ndarray:
    """Entries with another one in their group, where the size of neither is above the ``most`` that the other allows; in groups that are not small perhaps more."""
    size, ok = np.diff(edges), np.zeros(len(n), bool)
    for m in np.unique(size[(size > 1) & (size <= small)]):
        starts = edges[:-1][size == m]
        for k in range(0, len(starts), max(1, (CHUNK * 8) // (m * m))):
            at = starts[k:k + max(1, (CHUNK * 8) // (m * m)), None] + np.arange(m)
            fits = n[at][:, None, :] <= most[at][:, :, None]
            ok[at] = (fits & fits.transpose(0, 2, 1) & ~np.eye(m, dtype=bool)).any(axis=2)
    for i in np.flatnonzero(size > small):
        s = slice(edges[i], edges[i + 1])
        order = np.argsort(n[s])
        reach = np.maximum.accumulate(most[s][order])
        below = np.searchsorted(n[s][order], most[s], "right")
        ok[s] = (below > 0) & (reach[np.maximum(below, 1) - 1] >= n[s])
    return ok


def _links(rows: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]], threshold: float, small: int) -> DataFrame:
    """id and its homes, ascending. ``entries`` tells what rows meet by (ID bits), their id, their size and the shingles left behind the one they meet by."""
    ways = _partitions(rows)
    parts = 4 * ways
    t = max(threshold - EPS, EPS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in entries(batches):
            held.append(found)
            size += len(found[0])
            if size >= FLUSH:
                yield from _dealt(parts, [np.concatenate(c) for c in zip(*held)], (5, 5, 2, 2))
                held, size = [], 0
        if size:
            yield from _dealt(parts, [np.concatenate(c) for c in zip(*held)], (5, 5, 2, 2))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        for columns in _parts(batches, 5, 5, 2, 2):
            by, ids, n, left = _sorted_once(*columns)
            n = n.astype(np.float64)
            ok = _has_company(_runs(by), n, (left + 1.0) * (1 + t) / t - n + 1e-6, small)
            by, ids = by[ok], ids[ok]
            edges = _runs(by)
            homes = np.repeat(ids[edges[:-1]], np.diff(edges))
            several = np.repeat(np.diff(edges) > 1, np.diff(edges))
            found.append(_sorted_once(ids[several], homes[several]))
            if sum(len(x[0]) for x in found) >= FLUSH:
                found = [_sorted_once(*(np.concatenate(c) for c in zip(*found)))]
                if len(found[0][0]) >= FLUSH // 2:
                    yield from _dealt(parts, found[0], (5, 5))
                    found = []
        if found:
            yield from _dealt(parts, _sorted_once(*(np.concatenate(c) for c in zip(*found))), (5, 5))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _parts(batches, 5, 5):
            ids, homes = _sorted_once(*columns)
            edges = _runs(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[edges[:-1]].astype(np.int64)), _lists(homes.astype(np.int64), np.diff(edges))], names=["id", "homes"])

    met = lambda df: df.repartition(ways, "part").sortWithinPartitions("part")
    return _mapped(met(_mapped(met(_mapped(rows, deal, _BLOB)), meet, _BLOB)), gather, "id bigint, homes array<bigint>")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    with np.errstate(over="ignore"):
        for batch in batches:
            values, sizes = _ragged(batch["prefix"])
            n, starts = batch["n"].to_numpy().astype(np.int64), np.cumsum(sizes) - sizes
            left = np.repeat(n - 1 + starts, sizes) - np.arange(len(values))
            yield [_id(values), np.repeat(_id(batch["key"].to_numpy()), sizes), np.repeat(np.minimum(n, LARGEST).astype(np.uint16), sizes), np.minimum(left, LARGEST).astype(np.uint16)]


def prefix_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Links of the pairs that share a prefix shingle where the sets can still reach the threshold."""
    return _links(rows.select("key", "n", "prefix"), _prefixes, threshold, SMALL)


def set_pairs(sets: DataFrame, threshold: float, counts: np.ndarray) -> DataFrame:
    """``prefix_pairs`` of sets whose short rows are not needed otherwise."""
    cut, _ = _short(threshold, 0, counts, parities=False)
    return _links(sets.select("key", "shingles"), lambda batches: _prefixes(cut(batches)), threshold, SMALL)


def bucket_pairs(summary: DataFrame, bands: int, threshold: float, small: int = SMALL) -> DataFrame:
    """Links of the pairs that have all minima of a band in common and sizes that can reach the threshold; ``small`` buckets are tried pair by pair for that."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in _once(batches):
            n = np.minimum(batch["n"].to_numpy(), LARGEST).astype(np.uint16)
            met = np.zeros((len(n) * bands, 8), np.uint8)
            met[:, :ID // 8] = np.frombuffer(b"".join(batch["met"].to_pylist()), np.uint8).reshape(-1, ID // 8)
            with np.errstate(over="ignore"):
                ids = _id(batch["key"].to_numpy())
            yield [met.view("<u8").ravel(), np.repeat(ids, bands), np.repeat(n, bands), np.repeat(n - np.uint16(1), bands)]

    return _links(summary.select("key", "n", "met"), entries, threshold, small)


def _may_reach(overlap: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of ``total`` shingles together with so large an overlap reach the threshold."""
    return overlap >= (total - overlap) * (threshold - EPS)


CELL = ["home", "low", "high"]  # a home, and the two of its tiles that are compared


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of one or more whole cells, and where they begin; rows come sorted by cell."""
    at = lambda t: [t[c].to_numpy() for c in CELL]
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        last = _runs(*at(t))[-2]
        rest = t.slice(last)
        if last:
            t = t.slice(0, last).combine_chunks()
            yield t, _runs(*at(t))
    if rest is not None and rest.num_rows:
        t = rest.combine_chunks()
        yield t, _runs(*at(t))


def _some_cells(batches: Iterator[pa.RecordBatch], lists: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole cells, as few as have together some values in the lists."""
    for t, edges in _whole_cells(batches):
        ends = np.append(0, np.cumsum(_ragged(_column(t, lists))[1]))
        for k in _pieces(ends[edges[1:]] - ends[edges[:-1]], VALUES):
            part = edges[k[0]:k[-1] + 2]
            yield t.slice(part[0], part[-1] - part[0]), part - part[0]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t[name]
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _elsewhere(i: np.ndarray, j: np.ndarray, home: np.ndarray, homes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pairs of rows that have a home in common that is less than this one."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    lower = homes < home[row]
    row, homes = row[lower], np.unique(homes[lower], return_inverse=True)[1]
    count = np.bincount(row, minlength=len(sizes))
    start = np.cumsum(count) - count
    codes = np.sort(homes * len(sizes) + row)
    out = np.zeros(len(i), bool)
    both = np.flatnonzero((count[i] > 0) & (count[j] > 0))
    some = count[i[both]]
    for k in _pieces(some, 4 * CHUNK):
        pair = both[k]
        probe = homes[_spread(start[i[pair]], some[k])] * len(sizes) + np.repeat(j[pair], some[k])
        place = np.minimum(np.searchsorted(codes, probe), max(0, len(codes) - 1))
        out[np.repeat(pair, some[k])[codes[place] == probe]] = True
    return out


def near(links: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """A row for each member of a cell that has a pair there: its place in the cell, its key, and the places of its mates, each pair once.

    Pairs are those of a home whose sizes and parities leave room for the threshold. ``rows`` has key, n and parity.
    """
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in _whole_cells(batches):
            home, low, high, tile, key, n = (t[c].to_numpy() for c in (*CELL, "tile", "key", "n"))
            n = n.astype(np.int64)
            parity = np.ascontiguousarray(_column(t, "parity").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(n), WORDS))
            homes = _ragged(_column(t, "homes"))
            end = np.repeat(edges[1:], np.diff(edges))
            later = end - np.arange(len(n)) - 1
            found = []
            for k in _pieces(later, CHUNK):
                i, j = np.repeat(k, later[k]), _spread(k + 1, later[k])
                total = n[i] + n[j]
                fit = _may_reach(np.minimum(n[i], n[j]), total, threshold) & ((low[i] == high[i]) | (tile[i] != tile[j]))
                i, j, total = i[fit], j[fit], total[fit]
                apart = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
                fit = _may_reach((total - apart) / 2, total, threshold)
                i, j = i[fit], j[fit]
                if len(i):
                    own = ~_elsewhere(i, j, home, *homes)
                    found.append((i[own], j[own]))
            if not found:
                continue
            i, j = (np.concatenate(c) for c in zip(*found))
            mates = np.bincount(i, minlength=len(n))
            has = np.flatnonzero((mates > 0) | (np.bincount(j, minlength=len(n)) > 0))
            place = np.arange(len(n)) - np.repeat(edges[:-1], np.diff(edges))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[has]) for c in (home, low, high)), pa.array(place[has], pa.int32()), pa.array(key[has]),
                                              _lists(place[j].astype(np.int32), mates[has])], names=[*CELL, "place", "key", "mates"])

    large = links.select(F.explode("homes").alias("home")).groupBy("home").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    tiles = F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int")
    j = links.join(rows.withColumn("id", F.shiftrightunsigned(F.xxhash64("key"), 64 - ID)), "id").select("key", "n", "parity", "homes", F.explode("homes").alias("home"))
    j = j.join(F.broadcast(large), "home", "left").withColumn("tile", F.pmod(F.xxhash64("key", F.lit(1)), tiles).cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    j = j.select("home", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "key", "n", "parity", "homes")
    return _mapped(j.repartition(*CELL).sortWithinPartitions(*CELL), compare, "home bigint, low int, high int, place int, key bigint, mates array<int>")


def likely(links: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``near`` as rows."""
    m = stored(near(links, rows.select("key", "n", "parity"), threshold), "near")
    mate = m.select(*CELL, F.col("key").alias("key1"), F.explode("mates").alias("place"))
    return mate.join(m.select(*CELL, "place", F.col("key").alias("key2")), [*CELL, "place"]).select("key1", "key2")


def verified(members: DataFrame, threshold: float, bands: int = 0, band: int = 0) -> DataFrame:
    """Pairs with the Jaccard of full sets at the threshold or above, and all minima of a band in common where bands are asked for.

    Members are rows of ``near`` with their shingles and with block_id, copies and project, which come out numbered 1 and 2, the block that comes first in front.
    """
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in _some_cells(batches, "shingles"):
            values, n = _ragged(_column(t, "shingles"))
            ids = np.unique(values, return_inverse=True)[1]
            starts = np.cumsum(n) - n
            cell = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            code = (cell << 32) + t["place"].to_numpy()
            by_code = np.argsort(code)
            mates, count = _ragged(_column(t, "mates"))
            i = np.repeat(np.arange(len(n)), count)
            j = by_code[np.searchsorted(code[by_code], (cell[i] << 32) + mates)]
            first = np.cumsum(count) - count
            mark, shared = np.zeros(len(ids) and ids.max() + 1, np.uint8), np.empty(len(i), np.int64)
            for row in np.flatnonzero(count):
                own = ids[starts[row]:starts[row] + n[row]]
                mark[own] = 1
                for k in range(first[row], first[row] + count[row], 1024):
                    some = slice(k, min(k + 1024, first[row] + count[row]))
                    sizes = n[j[some]]
                    shared[some] = np.add.reduceat(mark[ids[_spread(starts[j[some]], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
                mark[own] = 0
            jaccard = shared / (n[i] + n[j] - shared)
            rank = pc.rank(_column(t, "block_id"), tiebreaker="dense").to_numpy().astype(np.int64)
            named = pc.is_valid(_column(t, "block_id")).to_numpy(zero_copy_only=False)
            good = (jaccard >= threshold) & (rank[i] != rank[j]) & named[i] & named[j]
            i, j, jaccard = i[good], j[good], jaccard[good]
            if bands and len(i):
                with np.errstate(over="ignore"):
                    minima = _minima(values, starts, bands * band).reshape(len(n), bands, band)
                good = np.concatenate([(minima[i[k:k + CHUNK // 16]] == minima[j[k:k + CHUNK // 16]]).all(axis=2).any(axis=1) for k in range(0, len(i), CHUNK // 16)])
                i, j, jaccard = i[good], j[good], jaccard[good]
            a, b = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
            for k in range(0, len(a), CHUNK // 4):
                s = slice(k, k + CHUNK // 4)
                yield pa.RecordBatch.from_arrays([_column(t, c).take(pa.array(x[s])) for c in ("block_id", "copies", "project") for x in (a, b)] + [pa.array(jaccard[s])],
                                                 names=[f"{c}{x}" for c in ("block_id", "copies", "project") for x in (1, 2)] + ["jaccard"])

    kinds = {"block_id": "string", "copies": "bigint", "project": "string"}
    return _mapped(members, check, ", ".join(f"{c}{x} {kind}" for c, kind in kinds.items() for x in (1, 2)) + ", jaccard double")
