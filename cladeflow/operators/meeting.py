"""How often two members meet in groups, counted in numpy.

What is shuffled are packed columns: rows are sorted in their task, dealt into buckets by a hash, and each bucket's
differences are compressed.  That is one to three bytes for a row in place of some twelve, and nothing is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that are sorted and packed at a time.
ROWS = 1 << 21


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, byte by byte; small where they are in order."""
    d = np.diff(x.astype(np.int64), prepend=0)
    d = ((d << 1) ^ (d >> 63)).view(np.uint64)
    size = next(s for s in (1, 2, 4, 8) if int(d.max(initial=0)) < 1 << (8 * s))
    return bytes([size]) + zlib.compress(d.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    size = data[0]
    d = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(size, -1).T.copy().view(f"<u{size}")[:, 0].astype(np.uint64)
    return np.cumsum((d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).view(np.int64))


def _dealt(buckets: int, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns, the first two of them the order, as packed rows of each bucket of the first."""
    of = ((cols[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.lexsort((cols[1], cols[0], of))
    of = of[order]
    cols = [c[order] for c in cols]
    at = np.flatnonzero(np.diff(of, prepend=-1))
    for lo, hi in zip(at, [*at[1:], len(of)], strict=True):
        packed = [squeezed(c[lo:hi]) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array([of[lo]], pa.int32()), *[pa.array([p], pa.binary()) for p in packed]], ["bucket", *"abn"[: len(packed)]])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) in order, and how many there are of each (or the sum of n)."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = _runs(a, b)
    many = np.diff(at, append=len(a)) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    return a[at], b[at], many


def _whole(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    held = [[unsqueezed(v.as_py()) for v in c] for c in zip(*[row for batch in batches for row in zip(*batch.columns[1:], strict=True)], strict=True)]
    return [np.concatenate(h) for h in held] or None


def pairs_of(group: np.ndarray, member: np.ndarray, most: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of members of a group; distinct rows in order.  About ``most`` at a time."""
    at = _runs(group)
    ends = np.repeat(np.append(at[1:], len(group)), np.diff(np.append(at, len(group))))
    later = ends - np.arange(len(group)) - 1  # members after each in its group
    sums = np.cumsum(later)
    lo = 0
    while lo < len(group):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + most, side="right")))
        some = later[lo:hi]
        first = np.repeat(np.arange(lo, hi), some)
        begin = np.cumsum(some) - some
        second = np.arange(len(first)) - np.repeat(begin, some) + first + 1
        if len(first):
            yield member[first], member[second]
        lo = hi


def meetings(rows: DataFrame, group: str, member: str) -> DataFrame:
    """``(source, target, n)``, source < target: in how many groups two members are together.  Both columns hold whole
    numbers; rows with a null are in no pair."""
    kind = dict(rows.dtypes)[member]
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bare = rows.select(F.col(group).cast("long").alias("a"), F.col(member).cast("long").alias("b")).where("a is not null and b is not null")

    def packed(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += len(batch)
            if n >= ROWS:
                yield from _dealt(buckets, *map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from _dealt(buckets, *map(np.concatenate, zip(*held, strict=True)))

    def paired(batches):
        if found := _whole(batches):
            a, b, _ = _counted(*found)
            for source, target in pairs_of(a, b):
                yield from _dealt(buckets, *_counted(source, target))

    def summed(batches):
        if found := _whole(batches):
            cols = _counted(*found)
            for lo in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in cols], ["source", "target", "n"])

    groups = bare.mapInArrow(packed, "bucket int, a binary, b binary").repartition(buckets, "bucket")
    pairs = groups.mapInArrow(paired, "bucket int, a binary, b binary, n binary").repartition(buckets, "bucket")
    return pairs.mapInArrow(summed, "source long, target long, n long").select(F.col("source").cast(kind).alias("source"), F.col("target").cast(kind).alias("target"), "n")
