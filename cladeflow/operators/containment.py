"""Sequences inside longer ones, by hashes of their two ends.

A sequence of L letters, w <= L < 4 w, stands at a place of another only if that has its first w letters there and its last
w letters L - w further.  Both windows are looked up in bitmaps of hashed words as in ``sieve``; what gets through is
compared by length and digest (128 bits) of the whole.  So no sequence is sent anywhere, and beginnings that many share make
no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.iterate import cut
from . import sieve

BASE = 0x9E3779B97F4A7C15
WORD = 1 << 64
#: Multipliers of the slots that a word has in a bitmap.
PROBES = tuple(np.uint64(pow(BASE, 2 * i + 3, WORD)) for i in range(4))
#: Letters that are hashed at a time, so that their hashes stay in a core's cache.
LETTERS = 1 << 17
SHIFT = np.uint64(64 - sieve.BITS)


def mixed(head: np.ndarray, length: np.ndarray, tail: np.ndarray) -> np.ndarray:
    x = head * np.uint64(0xD6E8FEB86659FD93) + tail
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) + length.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def among(x: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of words whose slots are all set."""
    at = np.arange(len(x))
    for p in PROBES:
        slot = ((x[at] if len(at) < len(x) else x) * p >> SHIFT).astype(np.int64)
        at = at[((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)]
        if not len(at):
            break
    return at


def width(length: int, k: int) -> int:
    w = k
    while 4 * w <= length:
        w *= 4
    return w


def levels(letters: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(w, hashes of the windows of w letters)`` for w = k, 4 k, ..: the letters as digits to the base, modulo 2^64."""
    h = np.zeros(len(letters) - k + 1, np.uint64)
    one = letters.astype(np.uint64)
    part, size, done = one, 1, 0  # windows of 1, 2, 4, .. letters make up k
    while size <= k:
        if k & size:
            h = h * np.uint64(pow(BASE, size, WORD)) + part[done : done + len(h)]
            done += size
        if 2 * size <= k:
            part = part[: len(part) - size] * np.uint64(pow(BASE, size, WORD)) + part[size:]
        size *= 2
    w = k
    while True:
        yield w, h
        for _ in range(2):
            if len(h) <= w:
                return
            h = h[: len(h) - w] * np.uint64(pow(BASE, w, WORD)) + h[w:]
            w *= 2


def ends(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's first and last ``width`` letters."""
    powers = np.full(max(map(len, texts), default=0) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = powers.cumprod(dtype=np.uint64)
    heads, tails = [], []
    for t in texts:
        w = width(len(t), k)
        by = powers[w - 1 :: -1]
        heads.append((sieve.codes([t[:w]]).astype(np.uint64) * by).sum(dtype=np.uint64))
        tails.append((sieve.codes([t[-w:]]).astype(np.uint64) * by).sum(dtype=np.uint64))
    return np.array(heads, np.uint64), np.array(tails, np.uint64)


def inside(texts: list[str], k: int, widths: set[int], heads: np.ndarray, wholes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(i, p, n)``: n letters at place p of text i, not all of it, that may be one of the sequences of the bitmaps."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # texts that are too short for wide windows lie together
    sums = np.cumsum([len(texts[i]) for i in order])
    for rows in np.split(np.array(order, np.int64), np.flatnonzero(np.diff(sums // LETTERS)) + 1):
        some = [texts[i] for i in rows]
        letters = sieve.codes(some)
        if len(letters) < k:
            continue
        lens = np.array([len(t) for t in some])
        stop = np.cumsum(lens)
        for w, h in levels(letters, k):
            if w > lens.max():
                break
            if w not in widths:
                continue
            at = among(h, heads)
            of = np.searchsorted(stop, at, side="right")
            whole = at + w <= stop[of]
            for p, i in zip(at[whole].tolist(), of[whole].tolist(), strict=True):
                start = int(stop[i] - lens[i])
                n = np.arange(w, min(4 * w - 1, int(stop[i]) - p) + 1)
                if p == start:
                    n = n[n < lens[i]]
                for x in n[among(mixed(h[p : p + 1], n, h[p + n - w]), wholes)].tolist():
                    yield int(rows[i]), p - start, x


def contained(seqs: DataFrame, k: int) -> DataFrame:
    """``rid`` of sequences that lie inside a different, longer one; shorter ones than k are left out."""
    long_ = seqs.where(F.length("seq") >= k).select("rid", "seq")
    context = seqs.sparkSession.sparkContext

    def described(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            heads, tails = ends(texts, k)
            n, w = (np.array(x, np.int64) for x in ([len(t) for t in texts], [width(len(t), k) for t in texts]))
            cols = [pa.array(c) for c in (n, w, heads.view(np.int64), mixed(heads, n, tails).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in texts], pa.binary())], ["rid", "n", "w", "head", "whole", "key"])

    def slots(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([(x * p >> SHIFT).astype(np.int64) + 1 for p in PROBES]))], ["slot"])

    own = cut(long_.mapInArrow(described, f"rid {dict(seqs.dtypes)['rid']}, n long, w long, head long, whole long, key binary"))
    widths = {r.w for r in own.select("w").distinct().collect()}
    sent = context.broadcast([sieve.bitmap(own.select(c).mapInArrow(slots, "slot long")) for c in ("head", "whole")])

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = {(n, hashlib.md5(texts[i][p : p + n].encode(), usedforsecurity=False).digest()) for i, p, n in inside(texts, k, widths, *sent.value)}
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], ["n", "key"])

    found = long_.select("seq").mapInArrow(run, "n long, key binary").distinct()
    return own.select("rid", "n", "key").join(found, ["n", "key"], "left_semi").select("rid").distinct()
