"""Counts of k-mers and of the letters behind them, without a row for each place.

Sequences are cut into runs of k-mers with one minimizer (the least hash of their halves).  Runs of a batch go to their
minimizer's bucket as one compressed block, at some two bytes a k-mer; a task sorts the k-mers of a bucket in numpy.
Letters may be any; markers of ends are above all of them.

Short k-mers of the twenty residues (``residues``) are numbers: a task sorts some millions of them and sends each once with
its count, as differences, to the bucket of its first letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import alphabet
from .sieve import slots

#: Letters that are cut at a time.
LETTERS = 1 << 20
#: Markers, for texts of ASCII and others: the sequence ends here; it goes on, but in another run.
NARROW, WIDE = (254, 255), (0x110000, 0x110001)


def buckets_of(seqs: DataFrame) -> int:
    """About a bucket for a quarter of a megabyte of input, by Spark's own estimate."""
    size = int(str(seqs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(size >> 18, 16), 1 << 15)


def marked(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """Texts on end with a marker after each, about ``LETTERS`` at a time; longer ones in parts that overlap by k."""

    def joined(parts: list[tuple[str, bool]]) -> np.ndarray:
        whole = "".join(t + "\0" for t, _ in parts)
        narrow = whole.isascii()
        a = np.frombuffer(whole.encode() if narrow else whole.encode("utf-32-le", "surrogatepass"), np.uint8 if narrow else "<u4").copy()
        end, cut = NARROW if narrow else WIDE
        a[np.cumsum([len(t) + 1 for t, _ in parts]) - 1] = [end if last else cut for _, last in parts]
        return a

    held, n = [], 0
    for t in texts:
        for lo in range(0, max(len(t) - k + 1, 0), LETTERS):
            part = t[lo : lo + LETTERS + k]
            # a part that holds the text's last k-mer ends with the text
            held.append((part, lo + LETTERS > len(t) - k))
            n += len(part)
            if n >= LETTERS:
                yield joined(held)
                held, n = [], 0
    if held:
        yield joined(held)


def whole_windows(a: np.ndarray, k: int) -> np.ndarray:
    """Is there a k-mer at each place, and what is behind it known?"""
    end, cut = WIDE if a.dtype.itemsize > 1 else NARROW
    marks = np.concatenate([[0], np.cumsum(a >= end, dtype=np.int32)])
    return (marks[k:-1] == marks[: -k - 1]) & (a[k:] != cut)


def runs(a: np.ndarray, k: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(bucket, letters)``: runs of k-mers with one minimizer, the letter behind them, and a marker each."""
    if len(a) <= k:
        return
    m = (k + 1) // 2
    low, width, w = slots(a, m).astype(np.int32), 1, k - m + 1
    while 2 * width <= w:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < w:
        low = np.minimum(low[: width - w], low[w - width :])
    ok = whole_windows(a, k)
    low = low[: len(ok)]
    new = np.concatenate([[True], low[1:] != low[:-1]])
    first = np.flatnonzero(ok & (new | ~np.concatenate([[False], ok[:-1]])))
    last = np.flatnonzero(ok & np.concatenate([new[1:] | ~ok[1:], [True]]))
    if not len(first):
        return
    bucket = ((low[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    first, lens, bucket = first[order], (last - first)[order] + k + 2, bucket[order].astype(np.int64)
    ends = np.cumsum(lens)
    # the one letter too many of each run gives way to its marker; the last run may end with the batch
    at = np.arange(ends[-1]) + np.repeat(first - (ends - lens), lens)
    flat = a[np.minimum(at, len(a) - 1)]
    flat[ends - 1] = (WIDE if a.dtype.itemsize > 1 else NARROW)[1]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        yield int(bucket[i]), flat[ends[i] - lens[i] : ends[j - 1]]


def count(a: np.ndarray, k: int, least: int) -> tuple[list, np.ndarray]:
    """Of k-mers that occur ``least`` times in the runs ``a``: them, and them with each letter behind, as texts; counts."""
    end = (WIDE if a.dtype.itemsize > 1 else NARROW)[0]
    at = np.flatnonzero(whole_windows(a, k)) if len(a) > k else np.empty(0, np.int64)
    letters = np.unique(a[a < end])
    # 0: the sequence ends
    rank = np.zeros(len(a), np.uint64)
    rank[a < end] = np.searchsorted(letters, a[a < end]) + 1
    base = len(letters) + 1
    per = max(1, int(63 / np.log2(base + 1)))
    spans = [(lo, min(lo + per, k + 1)) for lo in range(0, k + 1, per)]

    def column(lo: int, hi: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for i in range(lo, hi):
            out = out * np.uint64(base) + rank[at + i]
        return out

    if len(spans) > 1:  # k-mers whose hash is rare are rare
        slot = slots(a, k)[at] & ((1 << 22) - 1)
        at = at[np.bincount(slot, minlength=1)[slot] >= least]
    cols = [column(*s) for s in spans]
    if len(cols) == 1:
        cols[0].sort()
    else:
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
    n = len(at)
    if not n:
        return [pa.array([], pa.string())], np.empty(0, np.int64)
    differ = lambda cs: np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cs])])
    kind = np.flatnonzero(differ(cols))
    times = np.diff(np.append(kind, n))
    cols = [c[kind] for c in cols]
    head = [*cols[:-1], cols[-1] // np.uint64(base)]
    src = np.flatnonzero(differ(head))
    total = np.add.reduceat(times, src)
    often = total >= least
    of = np.repeat(often, np.diff(np.append(src, len(kind))))
    some = np.flatnonzero(of)
    code = np.empty((len(some), k + 1), np.int64)
    for (lo, hi), c in zip(spans, cols, strict=True):
        left = c[some]
        for i in range(hi - 1, lo - 1, -1):
            code[:, i] = left % np.uint64(base)
            left //= np.uint64(base)
    place = np.searchsorted(some, src[often])
    edge = code[:, k] > 0
    return [texts(letters, code[place, :k]), texts(letters, code[edge])], np.concatenate([total[often], times[some][edge]])


def texts(letters: np.ndarray, code: np.ndarray) -> pa.Array:
    """Rows of ranks (from 1) as strings."""
    n, k = code.shape
    if not n:
        return pa.array([], pa.string())
    flat = np.ascontiguousarray(letters[code - 1])
    if flat.dtype.itemsize > 1:
        return pa.array([r.tobytes().decode("utf-32-le", "surrogatepass") for r in flat.astype("<u4")], pa.string())
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(flat))


def tally(seqs: DataFrame, k: int, least: int) -> DataFrame:
    """``(mer, n)``: k-mers that occur ``least`` times or more, and the (k+1)-mers that begin with one of them."""
    buckets = buckets_of(seqs)

    def cut(batches):
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for a in marked(batch.column(0).to_pylist(), k):
                cols = [[], [], [], []]
                for bucket, letters in runs(a, k, buckets):
                    raw = letters.tobytes()
                    for col, x in zip(cols, (bucket, letters.dtype.itemsize > 1, len(raw), codec.compress(raw, asbytes=True)), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["bucket", "wide", "size", "block"])

    def counted(table: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd", 1)
        parts = [np.frombuffer(codec.decompress(b.as_py(), n.as_py(), asbytes=True), "<u4" if w.as_py() else np.uint8) for w, n, b in zip(table.column("wide"), table.column("size"), table.column("block"), strict=True)]
        if any(p.dtype.itemsize > 1 for p in parts):
            shift = np.arange(256, dtype="<u4")
            shift[list(NARROW)] = WIDE
            parts = [p if p.dtype.itemsize > 1 else shift[p] for p in parts]
        mers, n = count(np.concatenate(parts), k, least)
        return pa.table({"mer": pa.chunked_array(mers, pa.string()).combine_chunks(), "n": pa.array(n, pa.int64())})

    long_ = seqs.where(F.length("seq") >= k)
    return long_.select("seq").mapInArrow(cut, "bucket int, wide boolean, size long, block binary").groupBy("bucket").applyInArrow(counted, "mer string, n long")


#: Residues and "none" as digits, and the bits that the count of a (k+1)-mer has beside its number.
BASE, SPARE = 21, 6
#: First letters that say the bucket; the bits of their number, and what spreads it over them (odd) and back.
FIRST, FIRST_BITS = 6, 27
SPREAD = 0x4F1BBCD
UNSPREAD = pow(SPREAD, -1, 1 << FIRST_BITS)
#: Numbers that a task sorts at a time (160 MB), letters that are numbered and rows that are read at a time, bytes sent.
SORTED, SLICE, ROWS, SENT = 5 << 22, 1 << 17, 500, 1 << 22
LONGEST = 12


def numbers(digits: np.ndarray, w: int) -> np.ndarray:
    """The number of each window of w digits."""
    if w == 1:
        return digits
    kind = next(t for t in (np.uint16, np.uint32, np.uint64) if BASE**w <= np.iinfo(t).max)
    low = numbers(digits, w // 2)
    high = numbers(digits, w - w // 2)[: len(digits) - w + 1].astype(kind)
    high *= kind(BASE ** (w // 2))
    high += low[w - w // 2 :]
    return high


def places(digits: np.ndarray, k: int) -> np.ndarray:
    """Of each k-mer in ``digits`` (0: a sequence ends) and the digit behind it, the number with spread first letters."""
    low, width = digits[:-1], 1
    while 2 * width <= k:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < k:
        low = np.minimum(low[: width - k], low[k - width :])
    at = np.flatnonzero(low)
    first = min(FIRST, k)
    out = numbers(digits, first)[at].astype(np.uint64)
    out = (out * np.uint64(SPREAD)) & np.uint64((1 << FIRST_BITS) - 1)
    out *= np.uint64(BASE ** (k + 1 - first))
    out += numbers(digits[first:], k + 1 - first)[at]
    return out


def unspread(number: np.ndarray, after: int) -> np.ndarray:
    """Plain numbers of those with spread first letters and ``after`` more."""
    rest = np.uint64(BASE**after)
    head = number // rest
    plain = (head * np.uint64(UNSPREAD)) & np.uint64((1 << FIRST_BITS) - 1)
    return plain * rest + (number - head * rest)


def packed(kinds: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending numbers as differences, their bytes by weight, and their counts; compressed."""
    codec = pa.Codec("zstd", 1)
    steps = np.diff(kinds, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    few = times.max() < 256
    return codec.compress(planes.data, asbytes=True), (b"\1" if few else b"\4") + codec.compress(times.astype("<u1" if few else "<u4").data, asbytes=True)


def unpacked(n: int, kinds: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    codec = pa.Codec("zstd", 1)
    planes = np.frombuffer(codec.decompress(kinds, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    steps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(codec.decompress(times[1:], n * times[0], asbytes=True), f"<u{times[0]}")


def each_once(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ascending numbers, and how often each occurs."""
    new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return number[new], np.diff(np.append(new, len(number)))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of all parts, ascending, with the sums of their counts."""
    most = (1 << SPARE) - 1
    rows = []
    for kinds, times in parts:
        # a count stands below its number; a large one takes more rows
        full, left = np.divmod(times.astype(np.uint64), np.uint64(most))
        kinds = kinds << np.uint64(SPARE)
        rows += [(kinds | left)[left > 0], np.repeat(kinds | np.uint64(most), full.astype(np.int64))]
    row = np.concatenate(rows)
    row.sort()
    number = row >> np.uint64(SPARE)
    new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return number[new], np.add.reduceat((row & np.uint64(most)).astype(np.int64), new)


def residues(texts: DataFrame, k: int, least: int) -> DataFrame:
    """``(src, dst, n)`` by numbers, of the peptides (see ``alphabet.normalised``) in the one column of ``texts``: k-mers
    ``dst`` that occur ``least`` times or more, without ``src``, and the pairs of k-mers that begin with one of them."""
    if not 1 < k <= LONGEST:
        raise ValueError(f"k-mers of 2 to {LONGEST} residues are numbers here")
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(max(size >> 20, 32), 1 << 15)
    digit, other = alphabet.digits()
    rest = BASE ** (k + 1 - min(FIRST, k))
    lows = np.array([-(-(b << FIRST_BITS) // buckets) * rest for b in range(buckets + 1)], np.uint64)

    def sent(number: np.ndarray) -> Iterator[pa.RecordBatch]:
        number.sort()
        ends = np.searchsorted(number, lows).tolist()
        cols, held = [[], [], [], []], 0
        for bucket, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
            if i < j:
                kinds, times = each_once(number[i:j])
                for col, x in zip(cols, (bucket, len(kinds), *packed(kinds, times)), strict=True):
                    col.append(x)
                held += len(cols[2][-1])
            if cols[0] and (held >= SENT or bucket == buckets - 1 or j == len(number)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "size", "kinds", "times"])
                cols, held = [[], [], [], []], 0

    def cut(batches):
        held, room = np.empty(SORTED + SLICE, np.uint64), 0
        for batch in batches:
            for some in (batch.column(0).slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                whole = b"\xff".join([*some.cast(pa.binary()).fill_null(b"").to_pylist(), b""])  # no byte of UTF-8
                letters = np.frombuffer(whole.translate(digit, other), np.uint8)
                for lo in range(0, len(letters) - k, SLICE):
                    found = places(letters[lo : lo + SLICE + k], k)
                    held[room : room + len(found)] = found
                    room += len(found)
                    if room >= SORTED:
                        yield from sent(held[:room])
                        room = 0
        if room:
            yield from sent(held[:room])

    def counted(table: pa.Table) -> pa.Table:
        kinds, times = summed([unpacked(*(x.as_py() for x in row)) for row in zip(*(table.column(c) for c in ("size", "kinds", "times")), strict=True)])
        src = kinds // np.uint64(BASE)
        first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        total = np.add.reduceat(times, first)
        often = total >= least
        edge = np.repeat(often, np.diff(np.append(first, len(src)))) & (kinds != src * np.uint64(BASE))
        mer, pair = unspread(src[first[often]], k - min(FIRST, k)).astype(np.int64), unspread(kinds[edge], k + 1 - min(FIRST, k)).astype(np.int64)
        src = pa.concat_arrays([pa.nulls(len(mer), pa.int64()), pa.array(pair // BASE)])
        return pa.table({"src": src, "dst": np.concatenate([mer, pair % BASE**k]), "n": np.concatenate([total[often], times[edge]])})

    return texts.mapInArrow(cut, "bucket int, size long, kinds binary, times binary").groupBy("bucket").applyInArrow(counted, "src long, dst long, n long")


def spelled(rows: DataFrame, k: int, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with the k-mers of ``columns`` as texts for their numbers."""
    letters = np.frombuffer(b"-" + alphabet.ORDERED.encode(), np.uint8)

    def text(number: np.ndarray) -> pa.Array:
        out = np.empty((len(number), k), np.uint8)
        left = number.astype(np.uint64)
        for i in range(k - 1, -1, -1):
            over = left // np.uint64(BASE)
            out[:, i] = letters[left - over * np.uint64(BASE)]
            left = over
        return pa.StringArray.from_buffers(len(out), pa.py_buffer(np.arange(0, (len(out) + 1) * k, k, dtype=np.int32)), pa.py_buffer(out))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([text(c.to_numpy(zero_copy_only=False)) if name in columns else c for name, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c in columns else t}" for c, t in rows.dtypes))
