"""Operator 6: shortest-pack-first packing over the length histogram.

1. Every text is encoded once and cut into pieces of at most ``size`` ids; whole pieces are sequences of their own.
2. The histogram of the other pieces' lengths has fewer than ``size`` rows; packing it, on the driver, gives patterns
   (which lengths share a sequence, and how many such sequences there are).
3. A piece's rank among those of its length says which sequence, and where in it.

Ranks need no sort by length: a task counts the pieces of each length as it writes them, and the sums of these counts
over the tasks in front, joined by (length, task), make the counts ranks.  No group of equal length meets in one task.
Null texts count as empty and still have the closing id; repeated rows are packed each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_batches, per_worker, released, unused, write_table

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long"


LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=-@\[-`{-~"


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[i] : starts[i] + lens[i]]`` for each i of ``index``, one after the other."""
    own = lens[index]
    begin = np.cumsum(own) - own
    at = np.repeat((starts[index] - begin).astype(np.int32), own)  # below the ids of a batch
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


class WordEncoder:
    """The library's ids of many texts at once, for a vocabulary that drops white space and marks word ends.

    Texts are cut at ASCII white space, over which no token reaches; each distinct chunk of a batch is encoded once.  A
    chunk of Latin letters and then marks is two pre-tokens.  Distinct words go to the library many in one call and are
    parted at ids that end a word; if these don't come out as many as the words, and for all other chunks, one by one.
    """

    def __init__(self, vocab_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocab_path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def single(self, chunks: list[str], step: int = 1_000) -> list[np.ndarray]:
        """An encoding of the library holds much more than its ids, so few are there at once."""
        out: list[np.ndarray] = []
        for lo in range(0, len(chunks), step):
            out += [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(chunks[lo : lo + step], add_special_tokens=False)]
        return out

    def words(self, words: list[str], step: int = 4_000) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of all words in turn, and how many are each word's."""
        out, lens = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for lo in range(0, len(words), step):
            some = words[lo : lo + step]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and (not len(ends) or ends[-1] == len(ids)):
                out.append(ids)
                lens.append(np.diff(ends, prepend=0))
            else:
                each = self.single(some)
                out += each
                lens.append(np.fromiter(map(len, each), np.int64, len(each)))
        return out, np.concatenate(lens)

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (strings, no nulls) as little-endian bytes."""
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        kinds, code = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(kinds, f"^[{LETTERS}]*[{MARKS}]*$")
        word = pc.utf8_lower(pc.replace_substring_regex(kinds, f"[{MARKS}]*$", ""))
        mark = pc.replace_substring_regex(kinds, f"^[{LETTERS}]*", "")
        empty = pa.scalar("")
        word, mark = (pc.if_else(plain, x, empty).dictionary_encode() for x in (word, mark))
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        # runs of ids: words, then marks, then other chunks, then the empty run
        names = word.dictionary.to_pylist()
        full = [i for i, w in enumerate(names) if w]
        word_ids, word_lens = self.words([names[i] for i in full])
        rest = self.single(mark.dictionary.to_pylist()) + self.single(kinds.take(pa.array(other)).to_pylist())
        lens = np.zeros(len(names) + len(rest) + 1, np.int64)
        lens[full] = word_lens
        lens[len(names) : -1] = [len(ids) for ids in rest]
        flat = np.concatenate([*word_ids, *rest])
        del word_ids, rest
        starts = np.cumsum(lens) - lens
        parts = np.empty((len(kinds), 2), np.int64)
        parts[:, 0] = word.indices.to_numpy()
        parts[:, 1] = mark.indices.to_numpy() + len(names)
        parts[other, 0] = len(names) + len(mark.dictionary) + np.arange(len(other))
        parts[other, 1] = len(lens) - 1  # nothing
        flat = gather(flat, starts, lens, parts.ravel())
        lens = lens[parts].sum(1)
        starts = np.cumsum(lens) - lens
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        for lo in range(0, len(texts), 128):
            hi = min(lo + 128, len(texts))
            own = code[ends[lo] : ends[hi]]
            raw = gather(flat, starts, lens, own).astype("<u4", copy=False).tobytes()
            upto = np.r_[0, np.cumsum(lens[own])][ends[lo : hi + 1] - ends[lo]].tolist()
            for i, j in zip(upto[:-1], upto[1:], strict=True):
                yield raw[4 * i : 4 * j]


def slices(texts: pa.Array, most: int = 6 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``most`` bytes of text each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def cut_pieces(docs: DataFrame, vocab_path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document, in one pass, with the library's ids; a piece is the ``nth`` of its length of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, begun = TaskContext.get().partitionId(), defaultdict(int)
        pa.set_memory_pool(pa.system_memory_pool())  # the other kinds keep what they once had
        encoder = per_worker(WordEncoder, vocab_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                cols: list[list] = [[], [], [], [], [], []]
                texts = pc.fill_null(part.column(1), "").cast(pa.string())
                for doc, ids in zip(part.column(0).to_pylist(), encoder(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        length = len(piece) // 4
                        for col, x in zip(cols, (doc, start, length, zlib.crc32(piece), n, begun[length]), strict=True):
                            col.append(x)
                        begun[length] += 1
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], pa.array([task] * len(cols[0]), pa.int32())], names=["id", "start", "length", "ids_crc32", "doc_tokens", "nth", "task"])
                del part, texts, cols
                unused()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda batches: released(run(batches)), f"{PIECES}, nth long, task int")


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns ``(sequences, ((length, times), ...))``, lengths descending.

    Lengths are placed longest first, each into the packs that are shortest so far and still have room; a count of
    equal packs moves together.  A pattern lists a length once, so it has at most sqrt(2 * size) entries.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # room left -> [count, pattern]
    done: list[tuple[int, tuple]] = []

    def put(count: int, pattern: tuple, room: int) -> None:
        if room:
            open_packs[room].append([count, pattern])
        else:
            done.append((count, pattern))

    def grown(pattern: tuple, length: int, times: int) -> tuple:
        return (*pattern[:-1], (length, pattern[-1][1] + times)) if pattern and pattern[-1][0] == length else (*pattern, (length, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs and r >= length), default=0)
            if not room:  # new packs, each with one piece of this length, until none is left
                put(left, ((length, 1),), size - length)
                break
            there, pattern = open_packs[room].pop()
            used = min(there, left)
            if there > used:
                open_packs[room].append([there - used, pattern])
            put(used, grown(pattern, length, 1), room - length)
            left -= used
    done += [(c, p) for packs in open_packs.values() for c, p in packs]
    return sorted(done, key=lambda x: (x[1], x[0]), reverse=True)


def places(patterns: list, first: int = 0) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """By length: where runs of ranks begin, and each run's (first sequence, offset, count)."""
    out: dict[int, tuple[list[int], list]] = defaultdict(lambda: ([], []))
    begun: dict[int, int] = defaultdict(int)
    sequence = first
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                starts, runs = out[length]
                starts.append(begun[length])
                runs.append((sequence, offset, count))
                begun[length] += count
                offset += length
        sequence += count
    return dict(out)


def pack(docs: DataFrame, vocab_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and offset; see the module."""
    with arrow_batches(docs.sparkSession, 2000):
        pieces = write_table(cut_pieces(docs, vocab_path, size, end_id, id_col, text_col), "pieces")
    by_task = write_table(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # a window row is a task's count, not a piece
    in_front = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = write_table(by_task.select("length", "task", F.coalesce(F.sum("n").over(in_front), F.lit(0)).alias("before")), "offsets")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    full = counts.pop(size, 0)
    where = places(pack_histogram(counts, size), full)
    # no broadcast hint: offsets grow with the number of tasks, and Spark checks their size
    ranked = pieces.join(offsets, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, at = [], []
            for length, rank in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if length == size:
                    sequences.append(rank)
                    at.append(0)
                else:
                    starts, runs = where[length]
                    k = bisect_right(starts, rank) - 1
                    sequences.append(runs[k][0] + rank - starts[k])
                    at.append(runs[k][1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences, pa.int64()), pa.array(at, pa.int64())], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    flat = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank"))
    return flat.mapInArrow(lambda batches: released(run(batches)), f"{PIECES}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
