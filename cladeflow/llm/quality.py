"""Operator 2: quality by perplexity under an interpolated modified Kneser-Ney model.

Symbols are UTF-8 bytes; the model has order ``ORDER``, with null bytes in front of a text.

1. Training: n-gram counts of trusted texts, summed per task and then by n-gram.  Lower orders are continuation
   counts.  Discounts D1, D2, D3+ come from each order's counts of counts.
2. Scoring: each input split asks, once, for its distinct n-grams; these are joined with counts and contexts order by
   order, all sharded by n-gram, which gives a probability each; the answers go back to the split they were asked
   by, where its texts, compressed, meet them.  So what moves is bounded by the input and by distinct n-grams, no
   n-gram occurrence is shuffled, and the model is nowhere held whole.
3. Thresholds: a quantile of bits per byte over trusted texts held out from training: over all, per language, and per
   language and size class.  Each but the first is drawn to the one before as if that stood for ``PRIOR`` more texts, so
   every group with held-out texts counts by their number, and no number of them is a switch.

A text is rejected if its bits per byte exceed its threshold by more than ``MARGIN``: a good text with one strange
span, such as a key that operator 4 hides later, stays.  Null and empty texts have no
perplexity and are kept.  A null language is a language of its own.  Without trusted texts all are kept.  Rows that
repeat an id are scored each; rejected rows go by id and text.  Rows with a null id are scored, and never removed.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ID, MAY, arrow_batches, may_hold, only, released, write_table

ORDER = 5
QUANTILE, MARGIN, PRIOR = 0.995, 0.1, 20
#: One in this many trusted texts is held out, for thresholds.
HELD_OUT = 5
FLUSH = 1_000_000
KEY = "_cladeflow_text_key"
#: Texts in a parcel, parcels in an Arrow batch; n-grams in a row of answers.
PARCEL, ANSWERS = 128, 16_384


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, as an integer, and where each text's begin."""
    pad = bytes(ORDER - 1)
    raw = np.frombuffer(b"".join([pad + t for t in texts]), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lens) - lens
    key = np.zeros(max(0, len(raw) - ORDER + 1), np.int64)
    for j in range(ORDER):
        key |= raw[ORDER - 1 - j : len(raw) - j].astype(np.int64) << (8 * j)
    inside = np.ones(len(raw), bool)
    inside[(starts + np.arange(len(texts)) * (ORDER - 1))[:, None] + np.arange(ORDER - 1)] = False
    return key[inside[ORDER - 1 :]], starts


class Tally:
    """Distinct n-grams with counts, merged now and then so that memory follows distinct ones."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.held += len(found)
        if self.held > FLUSH:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, n = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
        found, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, n, len(found)).astype(np.int64)
        self.parts, self.held = [(found, total)], len(found) // 2
        return found, total


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about ``most`` bytes, with the row each run begins at."""
    begin, held, size = 0, [], 0
    for i in range(len(column)):
        held.append(column[i].as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def count_ngrams(texts: DataFrame) -> DataFrame:
    """``(key, c)`` over all texts (column ``text``, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, some in slices(batch.column(0)):
                tally.add(ngrams(some)[0])
        keys, n = tally.merge()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "c"])

    return texts.select("text").mapInArrow(lambda batches: released(run(batches)), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def asked_ngrams(texts: DataFrame) -> DataFrame:
    """``(split, key)``: the distinct n-grams of each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[int, Tally] = {}
        for batch in batches:
            split = batch.column(0).to_numpy()
            for lo, some in slices(batch.column(1)):
                own = split[lo : lo + len(some)]
                for s in np.unique(own).tolist():
                    tallies.setdefault(s, Tally()).add(ngrams([t for t, x in zip(some, own.tolist(), strict=True) if x == s])[0])
        for s, tally in tallies.items():
            keys = tally.merge()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), s, np.int64)), pa.array(keys)], names=["split", "key"])

    return texts.select("split", "text").mapInArrow(lambda batches: released(run(batches)), "split long, key long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from counts of counts; where these give none, 0.5, 1 and 1.5."""
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``(key, p)`` for each of the asked n-grams: joins with counts and contexts from order 1 up."""
    low = lambda k: F.col("key").bitwiseAND((1 << 8 * k) - 1)
    tables, needed = {ORDER: counts}, {ORDER: write_table(asked.select("key").distinct(), "needed")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = write_table(tables[k + 1].groupBy(low(k).alias("key")).agg(F.count(F.lit(1)).alias("c")), f"counts{k}")
        needed[k] = needed[k + 1].select(low(k).alias("key")).distinct()
    p = None
    for k in range(1, ORDER + 1):
        of = [F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]
        d1, d2, d3 = discounts(*tables[k].agg(*of).first())
        context = F.shiftright("key", 8)
        contexts = tables[k].groupBy(context.alias("context")).agg(
            F.sum("c").alias("total"), (d1 * F.count_if(F.col("c") == 1) + d2 * F.count_if(F.col("c") == 2) + d3 * F.count_if(F.col("c") > 2)).alias("mass")
        )
        step = needed[k].join(tables[k], "key", "left").withColumn("context", context).join(contexts, "context", "left")
        step = step.withColumn("lower", F.lit(1 / 256)) if p is None else step.withColumn("low", low(k - 1)).join(p.withColumnsRenamed({"key": "low", "p": "lower"}), "low")
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        seen = (F.coalesce(F.col("c") - taken, F.lit(0.0)) + F.col("mass") * F.col("lower")) / F.col("total")
        p = step.select("key", F.coalesce(seen, "lower").alias("p"))
    return p


ROW = "split long, kind int, a binary, b binary, ids array<long>, text_keys array<long>, langs array<string>, sizes array<int>"
NAMES = ["split", "kind", "a", "b", "ids", "text_keys", "langs", "sizes"]


def answers(asked: DataFrame, p: DataFrame) -> DataFrame:
    """Answers in rows of many: n-grams (a) and bits (b) for one split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def rows() -> pa.RecordBatch:
            split, key, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(split, kind="stable")
            split, key, bits = split[order], key[order], bits[order]
            cuts = np.flatnonzero(np.r_[True, split[1:] != split[:-1], True])
            parts = [(k, min(k + ANSWERS, j)) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for k in range(i, j, ANSWERS)]
            none = [None] * len(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array(split[[i for i, _ in parts]]), pa.array([0] * len(parts), pa.int32()), pa.array([key[i:j].tobytes() for i, j in parts], pa.binary()), pa.array([bits[i:j].tobytes() for i, j in parts], pa.binary()), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.string())), pa.array(none, pa.list_(pa.int32()))],
                names=NAMES,
            )

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float32)))
            n += batch.num_rows
            if n > 1_000_000:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    return asked.join(p, "key").select("split", "key", -F.log2("p").alias("bits")).mapInArrow(lambda batches: released(run(batches)), ROW)


def parcels(texts: DataFrame) -> DataFrame:
    """A split's texts in compressed rows of up to ``PARCEL``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for lo in range(0, batch.num_rows, PARCEL):
                part = batch.slice(lo, PARCEL)
                split = part.column(0).to_numpy()
                for s in np.unique(split).tolist():
                    own = part.filter(pa.array(split == s))
                    some = [x or b"" for x in own.column(4).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int64()), pa.array([1], pa.int32()), pa.array([squeeze.compress(b"".join(some))], pa.binary()), pa.array([None], pa.binary()), pa.array([own.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([own.column(2).to_pylist()], pa.list_(pa.int64())), pa.array([own.column(3).to_pylist()], pa.list_(pa.string())), pa.array([[len(x) for x in some]], pa.list_(pa.int32()))],
                        names=NAMES,
                    )

    return texts.select("split", "id", "text_key", "lang", "text").mapInArrow(lambda batches: released(run(batches)), ROW)


class Table:
    """Bits by n-gram: a direct-mapped table, and binary search where two n-grams share a place."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.bits = keys[order], bits[order]
        self.shift = np.uint64(64 - max(12, int(len(keys)).bit_length() + 3))
        self.slot_key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.slot_bits = np.zeros(len(self.slot_key), np.float32)
        at = self.place(self.keys)
        self.slot_key[at], self.slot_bits[at] = self.keys, self.bits

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        out = self.slot_bits[at]
        miss = np.flatnonzero(self.slot_key[at] != keys)
        if len(miss):
            where = np.searchsorted(self.keys, keys[miss])
            if (where == len(self.keys)).any() or (self.keys[where] != keys[miss]).any():
                raise RuntimeError("a split's texts changed while they were scored")
            out[miss] = self.bits[where]
        return out


def scored(rows: DataFrame, splits: int) -> DataFrame:
    """``(id, text_key, lang, n_bytes, bits)`` from a split's answers and then its texts; ``splits`` is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loosen, split, table, keys, bits = zstandard.ZstdDecompressor(), None, None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                s, kind, a, b, ids, text_keys, langs, sizes = (batch.column(c)[i].as_py() for c in range(8))
                if s != split:
                    split, table, keys, bits = s, None, [], []
                if not kind:
                    keys.append(np.frombuffer(a, np.int64))
                    bits.append(np.frombuffer(b, np.float32))
                    continue
                if table is None:
                    table = Table(np.concatenate(keys or [np.empty(0, np.int64)]), np.concatenate(bits or [np.empty(0, np.float32)]))
                    keys, bits = [], []
                data, ends = loosen.decompress(a) if a else b"", np.cumsum(sizes).tolist()
                texts = [data[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                full = [k for k, n in enumerate(sizes) if n]
                total = np.zeros(len(sizes))
                if full:
                    found, starts = ngrams([texts[k] for k in full])
                    total[full] = np.add.reduceat(table(found).astype(np.float64), starts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(text_keys, pa.int64()), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(total)], names=["id", "text_key", "lang", "n_bytes", "bits"])

    # more partitions than splits, so that few meet in one task however many there are
    parts = max(2 * splits, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "split").sortWithinPartitions("split", "kind").mapInArrow(lambda batches: released(run(batches)), "id long, text_key long, lang string, n_bytes long, bits double")


def split_id() -> Column:
    """The input split a row is read from: the same whenever the same files are read."""
    return F.xxhash64(F.input_file_name(), F.input_file_block_start())


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, text_key, lang, n_bytes, bits_per_byte)`` of every row of ``docs`` under a model of the rows whose id is in
    ``trusted(id)``; the key is a hash of the text.  Rows that don't come straight from files are written first, so that splits stay the same."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text")).withColumn("text_key", F.xxhash64("text"))
    if not plain.where(F.input_file_name() == "").isEmpty():
        plain = write_table(plain, "texts")
    train = write_table(count_ngrams(only(plain, "id", trusted)), f"counts{ORDER}")
    texts = plain.withColumn("split", split_id())
    asked = write_table(asked_ngrams(texts), "asked")
    p = probabilities(train, asked)
    replies = write_table(answers(asked, p), "answers")
    with arrow_batches(docs.sparkSession, PARCEL):
        found = write_table(scored(parcels(texts).unionByName(replies), asked.select("split").distinct().count()), "scores")
    return found.select("id", "text_key", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def size_class() -> Column:
    return F.floor(F.log2(F.greatest("n_bytes", F.lit(1)))).cast("int")


def thresholds(scores: DataFrame, held_out: DataFrame, quantile: float) -> DataFrame:
    """``(level, lang, size, n, threshold)``: level 2 per language and size class, 1 per language, 0 over all; n is the
    number of held-out texts.

    The quantile is taken from a histogram in steps of 0.001 bits, a bounded number of rows for each language.
    """
    known = scores.where("bits_per_byte is not null").join(held_out.select("id").distinct(), "id").withColumn("size", size_class()).withColumn("bin", F.ceil(F.col("bits_per_byte") * 1000))
    hist = known.groupBy(F.coalesce("lang", F.lit("\0")).alias("lang"), "size", "bin").agg(F.count(F.lit(1)).alias("n"))
    parts = [hist.withColumn("level", F.lit(2)), hist.withColumn("size", F.lit(-1)).withColumn("level", F.lit(1)), hist.withColumn("size", F.lit(-1)).withColumn("lang", F.lit("")).withColumn("level", F.lit(0))]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("level", "lang", "size", "bin").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("level", "lang", "size")
    at = each.withColumn("upto", F.sum("n").over(over.orderBy("bin"))).withColumn("total", F.sum("n").over(over))
    return at.where(F.col("upto") >= quantile * F.col("total")).groupBy("level", "lang", "size").agg(F.max("total").alias("n"), (F.min("bin") / 1000).alias("threshold"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``(id, lang, n_bytes, bits_per_byte, threshold, keep, text_key)`` per row; trusted are ids labelled quality 1 and not toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("id"))
    bad = labels.where("quality = 0 or toxic = 1").select(F.col("doc_id").cast("long").alias("id"))
    good = write_table(good.where("id is not null").distinct().join(bad, "id", "left_anti"), "trusted")
    out = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    scores = perplexities(docs, good.where(~out), id_col, text_col, lang_col)
    limits = write_table(thresholds(scores, good.where(out), quantile), "thresholds")
    lang = F.coalesce("lang", F.lit("\0"))
    fine = limits.where("level = 2").select(F.col("lang").alias("l2"), F.col("size").alias("s2"), F.col("n").alias("n2"), F.col("threshold").alias("t2"))
    coarse = limits.where("level = 1").select(F.col("lang").alias("l1"), F.col("n").alias("n1"), F.col("threshold").alias("t1"))
    every = limits.where("level = 0").select(F.col("threshold").alias("t0"))
    judged = scores.join(fine, (lang == F.col("l2")) & (size_class() == F.col("s2")), "left").join(coarse, lang == F.col("l1"), "left").join(F.broadcast(every), F.lit(True), "left")
    drawn = lambda n, t, to: F.coalesce((F.col(n) * F.col(t) + PRIOR * F.col(to)) / (F.col(n) + PRIOR), to)
    judged = judged.withColumn("t1", drawn("n1", "t1", "t0")).withColumn("threshold", drawn("n2", "t2", "t1"))
    keep = F.coalesce(F.col("bits_per_byte") <= F.col("threshold") + margin, F.lit(True))
    return judged.select(F.col("id").alias(id_col), "lang", "n_bytes", "bits_per_byte", "threshold", keep.alias("keep"), "text_key")


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows judged low; columns as they are.  Rows go by id and text, so a good text stays though
    another one under its id goes.  Rows that surely stay are not shuffled."""
    low = judge(docs, labels, id_col, text_col, **how).where("not keep").select(F.col(id_col).alias("id"), "text_key")
    rejected = write_table(low.where("id is not null").distinct(), "rejected")
    marked = may_hold(docs, id_col, rejected.select("id"))
    likely = marked.where(MAY).drop(MAY)
    on = (likely[id_col].cast("long") == F.col(ID)) & (F.xxhash64(likely[text_col].cast("binary")) == F.col(KEY))
    stay = likely.join(rejected.select(F.col("id").alias(ID), F.col("text_key").alias(KEY)), on, "left_anti")
    return marked.where(f"not {MAY}").drop(MAY).unionByName(stay)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")
