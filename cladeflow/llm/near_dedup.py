"""Operator 8: near-duplicates by SetSketch registers.

1. A document is the set of its distinct word shingles (64-bit hashes).  Equal sets are one class from here on.
2. SetSketch: per register, the minimum over the set of an exponential variable, kept as the truncated exponent of
   base ``BASE``; registers of a union are register-wise maxima, so sketches merge.
3. Register values are banded.  Members of a bucket are compared by the joint likelihood of both sketches, given the
   exact set sizes: does the most likely Jaccard similarity reach ``threshold - MARGIN``?
4. Documents connected by such pairs form candidate groups; inside a group every pair that could still join two parts
   is checked on the full sets.
5. Buckets whose members are not in one component by then are checked on the full sets too.  So the sketches only say
   what is looked at first, and no pair of a bucket is refused without its sets.  All links give the components.

Misses: pairs of which all ``BANDS`` bands of ``ROWS`` rows differ; for sets of equal size and ideal hashing with
probability 7.7e-6 at similarity 0.80 and 1.4e-8 at 0.85.

A null or empty text has an empty set: it links with nothing and is kept.  Rows with a null id take no part: their
component is null and they are kept.  Repeated rows are returned each, with one component.  Ties go to the smaller id.
Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .closure import closure, labels_of
from .common import Generations, arrow_batches, components, only, per_worker, released, write_table

ROWS, BANDS, BASE, RATE, MARGIN = 6, 36, 1.1, 20.0, 0.1
M = ROWS * BANDS
_SPAN = (1 << 64) - 1


def _odd(n: int, salt: str) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{salt}{i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(n)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of distinct word n-shingles: A-Z lower-cased, words between ASCII white space."""

    def __init__(self, words: int, memo: int = 200_000):
        self.n = words
        self.factors = _odd(words, "word")
        self.known = Generations(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), memo)

    def __call__(self, data: bytes | None) -> np.ndarray:
        words = (data or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        self.known.trim()
        k = min(self.n, len(h))
        total = np.full(len(h) - k + 1, len(h) if k < self.n else 0, np.uint64)
        for i in range(k):
            total += mix(h[i : len(h) - k + 1 + i] * self.factors[i])
        return np.unique(mix(total))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint8) of non-empty sets, one row each."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    factors, shifts, out = _odd(M, "register"), _odd(M, "shift"), np.empty((len(sets), M), np.uint8)
    for j in range(M):
        low = np.minimum.reduceat((flat ^ shifts[j]) * factors[j], starts)
        # -ln(1 - u) / RATE is exponential, and grows with u: the least u gives the least value
        least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, j] = np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / np.log(BASE)), 0, 255)
    return out


def likely(du: np.ndarray, dv: np.ndarray, nu: np.ndarray, nv: np.ndarray, at: float) -> np.ndarray:
    """Is the maximum of the joint likelihood at a Jaccard similarity of ``at`` or more?

    du, dv: registers where the first or the second sketch is larger; nu, nv: set sizes.  The log-likelihood is
    concave in the similarity (Ertl 2021), so its slope at ``at`` tells.
    """
    u, v = nu / (nu + nv), nv / (nu + nv)
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * c) / np.log(BASE)
    slope = lambda x: c / (np.log(BASE) * (1 - np.clip(x, 0, 1) * c))
    x, y = u - v * at, v - u * at
    up, vp, ud, vd = np.maximum(p(x), 1e-9), np.maximum(p(y), 1e-9), -v * slope(x), -u * slope(y)
    score = du * ud / up + dv * vd / vp - (M - du - dv) * (ud + vd) / np.maximum(1 - up - vp, 1e-9)
    return (score >= 0) & (np.minimum(nu, nv) >= at * np.maximum(nu, nv))


def sketch_labeler(at: float):
    """Components by the joint likelihood of sketches."""

    def label(payload: list[bytes], size: np.ndarray) -> np.ndarray:
        regs = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), M)
        size = size.astype(np.float64)

        def links(i: int) -> np.ndarray:
            du, dv = (regs[i] > regs).sum(1), (regs[i] < regs).sum(1)
            return likely(du, dv, size[i], size, at)

        return labels_of(links, len(payload))

    return label


def set_labeler(percent: int):
    """Components by exact Jaccard similarity: 100 * intersection >= percent * union."""

    def label(payload: list[bytes], size: np.ndarray) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in payload]
        n, lens = len(sets), np.array(list(map(len, sets)))
        if n == 2:
            common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return np.array([0, 0 if 100 * common >= percent * (lens.sum() - common) else 1])
        order, where = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.r_[0, np.cumsum(lens)[:-1]]
        mark = np.zeros(len(order), np.int32)

        def links(i: int) -> np.ndarray:
            own = where[starts[i] : starts[i] + lens[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[where], starts)
            mark[own] = 0
            return 100 * common >= percent * (lens + lens[i] - common)

        return labels_of(links, n)

    return label


def features(docs: DataFrame, words: int) -> DataFrame:
    """Per row: set size, set key (equal for equal sets), sketch, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, factors = per_worker(Shingler, words), _odd(ROWS, "band")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingle(x) for x in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, regs, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    found = sketches([sets[i] for i in full])
                    key = mix((mix(found.reshape(len(full), BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * factors).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                    for k, i in enumerate(full):
                        keys[i], regs[i], bands[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), found[k].tobytes(), key[k]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_key", "sketch", "bands"])

    return docs.mapInArrow(lambda batches: released(run(batches)), "id long, n_shingles long, set_key binary, sketch binary, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = per_worker(Shingler, words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([shingle(x).tobytes() for x in part.column(2).to_pylist()], pa.binary())], names=["id", "group", "payload"])

    return docs.select("id", "group", "text").mapInArrow(lambda batches: released(run(batches)), "id long, group long, payload binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row; see the module."""
    with arrow_batches(docs.sparkSession, 1000):
        return _near_duplicates(docs, words, percent, id_col, text_col)


def _near_duplicates(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    marked = write_table(features(texts, words), "sketches")
    full = marked.where("id is not null and set_key is not null")
    classes = write_table(full.groupBy("set_key").agg(F.min("id").alias("id"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes")

    # buckets of two classes or more
    slots = classes.select("id", F.explode("bands").alias("group"))
    shared = slots.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("center")).where("n > 1")
    seats = slots.join(shared, "group")
    members = write_table(seats.join(classes.select("id", "size", F.col("sketch").alias("payload")), "id"), "buckets")
    candidates = components(closure(members, sketch_labeler(percent / 100 - MARGIN)))

    # full sets of candidates only
    groups = write_table(candidates.withColumnRenamed("component", "group"), "groups")
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("center"))
    sets = shingle_sets(texts.join(groups, "id"), words)
    confirmed = write_table(sets.join(sizes, "group").withColumn("size", F.lit(0).cast("long")), "sets")
    links = write_table(closure(confirmed, set_labeler(percent)), "links")
    found = components(links)

    # pairs of a bucket that are not linked by then, whatever their sketches say
    placed = members.select("group", "id", "n", "center").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parted = placed.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group")
    rest = write_table(placed.drop("component").join(parted, "group"), "parted")
    if not rest.isEmpty():
        ids = rest.select("id").distinct()
        own = write_table(shingle_sets(only(texts, "id", ids).withColumn("group", F.lit(0).cast("long")), words).drop("group"), "parted_sets")
        unsure = write_table(rest.join(own, "id").withColumn("size", F.lit(0).cast("long")), "unsure")
        found = components(links.unionByName(closure(unsure, set_labeler(percent))))

    named = classes.select("set_key", F.col("id").alias("class_id")).join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("set_key", F.coalesce("component", "class_id").alias("component"))
    out = marked.select("id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
"""
