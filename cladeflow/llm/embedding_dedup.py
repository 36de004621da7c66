"""Operator 7: near-duplicate vectors by random-hyperplane signs, exact cosine and connected components.

1. Equal vectors of a label are one class with a weight.
2. Tables of hyperplane signs; a bucket is (label, dimension, table, signs).  The number of signs grows with the
   logarithm of the largest label's classes, so that buckets of vectors that have nothing in common stay small, and the
   number of tables with it, so that a pair at ``least`` shares no bucket with probability ``MISS`` at most, at any size.
3. In a bucket every pair that could join two parts is tested by its exact cosine in double precision; the links give
   the components.  The first ``FIRST`` tables are dealt out whole; of the others only ids are, and vectors follow for
   buckets whose members are not in one component by then.
4. Linked vectors are in one component, so the number of links is counted inside components, over all pairs, in
   blocks of a component's rows; pairs are counted, never emitted.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or id, link
with nothing: 0 links, a component of their own (null for a null id), kept.  Vectors of different length never link.
Repeated rows (same id) count as one vector and are returned each.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .closure import closure, labels_of
from .common import components, released, whole_groups, write_table

MISS, FIRST, BLOCK, COUNTED = 4e-5, 3, 1024, 8192


def design(classes: int, least: float) -> tuple[int, int]:
    """Signs of a table and tables, for labels of up to so many classes."""
    bits = min(62, 4 + math.ceil(math.log2(max(classes, 256))))
    same = (1 - math.acos(min(1.0, least)) / math.pi) ** bits
    return bits, max(FIRST + 1, math.ceil(math.log(MISS) / math.log(1 - same))) if same < 1 else FIRST + 1


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Fixed Gaussian normals, (dim, tables * bits)."""
    return np.random.default_rng(20260105).standard_normal((tables * bits, dim)).T


def vectors(rows: DataFrame) -> DataFrame:
    """``(id, vec_key, place, unit)``: unit vectors in double precision of usable rows; one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units, places = [], [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                flat = values.values
                x = np.array([]) if label is None or flat is None or flat.null_count else flat.to_numpy(zero_copy_only=False).astype(np.float64)
                big = float(np.abs(x).max()) if len(x) and np.isfinite(x).all() else 0.0
                if not big:
                    keys.append(None)
                    units.append(None)
                    places.append(None)
                    continue
                unit = x / big  # no overflow
                unit = unit / np.sqrt(unit @ unit)
                keys.append(hashlib.blake2b(repr(label).encode() + b"|" + x.tobytes(), digest_size=16).digest())
                units.append(unit.tobytes())
                places.append(int.from_bytes(hashlib.blake2b(f"{label}|{len(x)}".encode(), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.int64()), pa.array(units, pa.binary())], names=["id", "vec_key", "place", "unit"])

    return rows.mapInArrow(lambda batches: released(run(batches)), "id long, vec_key binary, place long, unit binary")


def signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(id, size, payload, buckets)``: classes ``(id, size, place, payload)`` with a bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            buckets = []
            for place, payload in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                unit = np.frombuffer(payload, np.float64)
                if len(unit) not in made:
                    made[len(unit)] = planes(len(unit), bits, tables)
                signs = (unit @ made[len(unit)] > 0).reshape(tables, bits) @ powers
                buckets.append([int.from_bytes(hashlib.blake2b(f"{place}|{t}|{s}".encode(), digest_size=8).digest(), "little", signed=True) for t, s in enumerate(signs.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(buckets, pa.list_(pa.int64()))], names=["id", "size", "payload", "buckets"])

    return classes.select("id", "size", "place", "payload").mapInArrow(lambda batches: released(run(batches)), "id long, size long, payload binary, buckets array<long>")


def cosine_labeler(least: float):
    def label(payload: list[bytes], size: np.ndarray) -> np.ndarray:
        sizes = np.array(list(map(len, payload)))
        if sizes.min() != sizes.max():  # bucket keys that collide: each dimension for itself
            out = np.arange(len(payload))
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                out[own] = own[label([payload[i] for i in own.tolist()], size[own])]
            return out
        x = np.frombuffer(b"".join(payload), np.float64).reshape(len(payload), -1)
        near = x @ x.T >= least
        return labels_of(lambda i: near[i], len(x))

    return label


def link_counts(members: DataFrame, least: float, block: int) -> DataFrame:
    """``(id, n_links)`` inside each group, over all its pairs: ``members(group, id, payload, size = weight, n)``."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = own.select("id", "payload", "size", "own", F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("task"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["task"]):
            task, size, own_of = pdf["task"].to_numpy(), pdf["size"].to_numpy(), pdf["own"].to_numpy()
            payload, counts = pdf["payload"].tolist(), np.zeros(len(pdf), np.int64)
            cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x, b, w = np.frombuffer(b"".join(payload[lo:hi]), np.float64).reshape(hi - lo, -1), own_of[lo:hi], size[lo:hi]
                apart = b.min() != b.max()  # two blocks: the pairs across
                for i in range(0, hi - lo, BLOCK):  # a strip of the pairs at a time
                    near = x[i : i + BLOCK] @ x.T >= least
                    if apart:
                        near &= b[i : i + BLOCK, None] != b[None]
                    else:
                        near[np.arange(len(near)), i + np.arange(len(near))] = False
                    counts[lo + i : lo + i + len(near)] = near @ w
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "n": counts})

    return dealt.repartition("task").sortWithinPartitions("task", "id").mapInPandas(lambda batches: released(run(batches)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def near_vectors(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row; see the module."""
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    marked = write_table(vectors(plain), "vectors")
    usable = marked.where("id is not null and vec_key is not null")
    classes = write_table(usable.groupBy("vec_key").agg(F.min("id").alias("id"), F.countDistinct("id").alias("size"), F.first("place").alias("place"), F.first("unit").alias("payload")), "classes")
    most = classes.groupBy("place").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    keyed = write_table(signed(classes, *design(most, least)), "buckets")
    slots = keyed.select("id", F.posexplode("buckets").alias("table", "group"))

    def dealt(some: DataFrame) -> DataFrame:
        return write_table(some.join(keyed.select("id", "size", "payload"), "id"), "dealt")

    shared = lambda some: some.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("center")).where("n > 1")
    early = slots.where(F.col("table") < FIRST).select("id", "group")
    links = write_table(closure(dealt(early.join(shared(early), "group")), cosine_labeler(least), block), "links")
    known = write_table(components(links), "known")
    late = slots.where(F.col("table") >= FIRST).select("id", "group")
    late = late.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parted = late.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("center"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group", "n", "center")
    rest = closure(dealt(late.select("id", "group").join(parted, "group")), cosine_labeler(least), block)
    found = write_table(components(links.select("a", "b").unionByName(rest.select("a", "b"))), "components")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    inside = found.join(sizes, "component").select("id", F.col("component").alias("group"), "n").join(classes.select("id", "size", "payload"), "id")
    links = link_counts(inside, least, min(COUNTED, 8 * block))
    named = classes.select("vec_key", "id", "size").join(found, "id", "left").join(links, "id", "left")
    named = named.select("vec_key", F.coalesce("component", "id").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"))
    out = marked.select("id", "vec_key").withColumn("vec_key", F.when(F.col("id").isNotNull(), F.col("vec_key"))).join(named, "vec_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT e.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS BIGINT) AS n_links,
  CAST(c.component_id AS BIGINT) AS component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
