"""Operator 5: exact top-k by inner product over a vector-approximation file.

Components are made integers, floor(scale * x).  The approximation file has a byte a component: which of ``CELLS``
cells its value lies in.  Inner edges are quantiles, by dimension, of at most ``SAMPLE`` vectors (those with the
smallest hash); outer edges are the least and the greatest value of all vectors; so every vector lies in its cells,
whatever was sampled, and a query with the cells' edges bounds its score from both sides.

1. Of vectors that stand on more than k + 1 ids, the k + 1 smallest ids can be results and the others can't (ties go to
   the smaller id, a query's own id excepted); so a group of copies of any size costs k + 1 rows.
2. Queries go in chunks of a fixed size (so what is broadcast is bounded).  For a chunk, a scan of the cells gives every
   query's k largest lower bounds; the kth of them, over all tasks, is a floor that the kth result can't fall below.
3. A second scan of the cells names the rows whose upper bound reaches the floor of some query.
4. Exact vectors of these rows only are taken; in a task each query reads them in order of upper bounds, until its kth
   exact score is above every bound left.  The tasks' k best are merged.

Vectors that are null, empty, or hold null or non-finite components (scaled ones included), and rows with a null id,
take no part, as queries or as candidates.  Repeated rows are candidates each (never of a query with their own id).
Vectors of another length than the query's are no candidates.  Other columns are not read.  Scores are exact for all
finite components; one that would be returned and doesn't fit a long is an error, as an overflow is in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import MAY, may_hold, only, released, without, write_table

#: Queries of one scan: what is broadcast is at most QUERIES vectors.  HELD bounds the numbers of a block of bounds.
CELLS, SAMPLE, QUERIES, K, HELD = 256, 4096, 8192, 5, 1 << 21
RESULT = "query_id long, vec_id long, score long, times int"


def exact_vectors(rows: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """``(id, dim, exact, digest)`` of usable rows, written: integers as int32 where they fit, else as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, exact = [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = values.values
                if vec_id is None or flat is None or flat.null_count or not len(flat):
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
                if not np.isfinite(x).all():
                    continue
                ids.append(vec_id)
                dims.append(len(x))
                exact.append((x.astype(np.int32) if np.abs(x).max() < 2**31 else x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(exact, pa.binary())], names=["id", "dim", "exact"])

    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    found = plain.mapInArrow(lambda batches: released(run(batches)), "id long, dim int, exact binary")
    return write_table(found.withColumn("digest", F.xxhash64("exact")), "exact")


def unpack(column: list[bytes], dim: int) -> np.ndarray:
    """Vectors as doubles (exactly: they are integers of 32 bits, or were doubles)."""
    if all(len(x) == 4 * dim for x in column):
        return np.frombuffer(b"".join(column), np.int32).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(x, np.int32 if len(x) == 4 * dim else np.float64).astype(np.float64) for x in column])


def without_surplus_copies(table: DataFrame, k: int) -> DataFrame:
    """Rows that can be a result: of each vector those with the k + 1 smallest ids.  Rows of vectors that surely stand
    on few ids are not shuffled; others move as (vector, id), and each task hands on at most k + 1 ids of a vector."""
    often = table.groupBy("dim", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1)
    often = write_table(often.select(F.col("digest").alias("id")).distinct(), "often")
    if often.isEmpty():
        return table
    many = only(table, "digest", often)
    ids = many.select("dim", "exact", "id").distinct()
    first = Window.partitionBy("dim", "exact").orderBy("id")
    kept = ids.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1).select("dim", "exact", "id")
    return without(table, "digest", often).unionByName(many.join(kept, ["dim", "exact", "id"], "left_semi").select(*table.columns))


def edges_of(table: DataFrame, dim: int, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """(cells + 1, dim) edges in rising order: a value v lies in the last cell whose lower edge is at most v."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch.column(0).to_pylist(), dim)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(low), pa.array(high)], names=["at", "low", "high"])

    ends = table.select("exact").mapInArrow(lambda batches: released(extremes(batches)), "at int, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()  # a row a component
    some = table.select("exact", F.xxhash64("id", "digest").alias("h")).orderBy("h").limit(sample).collect()
    inner = np.floor(np.quantile(unpack([bytes(r["exact"]) for r in some], dim), np.arange(1, cells) / cells, axis=0))
    low, high = np.array([r["low"] for r in ends]), np.array([r["high"] for r in ends])
    return np.vstack([low, np.clip(inner, low, high), high])


def approximation_file(table: DataFrame, edges: np.ndarray) -> DataFrame:
    """``(id, cells, exact, digest)``, written: the scans read ``cells`` only."""
    sent = table.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = sent.value
        dim = e.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = unpack(part.column(1).to_pylist(), dim)
                cells = np.empty(x.shape, np.uint8)
                for j in range(dim):
                    cells[:, j] = np.clip(np.searchsorted(e[:, j], x[:, j], side="right") - 1, 0, len(e) - 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in cells], pa.binary()), part.column(1), part.column(2)], names=["id", "cells", "exact", "digest"])

    made = write_table(table.select("id", "exact", "digest").mapInArrow(lambda batches: released(run(batches)), "id long, cells binary, exact binary, digest long"), "cells")
    sent.destroy()
    return made


class Chunk:
    """A chunk of queries of one dimension, with the file's edges."""

    def __init__(self, ids: list[int], vectors: list[bytes], edges: np.ndarray):
        self.ids = np.array(ids, np.int64)
        self.x = unpack(vectors, edges.shape[1])
        self.up, self.down = np.maximum(self.x, 0), np.minimum(self.x, 0)
        self.low, self.high = edges[:-1], edges[1:]
        with np.errstate(over="ignore"):  # more than any rounding of a bound
            self.slack = 8 * edges.shape[1] * 2.0**-53 * (np.abs(self.x) @ np.abs(edges).max(0))

    def block(self) -> int:
        return max(16, HELD // len(self.ids))

    def bounds(self, cells: pa.Array, upper: bool) -> np.ndarray:
        """Upper or lower bounds of all scores, (queries, rows)."""
        code = np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(len(cells), -1)
        at = np.arange(code.shape[1])
        low, high = self.low[code, at].T, self.high[code, at].T
        with np.errstate(over="ignore", invalid="ignore"):
            got = self.up @ high + self.down @ low + self.slack[:, None] if upper else self.up @ low + self.down @ high - self.slack[:, None]
        return np.where(np.isnan(got), np.inf if upper else -np.inf, got)


def scores_of(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products of integer vectors."""
    with np.errstate(over="ignore"):
        most = np.abs(rows).max() * np.abs(query).max() * len(query)
    if most < 2.0**53:
        return (rows @ query).astype(np.int64).tolist()
    own = list(map(int, query.tolist()))
    return [sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in rows.tolist()]


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row, the k largest."""
    return scores if scores.shape[1] <= k else np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def search_chunk(table: DataFrame, chunk: Chunk, k: int) -> DataFrame:
    """``(query_id, vec_id, score, times)``, written: every task's k best of each query."""
    dim = chunk.x.shape[1]
    context = table.sparkSession.sparkContext
    sent = context.broadcast(chunk)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        best = np.full((len(c.ids), 0), 0.0)
        for batch in batches:
            for lo in range(0, batch.num_rows, c.block()):
                part = batch.slice(lo, c.block())
                low = c.bounds(part.column(1), False)
                low[c.ids[:, None] == part.column(0).to_numpy()[None]] = -np.inf
                best = _top(np.hstack([best, low]), k)
        q, r = np.nonzero(np.isfinite(best)) if best.size else (np.empty(0, int), np.empty(0, int))
        yield pa.RecordBatch.from_arrays([pa.array(c.ids[q]), pa.array(best[q, r])], names=["query_id", "low"])

    lows = table.select("id", "cells").mapInArrow(lambda batches: released(floors(batches)), "query_id long, low double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("low"))
    # at most one number a query of the chunk
    floor = {r[0]: r[1] for r in lows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") == k).select("query_id", "low").collect()}
    sent_floor = context.broadcast(np.array([floor.get(i, -np.inf) for i in chunk.ids.tolist()]))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, least = sent.value, sent_floor.value
        for batch in batches:
            for lo in range(0, batch.num_rows, c.block()):
                part = batch.slice(lo, c.block())
                ids = part.column(0).to_numpy()
                reached = ((c.bounds(part.column(1), True) >= least[:, None]) & (c.ids[:, None] != ids[None])).any(0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[reached])], names=["id"])

    candidates = write_table(table.select("id", "cells").mapInArrow(lambda batches: released(named(batches)), "id long"), "candidates")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, least = sent.value, sent_floor.value
        found: list[list[list[int]]] = [[] for _ in c.ids]  # [-score, id, times], best first
        for batch in batches:
            for lo in range(0, batch.num_rows, c.block()):
                part = batch.slice(lo, c.block())
                ids, vectors = part.column(0).to_numpy(), part.column(2).to_pylist()
                top = c.bounds(part.column(1), True)
                for q in np.flatnonzero((top >= least[:, None]).any(1)).tolist():
                    rows = np.flatnonzero((top[q] >= least[q]) & (ids != c.ids[q]))
                    rows = rows[np.argsort(-top[q, rows], kind="stable")]
                    own = found[q]
                    for at in range(0, len(rows), 16):
                        if len(own) == k and -own[-1][0] > top[q, rows[at]]:
                            break  # no bound left reaches the kth score
                        some = rows[at : at + 16].tolist()
                        for i, n in zip(some, scores_of(unpack([vectors[i] for i in some], dim), c.x[q]), strict=True):
                            again = next((e for e in own if e[0] == -n and e[1] == ids[i]), None)
                            if again:
                                again[2] += 1
                            else:
                                own.append([-n, int(ids[i]), 1])
                        own.sort()
                        del own[k:]
        out = [(int(i), v, -n, times) for i, own in zip(c.ids.tolist(), found, strict=True) for n, v, times in own]
        if any(abs(r[2]) >= 2**63 for r in out):
            raise OverflowError("a score does not fit a long")
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["query_id", "vec_id", "score", "times"])

    # rows are dropped in front of Python by a bitmap of the candidates; one too many costs arithmetic only
    likely = may_hold(table, "id", candidates).where(MAY).select("id", "cells", "exact")
    part = write_table(likely.mapInArrow(lambda batches: released(exact(batches)), RESULT), "found")
    sent.destroy()
    sent_floor.destroy()
    return part


def exact_top_k(rows: DataFrame, is_query, k: int = K, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", queries: int = QUERIES, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for every row for which ``is_query(id column)`` holds."""
    table = exact_vectors(rows, scale, id_col, vec_col)
    kept = without_surplus_copies(table, k)
    # of a query id on several vectors, the first in order of bytes asks
    first = Window.partitionBy("id").orderBy("dim", "exact")
    asked = table.where(is_query(F.col("id"))).withColumn("rank", F.row_number().over(first)).where("rank = 1")
    asked = write_table(asked.select("id", "dim", "exact"), "queries")
    found = None
    for dim in [r[0] for r in asked.select("dim").distinct().collect()]:
        own = kept.where(F.col("dim") == dim)
        edges = edges_of(own, dim, cells, sample)
        file = approximation_file(own, edges)
        of_dim, last = asked.where(F.col("dim") == dim), None
        while True:  # chunk by chunk, in order of id; only one chunk is on the driver at a time
            got = (of_dim if last is None else of_dim.where(F.col("id") > last)).orderBy("id").limit(queries).collect()
            if not got:
                break
            part = search_chunk(file, Chunk([r["id"] for r in got], [bytes(r["exact"]) for r in got], edges), k)
            found = part if found is None else found.union(part)
            last = got[-1]["id"]
    if found is None:
        found = rows.sparkSession.createDataFrame([], RESULT)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
