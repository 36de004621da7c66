"""Walks over whole components of an undirected graph, in numpy.

A component's edges are sent to the tasks that walk it: as often as it has blocks of start vertices, which are as many as
its work asks for, so no table of vertex pairs is made on the way.  They are sent packed (see ``chunks``).  What bounds a
component is that one task holds its edges (two 4-byte numbers each, both ways); nothing is refused or left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.iterate import cut
from .meeting import squeezed, unsqueezed

#: Edges passed from all start vertices of a block, about.
WORK = 1e8
#: Blocks that a core gets at most, over all components.
SHARE = 8
#: A component of at most so many vertices is walked by matrix products, where at least this share of its pairs are edges.
DENSE, FILLED = 4096, 0.05
#: Edges that are packed into one row.
CHUNK = 1 << 20


def forest(edges: DataFrame) -> DataFrame:
    """Edges ``(source, target)`` that connect what ``edges`` connect: the tasks' own components, each as a star."""
    if {dict(edges.dtypes)[c] for c in ("source", "target")} - {"bigint", "int", "smallint", "tinyint"}:
        return edges.select("source", "target")

    def stars(held):
        source, target = (np.concatenate(h) for h in zip(*held, strict=True))
        ids, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
        a, b, root = ends[: len(source)], ends[len(source) :], np.arange(len(ids))
        while len(a):
            low = np.minimum(root[a], root[b])
            for x in (root[a], root[b]):  # roots are hooked to the smallest they meet
                np.minimum.at(root, x, low)
            while (root[root] != root).any():
                root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["source", "target"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += len(batch)
            if n >= CHUNK:
                yield from stars(held)
                held, n = [], 0
        if n:
            yield from stars(held)

    bare = edges.select("source", "target").where("source is not null and target is not null")
    kinds = dict(edges.dtypes)
    wide = bare.select(*[F.col(c).cast("long").alias(c) for c in bare.columns]).mapInArrow(run, "source long, target long")
    return wide.select(*[F.col(c).cast(kinds[c]).alias(c) for c in wide.columns])


class Graph:
    """One component: ``ids`` ascending, and for vertex i its neighbours ``to[at[i] : at[i + 1]]``, ascending."""

    def __init__(self, source: np.ndarray, target: np.ndarray):
        self.ids, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
        a, b = ends[: len(source)], ends[len(source) :]
        self.n = len(self.ids)
        self.at, self.to = self.lists(np.concatenate([a, b]), np.concatenate([b, a]))

    def lists(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(x.astype(np.int64) * self.n + y)
        return np.concatenate([[0], np.cumsum(np.bincount(x, minlength=self.n))]), y[order].astype(np.int32)

    def levels(self, s: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level from ``s``: its vertices, their places in the level repeated for each neighbour, the neighbours,
        and the hops known by then (-1: none yet; the array is one and the same)."""
        dist = np.full(self.n, -1, np.int32)
        dist[s] = 0
        front, d = np.array([s]), 0
        while len(front):
            lens = self.at[front + 1] - self.at[front]
            begin = np.cumsum(lens) - lens
            near = self.to[np.arange(lens.sum()) + np.repeat(self.at[front] - begin, lens)]
            yield front, np.repeat(np.arange(len(front)), lens), near, dist
            new = near[dist[near] < 0]
            d += 1
            dist[new] = d
            front = np.unique(new) if len(new) * 16 < self.n else np.flatnonzero(np.bincount(new, minlength=self.n))

    def sums(self, s: int) -> tuple[int, int, int, int, float]:
        """Of a vertex: degree, triangles, others reached, sum of hops to them, sum of 1 / hops."""
        triangles = reached = hops = 0
        harmonic = 0.0
        for d, (front, _, near, dist) in enumerate(self.levels(s)):
            if d == 1:
                triangles = int(np.count_nonzero(dist[near] == 1)) // 2
            if d:
                reached, hops, harmonic = reached + len(front), hops + d * len(front), harmonic + len(front) / d
        return int(self.at[s + 1] - self.at[s]), triangles, reached, hops, harmonic

    def dense(self) -> bool:
        return self.n <= DENSE and len(self.to) >= FILLED * self.n * self.n

    def fronts(self, sources: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The matrix of edges, and level by level the number of shortest paths to each vertex (a row) from each source."""
        edge = np.zeros((self.n, self.n))
        edge[np.repeat(np.arange(self.n), np.diff(self.at)), self.to] = 1.0
        front = np.zeros((self.n, len(sources)))
        front[sources, np.arange(len(sources))] = 1.0
        seen, found = front > 0, []
        while front.any():
            found.append(front)
            front = edge @ front
            front[seen] = 0.0
            seen |= front > 0
        return edge, found

    def all_sums(self, sources: np.ndarray) -> list[np.ndarray]:
        """``sums`` of many vertices, as columns."""
        if not self.dense():
            return list(map(np.array, zip(*map(self.sums, sources), strict=True)))
        cols = []
        for lo in range(0, len(sources), 512):
            some = sources[lo : lo + 512]
            edge, found = self.fronts(some)
            near = edge[:, some]
            triangles = np.rint((near * (edge @ near)).sum(0) / 2).astype(np.int64)
            reached, hops, harmonic = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), np.zeros(len(some))
            for d, front in enumerate(found[1:], 1):
                many = np.count_nonzero(front, axis=0)
                reached, hops, harmonic = reached + many, hops + d * many, harmonic + many / d
            cols.append([self.at[some + 1] - self.at[some], triangles, reached, hops, harmonic])
        return [np.concatenate(c) for c in zip(*cols, strict=True)]

    def all_dependencies(self, sources: np.ndarray) -> np.ndarray:
        """``dependencies`` of many sources, added up."""
        total = np.zeros(self.n)
        if not self.dense():
            for s in sources:
                total += self.dependencies(s)
            return total
        for lo in range(0, len(sources), 512):
            edge, found = self.fronts(sources[lo : lo + 512])
            share = np.zeros_like(found[0])
            for before, front in zip(found[-2::-1], found[:0:-1], strict=True):
                part = np.divide(1.0 + share, front, out=np.zeros_like(front), where=front > 0)
                share += before * (edge @ part)
            share[found[0] > 0] = 0.0  # not of the sources themselves
            total += share.sum(1)
        return total

    def dependencies(self, s: int) -> np.ndarray:
        """Brandes' sums of one source: for each other vertex, the shares of the shortest paths from ``s`` through it."""
        paths, share, steps = np.zeros(self.n), np.zeros(self.n), []
        paths[s] = 1.0
        for front, who, near, dist in self.levels(s):
            on = dist[near] < 0
            who, near = who[on], near[on]
            if len(near) * 16 < self.n:
                np.add.at(paths, near, paths[front][who])
            else:
                paths += np.bincount(near, paths[front][who], self.n)
            steps.append((front, who, near))
        for front, who, near in reversed(steps):
            share[front] += paths[front] * np.bincount(who, (1 + share[near]) / paths[near], len(front))
        share[s] = 0.0
        return share

    def cliques(self, size: int, sources: np.ndarray, most: int = 4096) -> Iterator[np.ndarray]:
        """Arrays of ``size`` columns, ascending in each row: the cliques led by ``sources``.  A clique is led by its first
        vertex; first is the smaller id, or the one of smaller degree where that leaves a vertex too many to lead."""
        deg = np.diff(self.at)
        rank = np.arange(self.n)
        x = np.repeat(rank, deg)
        if np.bincount(x[x < self.to], minlength=self.n).max(initial=0) > most:
            rank = np.empty(self.n, np.int64)
            rank[np.lexsort((np.arange(self.n), deg))] = np.arange(self.n)
        sort = bool((rank[1:] < rank[:-1]).any())
        back = np.argsort(rank)
        up = rank[x] < rank[self.to]
        at, to = self.lists(rank[x[up]], rank[self.to[up]])  # by rank from here on
        place = np.full(self.n, -1, np.int64)
        held, heads, tails, rows = 0, [], [], []

        def whole() -> np.ndarray:
            out = np.empty((sum(rows), size), np.int64)
            many = np.array(rows)
            for i in range(len(heads[0])):
                out[:, i] = np.repeat([h[i] for h in heads], many)
            out[:, len(heads[0]) :] = np.concatenate(tails)
            out = back[out]
            return np.sort(out, 1) if sort else out

        def grown(head: tuple, own: np.ndarray, some: np.ndarray, joined: np.ndarray, more: int):
            if more == 1:
                yield head, own[some][:, None]
            elif more == 2:
                i, j = np.nonzero(joined[np.ix_(some, some)])
                yield head, np.stack([own[some[i]], own[some[j]]], 1)
            else:
                for i in some:
                    rest = some[joined[i, some]]
                    if len(rest) >= more - 1:
                        yield from grown((*head, own[i]), own, rest, joined, more - 1)

        for s in rank[sources]:
            own = to[at[s] : at[s + 1]].astype(np.int64)
            if len(own) < size - 1:
                continue
            place[own] = np.arange(len(own))
            lens = at[own + 1] - at[own]
            begin = np.cumsum(lens) - lens
            col = place[to[np.arange(lens.sum()) + np.repeat(at[own] - begin, lens)]]
            joined = np.zeros((len(own), len(own)), bool)
            joined[np.repeat(np.arange(len(own)), lens)[col >= 0], col[col >= 0]] = True
            place[own] = -1
            for head, tail in grown((s,), own, np.arange(len(own)), joined, size - 1):
                if len(tail):
                    heads.append(head), tails.append(tail), rows.append(len(tail))
                    held += len(tail)
                    if held >= 100_000:
                        yield whole()
                        held, heads, tails, rows = 0, [], [], []
        if held:
            yield whole()


def chunks(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(component, m, ids, codes)``: the edges of a component, distinct and without loops, in rows of up to ``CHUNK``; an
    edge is a code over the row's ids, and codes are packed as differences."""
    kind = edges.schema["source"].dataType.simpleString()
    name = labels.schema["component"].dataType.simpleString()
    one = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).where("source <> target")
    placed = one.join(labels.select(F.col("v").alias("source"), "component"), "source").select("component", "source", "target")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(parts, "component").sortWithinPartitions("component", "source", "target")  # equal edges are neighbours

    def run(batches):
        key, held, n, last, kinds = None, [], 0, None, []

        def row():
            nonlocal last
            source, target = (np.concatenate(h) for h in zip(*held, strict=True))
            new = np.ones(len(source), bool)
            new[1:] = (source[1:] != source[:-1]) | (target[1:] != target[:-1])
            new[0] = last != (key, source[0], target[0])
            last = key, source[-1], target[-1]
            source, target = source[new], target[new]
            if len(source):
                ids, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
                codes = squeezed(np.sort(ends[: len(source)] * len(ids) + ends[len(source) :]))
                yield pa.RecordBatch.from_arrays([pa.array([key], kinds[0]), pa.array([len(source)], pa.int64()), pa.array([ids.tolist()], pa.list_(kinds[1])), pa.array([codes], pa.binary())], ["component", "m", "ids", "codes"])

        for batch in batches:
            kinds = batch.schema.types
            comp, source, target = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(comp):
                continue
            ends = np.flatnonzero(comp[1:] != comp[:-1]) + 1
            for lo, hi in zip([0, *ends], [*ends, len(comp)], strict=True):
                if held and (comp[lo] != key or n >= CHUNK):
                    yield from row()
                    held, n = [], 0
                key, n = comp[lo], n + hi - lo
                held.append((source[lo:hi].copy(), target[lo:hi].copy()))
        if held:
            yield from row()

    return dealt.mapInArrow(run, f"component {name}, m long, ids array<{kind}>, codes binary")


def by_component(edges: DataFrame, labels: DataFrame, work: Callable[[Graph, np.ndarray], Iterator[list]], schema: str, passes: float = 1.0) -> DataFrame:
    """Rows of ``work(graph, sources)`` (lists of columns) over all components, each vertex a source once.

    ``labels(v, component)`` as ``network.components`` gives them; ``passes`` makes blocks smaller where a source does more
    than to look at each edge once.
    """
    placed = cut(chunks(edges, labels))
    vertices = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    size = placed.groupBy("component").agg(F.sum("m").alias("m")).join(vertices, "component")
    size = cut(size.select("component", "n", (F.col("n") * 2.0 * F.col("m") * passes).alias("work")))
    # where there are blocks enough for all cores, they are larger instead of more: each block gets its component's edges
    whole = size.agg(F.sum("work")).first()[0] or 0.0
    each = max(WORK, whole / (SHARE * edges.sparkSession.sparkContext.defaultParallelism))
    blocks = cut(size.select("component", F.least("n", F.ceil(F.col("work") / each)).cast("int").alias("blocks")))
    tasks = int(blocks.agg(F.sum("blocks")).first()[0] or 1)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            _, block, parts = key
            source, target = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            graph = Graph(source, target)
            for cols in work(graph, np.arange(block, graph.n, parts)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        for batch in batches:
            for comp, block, parts, ids, codes in zip(*batch.columns, strict=True):
                now = (comp.as_py(), block.as_py(), parts.as_py())
                if key is not None and now != key:
                    yield from done()
                    held = []
                key = now
                ids, codes = ids.values.to_numpy(zero_copy_only=False), unsqueezed(codes.as_py())
                held.append((ids[codes // len(ids)], ids[codes % len(ids)]))
        if held:
            yield from done()

    sent = placed.join(blocks, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", "ids", "codes")
    dealt = sent.repartition(min(max(tasks, 1), 2000), "component", "block").sortWithinPartitions("component", "block")
    return dealt.mapInArrow(run, schema)
