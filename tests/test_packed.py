"""What is sent packed: edges of components, pairs that meet."""

import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cladeflow.operators import meeting, network, walks


def test_squeezed_numbers_come_back():
    some = np.random.default_rng(0).integers(0, 1 << 40, 1000)
    for x in (np.array([5, -3, 2**62, -(2**63), 2**63 - 1, 0]), some, np.sort(some), np.empty(0, np.int64)):
        assert (meeting.unsqueezed(meeting.squeezed(x)) == x).all()
    assert len(meeting.squeezed(np.arange(10_000))) < 200


def test_meetings_by_hand(spark, monkeypatch):
    monkeypatch.setattr(meeting, "ROWS", 50)
    rng = np.random.default_rng(1)
    rows = [(int(g), int(m)) for g, m in zip(rng.integers(-9, 9, 300), rng.integers(-20, 20, 300), strict=True)]
    df = spark.createDataFrame([*rows, *rows[:20], (None, 1), (1, None), (None, None)], "g long, m int")
    want = Counter()
    for g in {g for g, _ in rows}:
        want.update(itertools.combinations(sorted({m for h, m in rows if h == g}), 2))
    found = meeting.meetings(df, "g", "m")
    assert dict(found.dtypes) == {"source": "int", "target": "int", "n": "bigint"}
    assert sorted((r.source, r.target, r.n) for r in found.collect()) == sorted((*p, n) for p, n in want.items())
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert meeting.meetings(df.limit(0), "g", "m").count() == 0


def test_pairs_of_in_slices():
    group, member = np.array([1, 1, 1, 2, 3, 3]), np.array([4, 5, 6, 1, 2, 9])
    want = [(4, 5), (4, 6), (5, 6), (2, 9)]
    for most in (1, 2, 100):
        assert [p for a, b in meeting.pairs_of(group, member, most) for p in zip(a.tolist(), b.tolist(), strict=True)] == want


def test_dense_components_by_products(monkeypatch):
    rng = np.random.default_rng(2)
    for n, m in ((60, 300), (30, 60), (200, 6000)):
        s, t = rng.integers(0, n, m), rng.integers(0, n, m)
        codes = np.unique(s[s < t] * n + t[s < t])
        graph = walks.Graph(codes // n, codes % n)
        some = np.arange(0, graph.n, 2)
        monkeypatch.setattr(walks, "FILLED", 2.0)
        sums, shares = graph.all_sums(some), graph.all_dependencies(some)
        monkeypatch.setattr(walks, "FILLED", 0.0)
        assert all((a == b).all() for a, b in zip(sums, graph.all_sums(some), strict=True))
        assert np.allclose(shares, graph.all_dependencies(some), atol=1e-9)


def test_components_are_sent_packed_and_seldom(spark, monkeypatch):
    monkeypatch.setattr(walks, "CHUNK", 1000)
    edges = list(itertools.combinations(range(100), 2))
    twice = spark.createDataFrame([*edges, *[(b, a) for a, b in edges[:50]], (3, 3), (200, 201)], "source long, target long")
    labels = network.components(twice)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "500")
    try:
        rows = walks.chunks(twice, labels).collect()
    finally:
        spark.conf.unset(key)
    assert sum(r.m for r in rows) == len(edges) + 1 and len(rows) > 4
    # under a byte and a half for an edge and its share of ids
    assert sum(len(r.codes) for r in rows) < 1.5 * len(edges)
    monkeypatch.setattr(walks, "WORK", 1.0)
    found = walks.by_component(twice, labels, lambda graph, sources: iter([[graph.ids[sources], np.full(len(sources), len(graph.to))]]), "v long, ends long").collect()
    assert {r.v: r.ends for r in found} == {v: 2 * len(edges) for v in range(100)} | {200: 2, 201: 2}
    sent = walks.by_component(twice, labels, lambda graph, sources: iter([[graph.ids[:1]]]), "v long")
    assert sent.count() <= 2 + walks.SHARE * spark.sparkContext.defaultParallelism  # before: a block for each vertex


def test_components_from_forests(spark, monkeypatch):
    monkeypatch.setattr(walks, "CHUNK", 20)
    edges = [(i, i + 1) for i in range(0, 40)] + list(itertools.combinations(range(50, 70), 2)) + [(80, 80)]
    df = spark.createDataFrame(edges, "source long, target long")
    assert walks.forest(df).count() < len(edges)
    assert {r.v: r.component for r in network.components(df).collect()} == {v: 0 for v in range(41)} | {v: 50 for v in range(50, 70)} | {80: 80}
    words = df.select(*[F.format_string("%03d", c).alias(c) for c in df.columns])
    assert {r.v: r.component for r in network.components(words).collect()}["069"] == "050"
