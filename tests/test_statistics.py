import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import abundance, community, evaluation, models, network
from cladeflow.streaming import windows


def graph(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "source long, target long, weight double")


@pytest.fixture(scope="module")
def web(spark):
    r = random.Random(4)
    edges = [(a, b, r.choice([1, 2, -1])) for a, b in itertools.combinations(range(14), 2) if r.random() < 0.3] + [(20, 21, 1), (21, 22, 1)]
    return edges, graph(spark, edges)


def neighbours(edges):
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def paths(near):
    out = {}
    for s in near:
        dist, queue = {s: 0}, [s]
        for v in queue:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        out |= {(s, t): d for t, d in dist.items() if t != s}
    return out


def test_graph_measures(spark, web):
    edges, df = web
    near = neighbours(edges)
    dist = paths(near)
    assert {(r.a, r.b): r.d for r in network.distances(df).collect()} == dist
    comp = {r.v: r.component for r in network.components(df).collect()}
    assert comp == {v: min([v, *(b for a, b in dist if a == v)]) for v in near}
    tri = {(r.a, r.b, r.c) for r in network.triangles(df).collect()}
    assert tri == {t for t in itertools.combinations(sorted(near), 3) if all(y in near[x] for x, y in itertools.combinations(t, 2))}
    four = {tuple(r.members) for r in network.cliques(df, 4).collect()}
    assert four == {t for t in itertools.combinations(sorted(near), 4) if all(y in near[x] for x, y in itertools.combinations(t, 2))}
    count = {}
    for s, t in itertools.combinations(near, 2):
        if (s, t) in dist:
            ways = [[s]]
            for _ in range(dist[s, t]):
                ways = [[*w, x] for w in ways for x in near[w[-1]]]
            short = [w for w in ways if w[-1] == t]
            for w in short:
                for v in w[1:-1]:
                    count[v] = count.get(v, 0) + 1 / len(short)
    got = {r.v: r.betweenness for r in network.betweenness(df).collect()}
    pairs = (len(near) - 1) * (len(near) - 2) / 2
    assert all(abs(got[v] * pairs - count.get(v, 0)) < 1e-9 for v in near)


def test_spanning_forest_and_communities(spark, web):
    edges, _ = web
    weighted = [(a, b, (a * 7 + b * 13) % 11 + 1) for a, b, _ in edges]
    forest = [(r.source, r.target, r.n) for r in network.spanning_forest(spark.createDataFrame(weighted, "source long, target long, n long")).collect()]
    parent = {v: v for v in neighbours(edges)}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    best = 0
    for a, b, n in sorted(weighted, key=lambda e: -e[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            best += n
    assert sum(n for *_, n in forest) == best and len(forest) == len(parent) - 2
    two = [(a, b, 1) for a, b in itertools.combinations(range(5), 2)] + [(a, b, 1) for a, b in itertools.combinations(range(5, 10), 2)] + [(4, 5, 1)]
    label = network.label_propagation(graph(spark, two))
    groups = {r.v: r.community for r in label.collect()}
    assert len({groups[v] for v in range(5)}) == 1 and len({groups[v] for v in range(5, 10)}) == 1
    assert network.modularity(graph(spark, two), label).first()[0] > 0.3 or len(set(groups.values())) == 1


def test_tips_and_trimming(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("c", "d", 5), ("b", "x", 1), ("d", "e", 5), ("e", "f", 5)], "src string, dst string, n long")
    left = {(r.src, r.dst) for r in network.tips_removed(edges, 3).collect()}
    assert ("b", "x") not in left and ("b", "c") in left and ("e", "f") in left
    vertices = spark.createDataFrame([("a", 1), ("b", 9), ("c", 9), ("z", 9)], "v string, n long")
    kept, rest = network.trimmed(vertices, edges, 5)
    assert {r.v for r in kept.collect()} == {"b", "c"} and rest.count() == 1
    bridge = spark.createDataFrame([("b", "c", 5)], "src string, dst string, n long")
    assert {(r.src, r.dst) for r in network.bridged(edges, bridge).collect()} >= {("a", "d")}


def test_em_matches_a_plain_loop(spark):
    r = random.Random(2)
    hits = [(i, g) for i in range(200) for g in r.sample(range(5), r.randint(1, 3))]
    a = np.zeros((200, 5))
    for i, g in hits:
        a[i, g] += 1
    pi = np.full(5, 0.2)
    for _ in range(7):
        q = a * pi
        pi = (q / q.sum(1, keepdims=True)).sum(0) / 200
    df = spark.createDataFrame(hits, "read long, genome long")
    got = {x.genome: x.pi for x in abundance.expectation_maximisation(df, 7, 0.0).collect()}
    assert all(abs(got[g] - pi[g]) < 1e-12 for g in range(5))
    settled = abundance.expectation_maximisation(df, 400, 1e-6)
    assert abs(sum(x.pi for x in settled.collect()) - 1) < 1e-9
    assert abundance.assignments(df, settled).count() == 200


def test_community(spark):
    r = random.Random(5)
    rows = [(s % 2, f"s{s}", f"t{t}", float(r.choice([0, 1, 5, 9]))) for s in range(6) for t in range(5)]
    df = spark.createDataFrame(rows, "cohort int, sample string, taxon string, value double")
    x = np.array([[v for _, s, _, v in rows if s == f"s{i}"] for i in range(6)])
    for p in community.bray_curtis(df).collect():
        a, b = x[int(p.a[1])], x[int(p.b[1])]
        assert abs(p.distance - abs(a - b).sum() / (a + b).sum()) < 1e-12
    coords = community.pcoa(community.bray_curtis(df), 5)
    assert len(coords) == 6
    tests = community.two_group_tests(df.select(F.col("taxon").alias("feature"), F.col("cohort").alias("grp"), "value")).collect()
    assert all(0 <= t.p <= 1.0000001 for t in tests if t.p == t.p)
    q = community.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", 0.03)], "feature string, p double"))
    assert {v.feature: round(v.q, 6) for v in q.collect()} == {"a": 0.05, "b": 0.05, "c": 0.05, "d": 0.5, "e": 0.05}


def test_quantiles_and_n50(spark):
    r = random.Random(6)
    values = [r.randint(0, 50) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    s = sorted(values)
    got = {x.fraction: x.v for x in evaluation.index_quantiles(df, "v", [0.001, 0.5, 1.0]).collect()}
    assert got == {0.001: s[0], 0.5: s[49], 1.0: s[100]}
    assert evaluation.upper_median(df, "v").first().median == s[50]
    n = evaluation.n50(spark.createDataFrame([(1, 10), (1, 6), (1, 5), (1, 5)], "g long, length long"), "g").first()
    assert (n.n50, n.total) == (6, 26)


def test_sparse_models_recover_structure(spark):
    r = np.random.default_rng(1)
    omega = np.eye(6)
    omega[0, 1] = omega[1, 0] = omega[3, 4] = omega[4, 3] = -0.45
    x = r.multivariate_normal(np.zeros(6), np.linalg.inv(omega), 400)
    for method in ("glasso", "tiger"):
        _, found = models.select_precision(x, method)
        assert abs(found[0, 1]) > 0.1 and abs(found[3, 4]) > 0.1
    edges = {(e.source, e.target) for e in models.bootstrap_network(spark, x, 0.15, 8, 0.8).collect()}
    assert {(0, 1), (3, 4)} <= edges and len(edges) <= 4
    assert 0 < models.stars(spark, x, 8, 0.05, 6) < 1
    assert np.linalg.cond(models.thresholded(np.linalg.inv(np.cov(x.T)), 400)) < 1e6


def test_mixtures_rise_and_part_groups(spark):
    r = np.random.default_rng(3)
    x = np.r_[r.normal(0, 1, (60, 3)), r.normal(6, 1, (60, 3))]
    bound, resp, *_, bounds = models.mix_ggm(x, 2, 1)
    assert all(b > a for a, b in itertools.pairwise(bounds))
    assert len(set(resp.argmax(1)[:60])) == 1 and resp.argmax(1)[0] != resp.argmax(1)[-1]
    y = r.poisson(np.exp(np.r_[r.normal(1, 0.3, (40, 3)), r.normal(4, 0.3, (40, 3))]))
    _, resp, *_, bounds = models.mix_mpln(y.astype(float), 2, 1, 15)
    assert all(b > a for a, b in itertools.pairwise(bounds)) and len(set(resp.argmax(1)[:40])) == 1
    best = models.best_start(models.restarts(spark, x, 2, 3, rounds=10)).first()
    assert len(best.assignment) == 120
    assert abs(-np.exp(models.root_a(2.0, 5.0)) - 2 * models.root_a(2.0, 5.0) + 5) < 0.02
    z = models.root_b(2.0, 1.0)
    assert abs(-np.exp(z / 2) + 2 / z + 1) < 0.02


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 3).alias("kind"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    live = windows.run_to_end(windows.windowed_counts(stream, "1 hour", "1 hour", "kind"), "live")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(live) == key(windows.windowed_counts(rows, "1 hour", "1 hour", "kind"))
    assert windows.sessions(rows, "10 minutes", "1 hour", "kind").count() == 3
