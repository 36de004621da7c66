import math
import random

import numpy as np
import pytest

from cladeflow.llm import closure, common, embedding_dedup, exact_topk, near_dedup


def union(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(i) for i in range(n)]


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def near_texts(seed, groups=12, copies=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = [None, "", "  \n", "one", "One", "two words", "a b c", "A\tB\x0bC"]
    for _ in range(groups):
        base = [word() for _ in range(r.randint(20, 150))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                text[r.randrange(len(text))] = word()
            out.append(" ".join(text))
    return out + out[20:24]


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    real = closure.closure
    monkeypatch.setattr(near_dedup, "closure", lambda members, labeler: real(members, labeler, block))
    texts = near_texts(4)
    sets = [shingles(t, 3) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = union(len(sets), links)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id int, id string").repartition(3)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in got)


def test_near_duplicates_odd_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (9, text.upper()), (5, None)], "doc_id long, text string")
    rows = sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=str)
    assert sorted(rows, key=str) == sorted([(3, 4, 3, True), (3, 4, 3, True), (None, 4, None, True), (9, 4, 3, False), (5, 0, 5, True)], key=str)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    both = near_dedup.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(both[0], both[1]) == both[2]).all()
    x = np.r_[a[:450], b[:50]]
    reg = near_dedup.sketches([a, x])
    ask = lambda at: bool(near_dedup.likely((reg[0] > reg[1]).sum(), (reg[0] < reg[1]).sum(), 500.0, 500.0, at))
    assert ask(0.6) and not ask(0.97)


def vectors(seed):
    r = np.random.default_rng(seed)
    base = r.standard_normal((30, 16))
    rows = [base[i % 30] + r.standard_normal(16) * r.choice([0.02, 0.1]) for i in range(240)]
    return np.array(rows, np.float32)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors_match_brute_force(spark, block):
    x = vectors(2)
    label = [i % 3 if i % 11 else None for i in range(len(x))]
    rows = [(i, [float(v) for v in x[i]], label[i], 0) for i in range(len(x))]
    rows += [(900, None, 1, 0), (901, [0.0] * 16, 1, 0), (902, [None] * 16, 1, 0), (903, [float("nan")] * 16, 1, 0), (904, [], 1, 0), (905, rows[1][1], label[1], 0), (905, rows[1][1], label[1], 0), (None, rows[1][1], label[1], 0), (906, [2.0, 1.0], 1, 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, unit int").repartition(3), block=block).collect()}
    full = [(i, np.array(v, np.float64), lab) for i, v, lab, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    full = list({i: (i, v, lab) for i, v, lab in full}.values())
    near = lambda p, q: p[0] != q[0] and p[2] is not None and p[2] == q[2] and len(p[1]) == len(q[1]) and p[1] @ q[1] / np.sqrt((p[1] @ p[1]) * (q[1] @ q[1])) >= 0.98
    pairs = [(i, j) for i in range(len(full)) for j in range(len(full)) if near(full[i], full[j])]
    root = union(len(full), pairs)
    degree = {full[i][0]: sum(a == i for a, _ in pairs) for i in range(len(full))}
    comp = {full[i][0]: min(full[j][0] for j in range(len(full)) if root[j] == root[i]) for i in range(len(full))}
    assert sum(degree.values()) > 200
    for i, r in got.items():
        if i is not None:
            assert (r.n_links, r.component_id, r.kept) == (degree.get(i, 0), comp.get(i, i), comp.get(i, i) == i)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)


@pytest.mark.parametrize("chunk", [8192, 3])
def test_exact_top_k_matches_brute_force(spark, chunk):
    x = vectors(5)[:120]
    rows = [(i, [float(v) for v in x[i // 2]], 1) for i in range(len(x))]
    rows += [(500, None, 1), (550, [None] * 16, 1), (600, [float("inf")] * 16, 1), (None, rows[0][1], 1), (700, [1.0, 2.0], 1), (51, rows[3][1], 1)]
    rows += [(800 + i, rows[3][1], 1) for i in range(30)] + [(20, rows[20][1], 1)] * 7  # copies, and a repeated row
    check_top_k(spark, rows, queries=chunk)
    check_top_k(spark, rows, queries=chunk, cells=4, sample=10)
    df = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, score int")
    assert exact_topk.exact_top_k(df.limit(0), lambda i: i % 10 == 0).count() == 0


def check_top_k(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_topk.exact_top_k(df, lambda i: i % 10 == 0, **how).collect()}
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = {}
    for i, v in whole:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i and len(w) == len(v))[:5]
            want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want


def test_large_components_have_exact_scores(spark):
    r = random.Random(4)
    rows = [(0, [1.0, 1.0], 1), (1, [2.0, 2.0], 1), (2, [9e6, 9e6], 1), (3, [-9e6, -9e6], 1), (10, [-1.0, 3.0], 1)]
    check_top_k(spark, rows)
    # products beyond 2^53 that differ in their last digits, and components from 1e-3 to 1e7 side by side
    rows = [(i, [r.choice([-1, 1]) * 10 ** r.uniform(-3, 7) for _ in range(3)], 1) for i in range(100)]
    rows += [(200 + i, [7e6 + i / 256, 6.9e6, 1.0], 1) for i in range(40)]
    check_top_k(spark, rows)
    check_top_k(spark, rows, cells=3, sample=5)
    with pytest.raises(Exception, match="does not fit a long"):
        check_top_k(spark, [(0, [1e9, 1e9], 1), (1, [1e9, 1e9], 1)])


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), (None, 3), (1, 2), (2, 10), (3, 11)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {3: 3, 4: 3, 5: 3, 11: 3, 8: 8, 9: 8, 1: 1, 2: 1, 10: 1}


def test_rows_are_split_by_ids(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(50)] + [(None, "x")], "doc_id long, bitmap string")
    ids = spark.createDataFrame([(i,) for i in range(0, 50, 7)], "id long")
    assert sorted(r.doc_id for r in common.only(rows, "doc_id", ids).collect()) == list(range(0, 50, 7))
    left = [r.doc_id for r in common.without(rows, "doc_id", ids).collect()]
    assert len(left) == 51 - 8 and None in left


def windows(n, size, apart, seed):
    """n pairs of texts, each a window of distinct words on one line of words; ids 2i and 2i + 1."""
    r = random.Random(seed)
    lines = [[f"{r.getrandbits(40):x}" for _ in range(size + apart)] for _ in range(n)]
    return [(2 * i + k, " ".join(line[k * apart : k * apart + size])) for i, line in enumerate(lines) for k in (0, 1)]


def test_pairs_of_a_bucket_are_checked_whatever_their_sketches_say(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "sketch_labeler", lambda at: lambda payload, size: np.arange(len(payload)))
    df = spark.createDataFrame(windows(20, 94, 4, 1), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def test_links_at_the_threshold_are_found(spark):
    # 90 shingles of five words each, 80 common of 100: a similarity of 0.80
    df = spark.createDataFrame(windows(1500, 94, 10, 2), "doc_id long, text string").repartition(4)
    assert near_dedup.near_duplicates(df).where("component_id <> doc_id - doc_id % 2").count() == 0
