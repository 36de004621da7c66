"""Operators against numbers worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cladeflow.functions import register, scoring
from cladeflow.operators import abundance, community, evaluation, kmers, network, suffixes


def test_zero_rules_of_macro_averages(spark):
    # (truth, tp, predicted): nothing true but predicted, true but nothing predicted, neither, ordinary
    rows = [(0, 0, 5, "a"), (4, 0, 0, "b"), (0, 0, 0, "c"), (4, 2, 8, "d")]
    df = spark.createDataFrame([(1, *r) for r in rows], "e int, truth int, tp int, predicted int, gene string")
    (got,) = evaluation.macro_strict(df, "e").collect()
    assert got.sensitivity == pytest.approx((1 + 0 + 1 + 0.5) / 4) and got.precision == pytest.approx((0 + 1 + 1 + 0.25) / 4)


def test_shares_of_edges_and_taxa_add_up(spark):
    edges = [("x", 1, 2), ("x", 1, 3), ("x", 2, 3), ("y", 1, 2), ("y", 4, 5), ("z", 1, 2), ("z", 1, 3), ("z", 7, 8)]
    got = {r.network: (r.edges, r.unique, r.shared) for r in network.edge_shares(spark.createDataFrame(edges, "network string, source int, target int")).collect()}
    assert got["x"] == (3, pytest.approx(1 / 3), pytest.approx(2 / 3)) and got["y"] == (2, 0.5, 0.5)
    taxa = [("p", "a", 1.0), ("p", "b", 1.0), ("p", "c", 1.0), ("q", "a", 1.0), ("q", "b", 0.0), ("r", "c", 2.0), ("r", "a", 1.0)]
    got = {r.cohort: (r.taxa, r.unique, r.shared) for r in community.exclusive(spark.createDataFrame(taxa, "cohort string, taxon string, value double")).collect()}
    assert got == {"p": (3, 1, 2), "q": (1, 0, 1), "r": (2, 0, 2)}


def test_weights_are_pooled_and_betweenness_is_a_share(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 3.0), (1, 4, 5.0), (4, 5, -2.0)], "source int, target int, weight double")
    got = {r.listed: (r.degree, r.weight) for r in network.listed_degree(edges, spark.createDataFrame([(1,), (5,)], "v int")).collect()}
    # 1 has 1, 3 and 5, and 5 has -2; 2, 3 and 4 have 1, 3, and 5 with -2
    assert got[True] == (2.0, pytest.approx(7 / 4)) and got[False] == (pytest.approx(4 / 3), pytest.approx(7 / 4))
    got = {r.v: r.betweenness for r in network.betweenness(edges).collect()}
    assert got == {1: pytest.approx(5 / 6), 2: 0, 3: 0, 4: pytest.approx(3 / 6), 5: 0}
    got = {r.v: r.centrality for r in network.degree_centrality(edges).collect()}
    assert got == {1: 0.75, 2: 0.25, 3: 0.25, 4: 0.5, 5: 0.25}


def test_leaders_count_edges_inside_their_module(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 10), (3, 11), (1, 12), (10, 11)], "source int, target int")
    parts = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (10, 1), (11, 1), (12, 1), (20, 2), (21, 2)], "v int, community int")
    values = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, 2.0), (10, 1.0), (11, 4.0)], "v int, value double")
    assert {tuple(r) for r in network.module_leaders(edges, parts, values).collect()} == {(0, 2, 2), (1, 11, 1)}


def test_ambiguity_codes():
    m = scoring.blosum62()
    assert [m[x] for x in ("BN", "DB", "BK", "BG", "BB", "ZQ", "EZ", "ZC", "JI", "LJ", "JJ", "BZ", "JZ", "XA", "*A", "**")] == [4, 4, 0, -1, 4, 4, 4, -3, 3, 3, 3, 0, -3, -1, -4, 1]
    assert all(m[a + b] == m[b + a] for a in "ARNDCQEGHILKMFPSTWYVBJZX*" for b in "ARNDCQEGHILKMFPSTWYVBJZX*")


def test_suffix_order_matches_sorting(spark):
    r = random.Random(6)
    seqs = [(i, "".join(r.choice("AC") for _ in range(n))) for i, n in enumerate([1, 5, 5, 30, 64, 70, 0])] + [(9, "ACACAC"), (8, "ACACAC")]
    df = spark.createDataFrame(seqs, "rid long, seq string")
    every = sorted((s[p:], i, p + 1) for i, s in seqs for p in range(len(s)))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
    order = suffixes.common_prefixes(suffixes.suffix_order(df), df)
    got = sorted((x["rank"], x.rid, x.pos, x.length, x.lcp) for x in order.collect())
    assert got == [(k, i, p, len(s), shared(s, every[k - 1][0]) if k else 0) for k, (s, i, p) in enumerate(every)]
    ends = [x["rank"] for x in suffixes.block_ends(order).orderBy("block").collect()]
    assert ends == [k for k, (s, _, _) in enumerate(every) if k + 1 == len(every) or not every[k + 1][0].startswith(s)]
    found = {tuple(x) for x in suffixes.prefix_search(spark.createDataFrame([("ACA",), ("C",), ("",), (None,)], "word string"), df).collect()}
    assert found == {(w, i, p + 1) for w in ("ACA", "C") for i, s in seqs for p in range(len(s)) if s.startswith(w, p)}


def test_kmers_of_long_sequences(spark):
    r = random.Random(1)
    seqs = [(i, "".join(r.choice("ACDEFG") for _ in range(n))) for i, n in enumerate([3, 5, 6, 7, 127, 128, 129, 133, 134, 256, 257, 1000])]
    df = spark.createDataFrame(seqs, "rid long, seq string")
    for k in (1, 6, 150):
        assert sorted(map(tuple, kmers.kmers(df, k).collect())) == sorted((i, p + 1, s[p : p + k]) for i, s in seqs for p in range(len(s) - k + 1))


def test_students_t(spark):
    assert community.student_p(1.0, 1) == pytest.approx(0.5) and community.student_p(0.0, 7) == 1.0
    assert community.student_p(2.0, 10) == pytest.approx(0.073388, abs=1e-6) and community.student_p(-2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert community.student_p(40.0, 300) < 1e-100 and math.isnan(community.student_p(math.nan, 3))
    rows = [("f", 0, x) for x in (1.0, 2.0, 3.0, 4.0)] + [("f", 1, x) for x in (3.0, 5.0, 7.0)] + [("g", 0, 1.0), ("g", 1, 1.0)]
    (got,) = community.welch_tests(spark.createDataFrame(rows, "feature string, grp int, value double")).collect()
    assert (got.t, got.df) == (pytest.approx(-1.889822, abs=1e-5), pytest.approx(3.234719, abs=1e-5)) and 0.14 < got.p < 0.16


def test_subsamples_and_bootstrap_intervals(spark):
    hits = spark.createDataFrame([(f"r{i}", g) for i in range(200) for g in ((1, 2) if i % 4 == 0 else (1,) if i % 4 < 3 else (2,))], "read string, genome long")
    assert abundance.subsampled(hits, 0.3, 1).select("read").distinct().count() == 60
    assert abundance.subsampled(hits, 0.3, 1).exceptAll(abundance.subsampled(hits, 0.3, 1)).isEmpty()
    lengths = spark.createDataFrame([(1, 1000), (2, 500)], "genome long, length long")
    each = abundance.bootstrap(hits, lengths, 5, 0.9, 60, 1e-4).collect()
    for k in range(5):
        own = {r.genome: r.abundance for r in each if r.replicate == k}
        assert sum(own.values()) == pytest.approx(1) and 0.3 < own[2] < 0.7
    got = {r.genome: (r.low, r.high) for r in abundance.percentile_interval(spark.createDataFrame(each)).collect()}
    assert got[1][0] <= got[1][1]


def test_spectra_summaries_and_tables(spark):
    a, b = (spark.createDataFrame(rows, "kmer string, n long") for rows in ([("x", 3), ("y", 1)], [("x", 1), ("y", 1), ("z", 5)]))
    plain = lambda df: dict(map(tuple, df.collect()))
    assert plain(kmers.add_counts(a, b)) == {"x": 4, "y": 2, "z": 5}
    assert plain(kmers.subtract_counts(a, b)) == {"x": 2}
    assert plain(kmers.set_counts(a, b)) == {"x": 1, "y": 1, "z": 5}
    got = plain(evaluation.summary(spark.createDataFrame([(x,) for x in [5, 1, 3, 2, 4, 6, 8, 7, 10, 9, None]], "v long"), "v"))
    assert got["n"] == 10 and got["mean"] == 5.5 and got["median"] == 6 and got["decile 3"] == 3
    rows = [("s", "t", "g", 1, 5), ("s", "t", "g", 2, 7), ("u", "t", "g", 1, 1), ("u", "t", "h", 1, 2)]
    got = {r.key: (r.s, r.u) for r in community.last_values(spark.createDataFrame(rows, "sample string, taxon string, gene string, line int, n int"), ["s", "u"]).collect()}
    assert got == {"t||g": (7, 1), "t||h": (0, 2)}
    key = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k int")
    assert tuple(evaluation.confusion_within(key(1, 2, 3, 4, 4), key(1, 2, 9), key(2, 3, 9), "k").first()) == (1, 1, 1, 1)


def test_sql_functions(spark):
    names = register.register(spark)
    assert "cf_bit_score" in names
    row = spark.sql("SELECT cf_peptide('ab c1D!') AS p, cf_overlap(1, 5, 4, 9) AS o, cf_reduced_td5('PGFM') AS r, round(cf_bit_score(100, 0.267, 0.041), 3) AS b").first()
    assert tuple(row) == ("ACD", 2, "AADE", 43.128)
    assert [tuple(r) for r in spark.sql("SELECT * FROM cf_kmers('ABCD', 3)").collect()] == [(1, "ABC"), (2, "BCD")]
    register.register_series(spark, "cf_twice", "long", lambda x: 2 * x)
    assert spark.range(3).select(F.sum(F.expr("cf_twice(id)"))).first()[0] == 6


def test_assortativity_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "source int, target int")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "v int, label string")
    # two of three edges within; ends are half and half: (2/3 - 1/2) / (1/2)
    assert network.label_assortativity(edges, labels).first()[0] == pytest.approx(1 / 3)
    assert tuple(network.largest_component(edges.union(spark.createDataFrame([(7, 8)], edges.schema))).first()) == (1, 4)
    got = {r.statistic: (r.in_degree, r.out_degree) for r in network.degree_statistics(spark.createDataFrame([(1, 2), (1, 3), (1, 3), (3, 2)], "src int, dst int"), [0.5, 1.0]).collect()}
    assert got["max"] == (2.0, 2.0) and got["avg"] == (1.0, 1.0) and got["quantile 1.0"] == (2.0, 2.0)
