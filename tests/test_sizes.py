"""Results that came with tables too large on the way, and where these tables must not come back."""

import itertools

import pytest
from pyspark.sql import DataFrame, functions as F

from cladeflow.operators import network


@pytest.fixture(scope="module")
def parts(spark):
    """Two components: a ring of 30 with chords, and six vertices all joined."""
    ring = {tuple(sorted((i, (i + s) % 30))) for i in range(30) for s in (1, 5)}
    full = set(itertools.combinations(range(100, 106), 2))
    edges = sorted(ring | full)
    return edges, spark.createDataFrame([(a, b, 1.0) for a, b in edges], "source long, target long, weight double")


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_betweenness_keeps_edges_off_the_driver(spark, parts, monkeypatch):
    own = type(parts[1])
    limit = own.limit
    monkeypatch.setattr(own, "limit", lambda self, n: limit(self, n) if n < 100 else pytest.fail("a table comes to the driver"))
    got = {r.v: r.betweenness for r in network.betweenness(parts[1]).collect()}
    assert len(got) == 36 and all(got[v] == 0 for v in range(100, 106))
    assert len({round(got[v], 12) for v in range(30)}) == 1 and got[0] > 0


def hops(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        dist, queue = {s: 0}, [s]
        for v in queue:
            for w in near[v] - dist.keys():
                dist[w] = dist[v] + 1
                queue.append(w)
        out[s] = [d for d in dist.values() if d]
    return out


def test_global_properties_without_a_table_of_pairs(parts, monkeypatch):
    monkeypatch.setattr(network, "distances", lambda *_: pytest.fail("all pairs"))
    monkeypatch.setattr(network, "triangles", lambda *_: pytest.fail("all triangles"))
    row = network.global_properties(parts[1]).first()
    every = [d for ds in hops(parts[0]).values() for d in ds]
    tri = sum({(a, b), (b, c), (a, c)} <= set(parts[0]) for a, b, c in itertools.combinations(sorted(hops(parts[0])), 3))
    assert (row.vertices, row.edges, row.components) == (36, len(parts[0]), 2)
    assert abs(row.mean_path - sum(every) / len(every)) < 1e-12
    assert abs(row.transitivity - 3 * tri / (30 * 6 + 6 * 10)) < 1e-12


def test_harmonic_without_a_table_of_pairs(parts, monkeypatch):
    monkeypatch.setattr(network, "distances", lambda *_: pytest.fail("all pairs"))
    got = {r.v: r.harmonic for r in network.harmonic(parts[1]).collect()}
    assert all(abs(got[v] - sum(1 / d for d in ds)) < 1e-9 for v, ds in hops(parts[0]).items()) and len(got) == 36


def test_cliques_are_listed_where_their_component_is(spark, parts):
    found = network.cliques(parts[1], 4)
    assert "Aggregate" not in plan(found) and "MapInArrow" in plan(found)
    assert {tuple(r.members) for r in found.collect()} == set(itertools.combinations(range(100, 106), 4))
    assert network.cliques(parts[1], 5).count() == 6 and network.cliques(parts[1], 2).count() == len(parts[0])
    # led by smaller degree where a vertex would lead too many
    import numpy as np
    from cladeflow.operators.walks import Graph

    g = Graph(*np.array(parts[0]).T)
    assert sorted(map(tuple, np.concatenate(list(g.cliques(3, np.arange(g.n), 1))))) == sorted(map(tuple, np.concatenate(list(g.cliques(3, np.arange(g.n))))))


def test_included_reads_take_the_first_of_equal_rows(spark, tmp_path):
    import duckdb

    from cladeflow.plans.queries import ORACLES, QUERIES

    rows = [(1, 1, 7, 100), (1, 1, 7, 900), (1, 1, 7, 2000), (2, 3, 8, 50), (2, 3, 8, 20), (1, 2, 8, 60), (0, 1, 7, 950), (0, 2, 7, 150)]
    rows += [(k, 1, s, p) for s in range(20, 60) for k, p in ((5, s * 3), (5, 4000 - s * 50), (4, s * 3 + 9))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["included_reads"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLES["included_reads"]).fetchall())


def test_bootstrap_gathers_hits_once(spark, monkeypatch):
    from cladeflow.operators import abundance

    hits = spark.createDataFrame([(r, (r * r + i * 7) % 5) for r in range(200) for i in range(r % 3 + 1)], "read long, genome long")
    lengths = spark.createDataFrame([(g, 100 + 10 * g) for g in range(5)], "genome long, length long")
    want = {}
    for i in range(2):
        mixing = abundance.expectation_maximisation(abundance.resampled(hits, 0.9, i), 3, 0)
        by = {r.genome: r.pi / (100 + 10 * r.genome) for r in mixing.collect()}
        want |= {(i, g): x / sum(by.values()) for g, x in by.items()}
    monkeypatch.setattr(abundance, "resampled", lambda *_: pytest.fail("a copy of the hits for each replicate"))
    got = {(r.replicate, r.genome): r.abundance for r in abundance.bootstrap(hits, lengths, 2, 0.9, 3, 0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.fixture(scope="module")
def reads_(spark):
    """Sequences of which many share their first or last letters, copies and repeats among them."""
    core = ["ACDEFGHIKL", "MNPQRSTVWY", "ACACACACAC", "LLLLLLLLLL"]
    texts = [core[i % 4] + "AC" * (i % 3) + "GHKY"[i % 4] + core[(i // 4) % 4] for i in range(24)] + ["LLLLLLLLLLL"] * 2 + ["ACDEFGHIKL", "", "MNPQ"]
    return dict(enumerate(texts)), spark.createDataFrame(list(enumerate(texts)), "rid long, seq string")


def overlaps_by_hand(texts, k):
    out = {}
    for (a, x), (b, y) in itertools.permutations(texts.items(), 2):
        fits = [n for n in range(k, min(len(x), len(y))) if x[-n:] == y[:n]]
        if fits:
            out[a, b] = max(fits)
    return out


def test_overlaps_send_no_sequences(reads_):
    from cladeflow.operators import kmers

    found = kmers.overlaps(reads_[1], 5)
    assert "seq" not in plan(found)
    assert {(r.a, r.b): r.length for r in found.collect()} == overlaps_by_hand(reads_[0], 5)


def test_overlaps_make_their_sequences_twice(spark):
    """Once for the outermost letters, once for the places; not once more for each side."""
    from cladeflow.operators import kmers

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    texts = ["ACDEFGHIKL", "HIKLMNPQRS", "PQRSTVWYAC"]
    seqs = spark.createDataFrame(list(enumerate(texts)), "rid long, seq string").mapInArrow(seen, "rid long, seq string")
    assert {tuple(r) for r in kmers.irreducible_overlaps(seqs, 4).collect()} == {(0, 1, 4), (1, 2, 4)}
    assert made.value == 2 * len(texts)


def test_overlaps_join_ends_that_may_meet(spark, monkeypatch):
    """Ends that begin like a sequence are many, those that go on like it few; only these are shuffled."""
    from cladeflow.operators import kmers

    written = []
    monkeypatch.setattr(kmers, "cut", lambda df, own=kmers.cut: written.append((df.columns, (made := own(df)).count())) or made)
    texts = [f"ACDEF{'GHIKLMNPQR'[i % 10]}{'STVWYACDEF'[i // 10 % 10]}{'GHIKLMNPQRSTVWYACDEF'[i % 20]}LLLACDEF{'RQPNMLKIHG'[i % 10]}{'TSYWV'[i % 5]}W" for i in range(100)] + ["ACDEFQQQLLL", "QQQLLLACDEFKW"]
    found = kmers.irreducible_overlaps(spark.createDataFrame(list(enumerate(texts)), "rid long, seq string"), 5)
    ends = [n for columns, n in written if "side" in columns]
    want = overlaps_by_hand(dict(enumerate(texts)), 5)
    assert {(r.a, r.b): r.length for r in found.collect()} == {(a, b): n for (a, b), n in want.items() if not any((a, x) in want and (x, b) in want for x in range(len(texts)))}
    assert len(ends) == 3 and ends[-1] < ends[0] / 4 and want


def test_normalised_walks_over_a_text_once(spark):
    from cladeflow.functions import alphabet

    texts = ["aBcoux-Z é\nılſß𝄞İyW", "", None, "BJOUXZ", "acdefghiklmnpqrstvwy1ACDEFGHIKLMNPQRSTVWY"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(alphabet.normalised(F.col("text")).alias("seq"))
    assert plan(found).lower().count("regexp_replace(") == 1
    assert [r.seq for r in found.collect()] == ["".join(c for c in "".join(c for c in t or "" if c.isascii()).upper() if c in alphabet.RESIDUES) for t in texts]


def test_irreducible_overlaps_by_classes(reads_):
    from cladeflow.operators import kmers

    want = overlaps_by_hand(reads_[0], 5)
    want = {(a, b): n for (a, b), n in want.items() if not any((a, x) in want and (x, b) in want for x in reads_[0])}
    assert {(r.a, r.b): r.length for r in kmers.irreducible_overlaps(reads_[1], 5).collect()} == want


def test_end_joins_send_ends_only(spark, reads_):
    from cladeflow.operators import assembly

    found = assembly.end_joins(reads_[1], 6, 4)
    assert "aseq" not in plan(found) and "bseq" not in plan(found)
    want = {}
    for (a, x), (b, y) in itertools.permutations(reads_[0].items(), 2):
        fits = [n for n in range(4, 7) if len(x) > n and len(y) > n and x[-n:] == y[:n]]
        if fits:
            want[a, b] = max(fits)
    assert {(r.a, r.b): r.length for r in found.collect()} == want


def test_reduced_lookup_shuffles_what_may_match(spark, monkeypatch):
    from cladeflow.operators import kmers, sieve

    seen = []
    among = sieve.kmers_among
    monkeypatch.setattr(sieve, "kmers_among", lambda *a: seen.append(among(*a)) or seen[-1])
    letters = "ACDEFGHIKLMNPQRSTVWY"
    seqs = {i: "".join(letters[(i * 7 + j * j * (i % 5 + 1)) % 20] for j in range(60)) for i in range(40)}
    q = {0: seqs[3][10:30], 1: seqs[8][:14].translate(str.maketrans("ILV", "VIL"))}
    frame = lambda d: spark.createDataFrame(list(d.items()), "rid long, seq string")
    got = {tuple(r)[:4] for r in kmers.reduced_lookup(frame(q), frame(seqs), 8, "GBMR10", -100).collect()}
    from cladeflow.functions import alphabet

    low = str.maketrans(alphabet.RESIDUES, alphabet.classes("GBMR10"))
    cut = lambda t: [t[i : i + 8].translate(low) for i in range(len(t) - 7)]
    assert got == {(a, i + 1, b, j + 1) for a, x in q.items() for i, u in enumerate(cut(x)) for b, y in seqs.items() for j, v in enumerate(cut(y)) if u == v}
    assert seen and seen[0].count() < 40 * 53


@pytest.mark.parametrize("share", [4_000_000, 50])
def test_edits_within_pair_classes_of_equal_texts(spark, monkeypatch, share):
    from cladeflow.operators import alignment

    names = ["red anvil", "blue anvil", "small widget", None, "red anvil", ""]
    rows = [(i % 40, "xyz"[i % 3] if i % 17 else None, i % 2, names[(i * i + i // 7) % 6]) for i in range(90)]
    monkeypatch.setattr(alignment, "PAIRS", share)
    found = alignment.edits_within(spark.createDataFrame(rows, "id long, brand string, size int, text string"), ["brand", "size"])
    assert "levenshtein(a" not in plan(found) and found.rdd.getNumPartitions() > (share == 50)

    def edits(x, y):
        line = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, line[0] = line[0], i
            for j, d in enumerate(y, 1):
                before, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, before + (c != d))
        return line[-1]

    want = [(a[0], b[0], None if a[3] is None or b[3] is None else edits(a[3], b[3])) for a in rows for b in rows if a[1] and a[1:3] == b[1:3] and a[0] < b[0]]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_edit_distances_are_found_by_class(spark):
    from cladeflow.plans.queries import QUERIES

    assert "collect_list" in plan(QUERIES["edit_distances"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("letters", [1 << 20, 7])
@pytest.mark.parametrize(("k", "other"), [(3, ""), (12, ""), (16, ""), (4, "Łö𝄞")])
def test_kmers_are_counted_without_a_row_each(spark, monkeypatch, letters, k, other):
    import random
    from collections import Counter

    from cladeflow.operators import tally

    draw = random.Random(k)
    core = ["".join(draw.choices("ACDEFGHIKLMNPQRSTVWY" if k > 4 else "ACG" + other, k=60)) for _ in range(4)]
    texts = [core[i % 4][: 20 + i] + core[(i * 3 + 1) % 4][i:] for i in range(40)] + ["", "AC", "L" * 50, core[0][:k], None]
    monkeypatch.setattr(tally, "LETTERS", letters)
    seqs = spark.createDataFrame(list(enumerate(texts)), "rid long, seq string")
    found = network.de_bruijn(seqs, k, 3)
    assert "kmer" not in plan(found) and "posexplode" not in plan(found)
    count = lambda n: Counter(t[i : i + n] for t in texts if t for i in range(len(t) - n + 1))
    often = {w for w, n in count(k).items() if n >= 3}
    want = {(w[:k], w[1:], n) for w, n in count(k + 1).items() if w[:k] in often and w[1:] in often}
    assert {tuple(r) for r in found.collect()} == want and want


@pytest.mark.parametrize(("k", "at_once"), [(2, 1 << 17), (6, 1 << 17), (12, 1 << 17), (5, 7), (12, 7)])
def test_frequent_edges_send_no_letters(spark, monkeypatch, k, at_once):
    """k-mers of raw texts are counted as numbers; rare, frequent and very frequent ones, in one slice or many."""
    import random
    from collections import Counter

    from cladeflow.functions import alphabet
    from cladeflow.operators import tally

    draw = random.Random(k)
    core = ["".join(draw.choices("ACDEFGHIKLMNPQRSTVWYouxz -é\nılſ𝄞aclmn", k=60)) for _ in range(4)]
    texts = [core[i % 4][: 20 + i] + core[(i * 3 + 1) % 4][i:] for i in range(40)] + ["", "AC", "L" * 50, "xyz", None, core[0][:k]] + [core[1]] * 5000
    monkeypatch.setattr(tally, "SLICE", at_once)
    monkeypatch.setattr(tally, "SORTED", 50 * at_once)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = network.frequent_edges(rows, k, 3)
    shuffled = tally.residues(rows, k, 3)
    assert "regexp" not in plan(shuffled) and "posexplode" not in plan(shuffled) and "kinds" in plan(shuffled)
    peptides = [r.seq for r in rows.select(alphabet.normalised(F.col("text")).alias("seq")).collect()]
    count = lambda n: Counter(t[i : i + n] for t in peptides for i in range(len(t) - n + 1))
    often = {w for w, n in count(k).items() if n >= 3}
    want = {(w[:k], w[1:], n) for w, n in count(k + 1).items() if w[:k] in often and w[1:] in often}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_frequent_edges_is_what_the_query_runs(spark):
    from cladeflow.plans.queries import QUERIES

    assert "regexp" not in plan(QUERIES["de_bruijn_frequent"](spark, "/root/testdata/sf0.001"))


def test_tips_count_kmers_once(spark, monkeypatch):
    """A graph read in each step is written first."""
    edges = [("S", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "F"), ("F", "G"), ("C", "x"), ("u", "D")]
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    made = spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, n long").mapInArrow(seen, "src string, dst string, n long")
    left = {(r.src, r.dst) for r in network.tips_removed(made, 3).collect()}
    assert left == set(edges) - {("C", "x"), ("u", "D")}
    assert reads.value == len(edges)


def test_local_scores_of_many_pairs_are_those_of_align():
    import random

    from cladeflow.operators.alignment import align, local_scores

    draw = random.Random(3)
    some = lambda n, letters="ARNDCQEGHILKMFPSTWYV": "".join(draw.choice(letters) for _ in range(n))
    queries = ["", "A", *(some(n) for n in (3, 20, 60)), some(40, "AC"), "W" * 3000]
    targets = ["", *(some(9) + q[:25] + some(4) + q[28:] + "XZ*u" for q in queries[:6]), "W" * 400 + "A" + "W" * 400]
    of = [(i, j) for i in range(6) for j in range(len(targets))]
    for gap in ((11, 1), (10, 1), (3, 2), (0, 1)):
        assert local_scores(queries, targets, of, *gap).tolist() == [align(queries[i], targets[j], "local", *gap)[0] for i, j in of]
    # beyond two bytes
    assert local_scores(["W" * 3000], ["W" * 3100], [(0, 0)]).tolist() == [33_000]


def test_score_pairs_sends_a_sequence_once_for_its_queries(spark):
    from cladeflow.operators.alignment import align, score_pairs

    texts = [(1, "ACDEFGHIKLMNPQRSTVWY" * 3), (2, "ACDEFGHIK"), (3, "")]
    asked = [(i, "ACDEFGHIKLWWMNPQRSTVWY"[i % 9 :]) for i in range(100)]
    pairs = spark.createDataFrame([(q, r) for q, _ in asked for r, _ in texts], "qid long, rid long")
    got = score_pairs(pairs, spark.createDataFrame(asked, "rid long, seq string"), spark.createDataFrame(texts, "rid long, seq string"))
    want = {(q, r): align(a, b, "local")[0] for q, a in asked for r, b in texts}
    assert {(x.qid, x.rid): x.score for x in got.collect()} == want and got.count() == 300


def test_cut_leaves_no_shuffle_files(spark):
    from cladeflow.plans.iterate import cut

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    n = held()
    out = cut(spark.range(40_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.sum("id").alias("s")))
    assert held() <= n and out.count() == 5_000 and spark.conf.get(key) == before


def test_unitigs_of_many_lengths(spark):
    """Paths arrive in different rounds, and a circle never does."""
    edges = [(f"{c}{i:03}", f"{c}{i + 1:03}") for c, n in (("a", 1), ("b", 2), ("c", 33), ("d", 64)) for i in range(n)] + [("z0", "z1"), ("z1", "z0")]
    got = network.unitigs(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert sorted(r.n_edges for r in got) == [1, 2, 33, 64]
    assert {r.seq for r in got if r.n_edges < 3} == {"a0001", "b00012"}
