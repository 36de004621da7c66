import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cladeflow.functions import alphabet, scoring
from cladeflow.operators import alignment, assembly, intervals, kmers, network

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def seqs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "rid long, seq string")


def rand(n, seed, letters=LETTERS):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def test_kmers_of_long_and_short_sequences(spark):
    texts = ["", "ACD", "ACDE", rand(700, 1), rand(128, 2), rand(131, 3), None]
    got = {}
    for r in kmers.kmers(seqs(spark, texts), 4).collect():
        got.setdefault(r.rid, {})[r.pos] = r.kmer
    for i, t in enumerate(texts):
        assert got.get(i, {}) == {p + 1: t[p : p + 4] for p in range(len(t or "") - 3)}


def test_alphabet_functions(spark):
    df = spark.createDataFrame([("ACDEF", "AUGCTX", "ATGTAAGGN---A")], "p string, r string, d string")
    row = df.select(
        alphabet.reduced(F.col("p"), "GBMR4").alias("g"), alphabet.reverse_complement(F.col("r")).alias("c"), alphabet.translated(F.col("d")).alias("t"),
        alphabet.kmer_decode(alphabet.kmer_code(F.col("p")), 5).alias("k"),
    ).first()
    assert (row.g, row.c, row.t, row.k) == ("BCBBC", "GCAU", "M*X-", "ACDEF")
    assert all(len(v) == 20 for v in alphabet.ALPHABETS.values())


def test_score_statistics():
    table = scoring.blosum62()
    assert all(table[a + b] == table[b + a] for a in scoring.ORDER for b in scoring.ORDER)
    assert table["WW"] == 11 and table["AR"] == -1 and scoring.mean_self_score(table) == 5
    assert scoring.karlin("BLOSUM62", 11, 1) == (0.267, 0.041)
    with pytest.raises(ValueError):
        scoring.karlin("BLOSUM62", 3, 3)
    s = assembly.raw_cutoff(300, 100000, 1e-5)
    assert 0.041 * 300 * 100000 * math.exp(-0.267 * (s + 1)) < 1e-5


def global_score(a, b, gap_open=10, gap_extend=1):
    """Affine global score by the plain recurrence."""
    table, low = scoring.blosum62(), -(10**9)
    m = {(0, 0): 0}
    x, y = {}, {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        x[i, j] = max(m.get((i - 1, j), low) - gap_open, x.get((i - 1, j), low)) - gap_extend if i else low
        y[i, j] = max(m.get((i, j - 1), low) - gap_open, y.get((i, j - 1), low)) - gap_extend if j else low
        if i or j:
            m[i, j] = max(m[i - 1, j - 1] + table[a[i - 1] + b[j - 1]] if i and j else low, x[i, j], y[i, j])
    return m[len(a), len(b)]


def rescored(a, b, result, gap_open=10, gap_extend=1):
    score, i, _, j, _, trace = result
    total, table = 0, scoring.blosum62()
    for op, run in itertools.groupby(trace):
        n = len(list(run))
        if op == "M":
            total += sum(table[a[i + k] + b[j + k]] for k in range(n))
            i, j = i + n, j + n
        else:
            total -= gap_open + n * gap_extend
            i, j = (i + n, j) if op == "I" else (i, j + n)
    return total, i, j


@settings(max_examples=60, deadline=None)
@given(st.text(LETTERS, max_size=12), st.text(LETTERS, max_size=12))
def test_alignment_against_plain_recurrence(a, b):
    got = alignment.align(a, b)
    assert got[0] == global_score(a, b) == rescored(a, b, got)[0]
    best = max((global_score(a[i:k], b[j:m]) for i in range(len(a) + 1) for k in range(i, len(a) + 1) for j in range(len(b) + 1) for m in range(j, len(b) + 1)), default=0) if len(a) * len(b) <= 36 else None
    local = alignment.align(a, b, "local")
    assert rescored(a, b, local) == (local[0], local[2], local[4])
    assert best is None or local[0] == best
    inside = alignment.align(a, b, "query_in_target")
    assert inside[0] == max(global_score(a, b[j:m]) for j in range(len(b) + 1) for m in range(j, len(b) + 1))


def test_alignment_batches_and_extension(spark):
    q, t = rand(40, 4), rand(30, 5)
    df = spark.createDataFrame([(1, 2, q, t + q + t), (1, 3, q, t)], "qid long, rid long, query string, target string")
    got = {r.rid: r for r in alignment.align_pairs(df, "local").collect()}
    assert (got[2].q_begin, got[2].q_end, got[2].t_begin, got[2].trace) == (0, 40, 30, "M" * 40)
    score, lo, hi = alignment.x_drop(q, t + q + t, 10, 40, 3)
    assert lo <= 0 + 0 and hi >= 40 and score == sum(scoring.blosum62()[c + c] for c in q)
    assert alignment.chain([(0, 5, 0, 5, 9), (6, 9, 7, 10, 4), (2, 4, 2, 4, 1)]) == (13, [0, 1])


def test_profiles_and_correction():
    match = np.full((4, 20), 5.0)
    for k, c in enumerate("ACDE"):
        match[k, LETTERS.index(c)] = 0.5
    moves = np.tile([0.1, 4, 4, 0.5, 0.9, 0.5, 0.9], (5, 1))
    insert, null = np.full((5, 20), 3.0), np.full(20, 3.0)
    score = lambda s: alignment.profile_viterbi(match, insert, moves, s, background=null)
    assert score("ACDE") > score("ACCE") > score("WWWW")
    assert alignment.profile_consensus(match) == "ACDE"
    assert (0, "ACD", 7.5) in alignment.profile_words(match, 3, 7.0, null)
    good = "ACDEFGHIKLMN"
    trusted = {good[i : i + 4] for i in range(len(good) - 3)}
    assert alignment.correct_read("ACDEFGHWKLMN", 4, trusted, 2) == good
    assert alignment.correct_read("WWWWWWWW", 4, trusted, 2) == "WWWWWWWW"


def test_unitigs_spell_unbranched_paths(spark):
    a, b = rand(300, 6), rand(200, 7)
    found = {r.seq: r.n_edges for r in network.unitigs(network.de_bruijn(seqs(spark, [a, b, "ACDEFACDEFACDEFACDEF"]), 6)).collect()}
    assert {a, b} <= set(found) and found[a] == 294
    assert not any("ACDEFACDEF" in s for s in found)  # a circle
    branched = {r.seq for r in network.unitigs(network.de_bruijn(seqs(spark, ["AAAACCCCDDDDEEEE", "WWWWCCCCDDDDFFFF"]), 4)).collect()}
    assert any("CCCCDDDD" in s for s in branched)


def test_overlaps_containment_and_mapping(spark):
    g = rand(120, 8)
    df = seqs(spark, [g[:60], g[40:100], g[80:], g[10:50], g[:60]])
    over = {(r.a, r.b): r.length for r in kmers.overlaps(df, 10).collect()}
    assert over[0, 1] == 20 and over[1, 2] == 20
    assert [r.rid for r in kmers.contained(df, 10).collect()] == [3]
    wrong = g[20:30] + "W" + g[31:50]
    hit = kmers.map_reads(seqs(spark, [wrong, rand(30, 99)]), seqs(spark, [g]), 8, 2, 0.9).collect()
    assert [(r.rid, r.start, r.errors) for r in hit] == [(0, 21, int(g[30] != "W"))]


def test_assembly_of_simulated_reads(spark):
    g = rand(200, 9)
    genome = spark.createDataFrame([("g", g)], "genome string, seq string")
    reads = assembly.simulated_reads(spark, genome, 40, 12.0, 3)
    assert all(g[r.start : r.start + 40] == r.seq for r in reads.collect())
    longest = max(assembly.multi_k(reads.select("rid", "seq"), [8, 10], 2).collect(), key=lambda r: len(r.seq)).seq
    assert len(longest) > 60 and longest in g
    parts = seqs(spark, [g[:60], g[40:100], g[80:140]])
    got = assembly.extended_contigs(parts.select(F.lit(1).alias("qid"), "rid", "seq", F.lit(1.0).alias("score")), kmers.overlaps(parts, 10)).collect()
    assert [r.seq for r in got] == [g[:140]]
    same = g[:50] + "W" + g[51:100]
    leaders = {r.rid: r.leader for r in assembly.clusters(seqs(spark, [g[:100], same, rand(80, 50)]), 5, 0.5).collect()}
    assert leaders == {0: 0, 1: 0, 2: 2}


def test_search_finds_the_planted_homolog(spark):
    q = rand(80, 10)
    hit = q[:30] + rand(3, 11) + q[33:]
    got = assembly.search(seqs(spark, [q]), seqs(spark, [rand(60, i) for i in range(20, 30)] + [rand(20, 12) + hit]), 6, most_e=1e-3).collect()
    assert [r.rid for r in got] == [10] and got[0].e_value < 1e-20


def test_intervals(spark):
    r = random.Random(3)
    a = [(r.randint(0, 2), i, b, b + r.randint(0, 90)) for i in range(80) for b in [r.randint(0, 300)]]
    b = [(r.randint(0, 2), i, s, s + r.randint(0, 200)) for i in range(80) for s in [r.randint(0, 300)]]
    x = spark.createDataFrame(a, "target long, rid long, begin long, end long")
    y = spark.createDataFrame(b, "target long, nid long, start long, stop long")
    got = sorted((p.rid, p.nid) for p in intervals.overlap_join(x, y, 32).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3])
    hits = spark.createDataFrame([(1, 1, 0, 50, 1e-9), (1, 2, 45, 99, 1e-8), (1, 3, 20, 60, 1e-7), (1, 4, 70, 80, 1e-9), (1, 1, 0, 50, 1e-9)], "target long, rid long, begin long, end long, e_value double")
    assert sorted(h.rid for h in intervals.greedy_regions(hits).collect()) == [1, 2]


def test_seed_and_placement_operators(spark):
    g, h = rand(90, 20), rand(70, 21)
    df = seqs(spark, [g, h, g[10:50]])
    assert [r.distance for r in kmers.weighted_profile_distance(df, df, 3).collect()] == [0, 0, 0]
    bits = kmers.bloom_bits(df, 4)
    same = kmers.bloom_common(bits, df.where("rid = 0"), df.where("rid = 2")).count()
    assert same == 8
    assert kmers.subsampled(df, "seq", [("^A", 0.0), (".", 0.0)], 1).count() == 0 and kmers.subsampled(df, "seq", [], 1).count() == 3
    chain = kmers.boundary_pairs(seqs(spark, ["AAACCC", "CCCDDD", "EEEFFF"]), 3)
    assert {r.kmer for r in kmers.kmer_closure(chain, spark.createDataFrame([("AAA",)], "kmer string"), 0.0).collect()} == {"AAA", "CCC", "DDD"}
    counts = spark.createDataFrame([(f"k{i}", i) for i in range(1, 11)], "kmer string, n long")
    assert {r.n for r in kmers.top_seeds(counts, 0.3).collect()} == {7, 8, 9, 10}
    place = kmers.anchored_placements(seqs(spark, [g[10:50]]), seqs(spark, [g]), 6, 5).collect()
    assert [(r.start, r.positive) for r in place] == [(10, 1.0)]
    wrong = g[20:30] + ("A" if g[30] != "A" else "C") + g[31:50]
    found = kmers.inexact_matches(seqs(spark, [wrong]), seqs(spark, [h, g]), 2, 30).collect()
    assert [(r.tid, r.start, r.errors) for r in found] == [(1, 21, 1)]
    seeds = spark.createDataFrame([(1, 1, 5, 10, 9), (1, 1, 7, 12, 8), (1, 1, 5, 30, 7)], "qid long, rid long, qpos long, pos long, score int")
    assert {(r.qpos, r.pos) for r in kmers.distinct_seeds(seeds).collect()} == {(5, 10), (5, 30)}


def test_paths_and_pairs(spark):
    edges = spark.createDataFrame([("AB", "BC"), ("BC", "CD"), ("BC", "CE"), ("XY", "YZ")], "src string, dst string")
    paths = assembly.spelled_paths(edges)
    assert {r.seq for r in paths.collect()} == {"ABCD", "ABCE", "XYZ"}
    chosen = assembly.covering_paths(paths, seqs(spark, ["BCD", "AB", "YZ"]))
    assert {r.seq for r in chosen.collect()} == {"ABCD", "XYZ"}
    side = lambda rows: spark.createDataFrame(rows, "qid long, seed string, cid long, score double")
    got = assembly.best_seed_pairs(side([(1, "s", 1, 5.0), (1, "s", 2, 9.0)]), side([(1, "s", 7, 3.0)])).collect()
    assert {(r.fcid, r.bcid) for r in got} == {(2, 7), (1, None)}


def test_tags_and_prefix_sums(spark):
    from cladeflow.operators import evaluation

    df = spark.createDataFrame([("c1 reads:5", "A" * 70), ("c2 reads:3", "A"), ("c3", "A" * 80)], "header string, seq string")
    assert evaluation.recruited_reads(df).first().reads == 5
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(40)], "i long, first boolean").repartition(3)
    assert all(r.before == len([j for j in range(r.i) if j % 3 == 0]) for r in evaluation.starts_before(rows, "i", "first").collect())


def test_word_edits_see_whole_texts(spark, tmp_path):
    from cladeflow.plans.queries import QUERIES

    r = random.Random(8)
    word = lambda n: "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    same = word(40)
    pairs = [(same + "ACD", same + "WWWWW"), (word(150), word(120)), (word(30), None), ("", "ac de")]
    spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pairs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    clean = lambda t: (t or "").replace(" ", "").upper()
    got = {x.rid: x.edits for x in QUERIES["word_edits"](spark, str(tmp_path)).collect()}
    assert got == {i: edits(clean(a), clean(b)) for i, (a, b) in enumerate(pairs)} and got[0] == 5
