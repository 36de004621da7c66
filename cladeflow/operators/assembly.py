"""Search and assembly pipelines: seeds, extension by overlaps, merging, clustering, mapping, iteration over k.

What depends on order is done inside groups that are cut out by a join first (candidates of one query, one component),
in a stated total order.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scoring
from . import kmers, network
from .alignment import align


def seeds(queries: DataFrame, seqs: DataFrame, k: int = 6, alphabet_name: str = "GBMR10", share: float = 0.6) -> DataFrame:
    """Reduced-alphabet seeds with at least ``share`` of the mean self score of k residues."""
    least = int(share * k * scoring.mean_self_score(scoring.blosum62()))
    return kmers.reduced_lookup(queries, seqs, k, alphabet_name, least)


def best_seeds(found: DataFrame) -> DataFrame:
    """Per query and read the seed of highest score, ties to the first."""
    rank = F.row_number().over(Window.partitionBy("qid", "rid").orderBy(F.desc("score"), "qpos", "pos"))
    return found.withColumn("rank", rank).where("rank = 1").drop("rank")


def extended_contigs(recruited: DataFrame, overlaps: DataFrame, depth: int = 20) -> DataFrame:
    """Contigs of each query from its recruited reads ``(qid, rid, seq, score)`` and overlaps among them: reads by score,
    extended both ways by the longest unused overlap, each read used once.  ``(qid, contig, seq, reads)``.

    A query's recruited reads are one group: their number is bounded by the E-value cutoff that recruits them.
    """
    inside = overlaps.join(recruited.select("qid", F.col("rid").alias("a")), "a").join(recruited.select(F.col("qid").alias("q2"), F.col("rid").alias("b")), "b").where("qid = q2").select("qid", "a", "b", "length")
    next_ = inside.groupBy("qid", "a").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("n"), "b"))).alias("right"))
    prev = inside.groupBy("qid", F.col("b").alias("a")).agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("n"), F.col("a").alias("b")))).alias("left"))
    rows = recruited.withColumnRenamed("rid", "a").join(next_, ["qid", "a"], "left").join(prev, ["qid", "a"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seq = dict(zip(pdf["a"], pdf["seq"], strict=True))
        steps = {s: {r: [(-x["n"], x["b"]) for x in v] if v is not None else [] for r, v in zip(pdf["a"], pdf[s], strict=True)} for s in ("left", "right")}
        used, out = set(), []
        for r in pdf.sort_values(["score", "a"], ascending=[False, True])["a"]:
            if r in used:
                continue
            used.add(r)
            text, n = seq[r], 1
            for side in ("right", "left"):
                at = r
                for _ in range(depth):
                    step = next(((k, b) for k, b in steps[side][at] if b not in used and b in seq), None)
                    if not step:
                        break
                    k, at = step
                    used.add(at)
                    n += 1
                    text = text + seq[at][k:] if side == "right" else seq[at][: len(seq[at]) - k] + text
            out.append((pdf["qid"].iloc[0], len(out), text, n))
        return pd.DataFrame(out, columns=["qid", "contig", "seq", "reads"])

    return rows.groupBy("qid").applyInPandas(run, f"qid {dict(recruited.dtypes)['qid']}, contig int, seq string, reads int")


def merged_sides(forward: DataFrame, backward: DataFrame, least: float) -> DataFrame:
    """Contigs of both directions ``(qid, seed, cid, seq, score)`` of a seed: the best of one side with all of the other,
    the seed's score taken off once; those that reach ``least``."""
    top = lambda df, p: df.groupBy("qid", "seed", "seed_score").agg(F.max_by(F.struct("cid", "score"), F.struct("score", F.negative("cid"))).alias("x")).select("qid", "seed", "seed_score", F.col("x.cid").alias(f"{p}cid"), F.col("x.score").alias(f"{p}score"))
    every = lambda df, p: df.select("qid", "seed", "seed_score", F.col("cid").alias(f"{p}cid"), F.col("score").alias(f"{p}score"))
    keys = ["qid", "seed", "seed_score"]
    cols = [*keys, "fcid", "bcid", "fscore", "bscore"]
    both = top(forward, "f").join(every(backward, "b"), keys).select(cols).union(every(forward, "f").join(top(backward, "b"), keys).select(cols)).distinct()
    return both.withColumn("score", F.col("fscore") + F.col("bscore") - F.col("seed_score")).where(F.col("score") >= least)


def reconciled(hits: DataFrame, least: float) -> DataFrame:
    """``(rid, e_value)``: reads whose score and the best of the opposite side reach ``least``, with their least E-value."""
    return hits.where(F.col("score") + F.col("opposite") >= least).groupBy("rid").agg(F.min("e_value").alias("e_value"))


def clusters(seqs: DataFrame, k: int, shared: float = 0.85, least: float = 0.9) -> DataFrame:
    """``(rid, leader)``: longest first, a sequence joins the first leader it is similar to, else leads.

    Candidates share k-mers; sequences that no candidate pair connects can't join each other, so the greedy pass runs
    inside connected components.
    """
    sizes = kmers.inverted_index(seqs, k).groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
    pairs = kmers.shared_kmers(seqs, seqs, k, 1).where("rid < tid")
    pairs = pairs.join(sizes, "rid").join(sizes.select(F.col("rid").alias("tid"), F.col("n").alias("m")), "tid")
    close = pairs.where(F.col("shared") >= shared * F.least("n", "m")).select(F.col("rid").alias("source"), F.col("tid").alias("target"))
    part = network.components(close).select(F.col("v").alias("rid"), "component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size=pdf["seq"].str.len()).sort_values(["size", "rid"], ascending=[False, True])
        leaders, out = [], []
        for r in pdf.itertuples():
            for lid, lead in leaders:
                _, qb, qe, tb, te, trace = align(r.seq, lead, "query_in_target")
                same, i, j = 0, qb, tb
                for op in trace:
                    same += op == "M" and r.seq[i] == lead[j]
                    i, j = i + (op != "D"), j + (op != "I")
                if len(r.seq) and same / len(r.seq) >= least:
                    out.append((r.rid, lid))
                    break
            else:
                leaders.append((r.rid, r.seq))
                out.append((r.rid, r.rid))
        return pd.DataFrame(out, columns=["rid", "leader"])

    kind = dict(seqs.dtypes)["rid"]
    inside = seqs.join(part, "rid").groupBy("component").applyInPandas(run, f"rid {kind}, leader {kind}")
    alone = seqs.join(part, "rid", "left_anti").select("rid", F.col("rid").alias("leader"))
    return inside.unionByName(alone)


def end_joins(seqs: DataFrame, longest: int = 10, shortest: int = 4, support: DataFrame | None = None, ladder: int = 6) -> DataFrame:
    """``(a, b, length)``: ends that match exactly, the longest length from ``longest`` down to ``shortest``; with
    ``support`` (rid, seq) only where the k-mer over the junction occurs in a read."""
    # sequences of equal ends are one kind; kinds are joined, and a kind's members only for the rows of the result
    half = ladder // 2
    room = F.least(F.length("seq") - 1, F.lit(longest)).alias("room")
    fit = seqs.where(F.length("seq") > shortest)
    a = fit.select(F.col("rid").alias("a"), room, F.right("seq", F.lit(max(longest, half))).alias("end"))
    b = fit.select(F.col("rid").alias("b"), room, F.left("seq", F.lit(longest + ladder - half)).alias("head"))
    x, y = (t.select("room", c).distinct().toDF(f"{c}_room", c) for t, c in ((a, "end"), (b, "head")))
    best = None
    for n in range(longest, shortest - 1, -1):
        own, other = x.where(F.col("end_room") >= n).withColumn("word", F.right("end", F.lit(n))), y.where(F.col("head_room") >= n).withColumn("word", F.left("head", F.lit(n)))
        met = own.join(other, "word").drop("word").withColumn("length", F.lit(n))
        best = met if best is None else best.unionByName(met)
    top = best.groupBy("end_room", "end", "head_room", "head").agg(F.max("length").alias("length"))
    if support is not None:
        over = F.concat(F.right("end", F.lit(half)), F.substring("head", F.col("length") + 1, F.lit(ladder - half)))
        known = kmers.kmers(support, ladder).select(F.col("kmer").alias("over")).distinct()
        top = top.withColumn("over", over).join(known, "over", "left_semi")
    each = a.withColumnRenamed("room", "end_room").join(top, ["end_room", "end"]).join(b.withColumnRenamed("room", "head_room"), ["head_room", "head"])
    return each.where("a <> b").select("a", "b", F.col("length").cast("long").alias("length"))


def read_bridges(ends: DataFrame, least: int = 5) -> DataFrame:
    """``(a, b, middle, n)``: reads that match both a path's right and another's left end imply a middle string; the
    commonest, if at least ``least`` reads hold it.  ``ends(path, side, rid, middle_from, seq)``."""
    right = ends.where("side = 'right'").select(F.col("path").alias("a"), "rid", F.col("offset").alias("x"), "seq")
    left = ends.where("side = 'left'").select(F.col("path").alias("b"), "rid", F.col("offset").alias("y"))
    met = right.join(left, "rid").where("a <> b and y >= x").withColumn("middle", F.expr("substring(seq, x + 1, y - x)"))
    n = met.groupBy("a", "b", "middle").agg(F.count_distinct("rid").alias("n"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("n"), "middle"))
    return n.withColumn("rank", rank).where((F.col("rank") == 1) & (F.col("n") >= least)).drop("rank")


def query_parts(query: str, least: int = 40) -> list[tuple[int, int]]:
    """A query cut at the midpoints of off-diagonal local self-alignments (repeats): parts from 0, half-open."""
    if len(query) < 2:
        return [(0, len(query))]
    half = len(query) // 2
    score, qb, qe, tb, te, _ = align(query[:half], query[half:], "local")
    cuts = sorted({0, len(query), *([(qe + half + tb) // 2] if score >= least else [])})
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def stop_recovered(genes: DataFrame, reads: DataFrame) -> DataFrame:
    """Genes ``(gene, rid, end, protein)`` that reach their read's last codon but one: where the next codon is a stop,
    the protein gets a '*'."""
    joined = genes.join(reads.select("rid", F.col("seq").alias("dna")), "rid")
    codon = F.expr("substring(dna, end + 1, 3)")
    return joined.select("gene", F.when(codon.isin("TAA", "TAG", "TGA"), F.concat("protein", F.lit("*"))).otherwise(F.col("protein")).alias("protein"))


def multi_k(seqs: DataFrame, ks: list[int], least: int = 2) -> DataFrame:
    """For each k: graph, weak k-mers out, unitigs, which join the sequences of the next k.  ``(seq, n_edges)`` of the last."""
    pool, out = seqs.select("rid", "seq"), None
    for k in ks:
        out = network.unitigs(network.de_bruijn(pool, k, least))
        pool = seqs.select(F.col("rid").cast("string").alias("rid"), "seq").union(out.select(F.concat(F.lit(f"u{k}_"), F.sha2("seq", 256)), "seq").crossJoin(F.broadcast(seqs.sparkSession.range(least))).drop("id"))
    return out


def simulated_reads(spark: SparkSession, genomes: DataFrame, length: int, coverage: float, seed: int) -> DataFrame:
    """``(rid, genome, start, seq)``: substrings at places drawn by a hash of genome, number and seed."""
    n = F.greatest(F.lit(1), F.floor(F.length("seq") * coverage / length))
    rows = genomes.where(F.length("seq") >= length).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    start = F.pmod(F.xxhash64("genome", "i", F.lit(seed)), F.length("seq") - length + 1)
    rows = rows.withColumn("start", start)
    return rows.select(F.concat_ws("_", "genome", "i").alias("rid"), "genome", "start", F.substring("seq", (F.col("start") + 1).cast("int"), F.lit(length)).alias("seq"))


def search(queries: DataFrame, seqs: DataFrame, k: int = 6, alphabet_name: str = "GBMR10", gap: tuple[int, int] = (11, 1), most_e: float = 5.0) -> DataFrame:
    """Guided search: seeds, then local alignment of each seeded pair, bit score and E-value over all residues searched:
    ``(qid, rid, score, bits, e_value)``."""
    from .alignment import score_pairs

    lam, kk = scoring.karlin("BLOSUM62", *gap)
    pairs = best_seeds(seeds(queries, seqs, k, alphabet_name)).select("qid", "rid")
    found = score_pairs(pairs, queries, seqs, *gap)
    size = seqs.agg(F.sum(F.length("seq")).alias("n"))
    scored = found.join(queries.select(F.col("rid").alias("qid"), F.length("seq").alias("m")), "qid").join(F.broadcast(size), F.lit(True))
    out = scored.select("qid", "rid", "score", scoring.bit_score(F.col("score"), lam, kk).alias("bits"), scoring.e_value(F.col("score"), F.col("m"), F.col("n"), lam, kk).alias("e_value"))
    return out.where(F.col("e_value") <= most_e)


def raw_cutoff(m: int, n: int, e: float, gap: tuple[int, int] = (11, 1)) -> int:
    lam, k = scoring.karlin("BLOSUM62", *gap)
    return int((math.log(k) + math.log(m) + math.log(n) - math.log(e)) / lam)



def spelled_paths(edges: DataFrame, steps: int = 50, most: int = 1_000_000) -> DataFrame:
    """``(path, seq)``: all strings from sources to sinks of a small acyclic k-mer graph ``(src, dst)``, at most ``steps``
    edges long; more than ``most`` open paths raise."""
    from ..plans.iterate import cut

    roles = network.degrees(edges)
    open_ = roles.where("n_in = 0").select(F.col("v").alias("at"), F.col("v").alias("seq"))
    sinks = roles.where("n_out = 0").select(F.col("v").alias("at"))
    done = None
    for _ in range(steps):
        ended = open_.join(sinks, "at", "left_semi").select("seq")
        done = ended if done is None else done.union(ended)
        open_ = cut(open_.join(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").select(F.col("to").alias("at"), F.concat("seq", F.right("to", F.lit(1))).alias("seq")))
        n = open_.count()
        if n > most:
            raise ValueError(f"{n} open paths")
        if not n:
            break
    return done.union(open_.join(sinks, "at", "left_semi").select("seq")).distinct()


def covering_paths(paths: DataFrame, reads: DataFrame) -> DataFrame:
    """Of ``paths(seq)``, a greedy choice that covers all ``reads(rid, seq)`` that lie in some path: the path with the most
    reads not yet covered, ties to the text.  The choice is made on (path, read) pairs of one component of a graph."""
    pairs = paths.withColumnRenamed("seq", "path").join(reads, F.contains(F.col("path"), F.col("seq"))).select("path", "rid")
    most = 1_000_000
    rows = pairs.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the choice takes up to {most} pairs of path and read")
    left: dict[str, set] = {}
    for r in rows:
        left.setdefault(r["path"], set()).add(r["rid"])
    chosen = []
    while any(left.values()):
        best = min(left, key=lambda p: (-len(left[p]), p))
        chosen.append((best,))
        got = left[best]
        left = {p: s - got for p, s in left.items()}
    return paths.sparkSession.createDataFrame(chosen, "seq string")


def best_seed_pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Forward and backward extensions ``(qid, seed, cid, score)`` of a seed paired rank by rank by score; what is left
    over on one side stays alone."""
    rank = F.row_number().over(Window.partitionBy("qid", "seed").orderBy(F.desc("score"), "cid"))
    f = forward.withColumn("rank", rank).select("qid", "seed", "rank", F.col("cid").alias("fcid"), F.col("score").alias("fscore"))
    b = backward.withColumn("rank", rank).select("qid", "seed", "rank", F.col("cid").alias("bcid"), F.col("score").alias("bscore"))
    return f.join(b, ["qid", "seed", "rank"], "full_outer").drop("rank")
