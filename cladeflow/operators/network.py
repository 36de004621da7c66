"""Graphs as edge tables: k-mer graphs, string graphs and association networks.

Undirected edges are ``(source, target, weight)`` with source < target; directed ones ``(src, dst, n)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.iterate import cut, discard, until_stable
from . import tally
from .kmers import kmers
from .walks import by_component, forest


# --- k-mer graphs -------------------------------------------------------------------------------------------------------
def de_bruijn(seqs: DataFrame, k: int, least: int = 1) -> DataFrame:
    """Edges (src, dst, n) between consecutive k-mers, from the counts of (k+1)-mers; with ``least`` only between k-mers
    that occur so often."""
    if least <= 1:
        found = kmers(seqs, k + 1).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
        return found.select(F.left("kmer", F.lit(k)).alias("src"), F.right("kmer", F.lit(k)).alias("dst"), "n")
    counts = cut(tally.tally(seqs, k, least))
    common = counts.where(F.length("mer") == k).select(F.col("mer").alias("dst"))
    edges = counts.where(F.length("mer") > k).select(F.left("mer", F.lit(k)).alias("src"), F.right("mer", F.lit(k)).alias("dst"), "n")
    # what an edge leads to occurs as often as the edge; only of rarer edges it must be looked up
    return edges.where(F.col("n") >= least).union(edges.where(F.col("n") < least).join(common, "dst", "left_semi").select("src", "dst", "n"))


def frequent_edges(texts: DataFrame, k: int, least: int) -> DataFrame:
    """``de_bruijn(seqs, k, least)`` of the peptides in the one column of ``texts``, for k up to ``tally.LONGEST``: k-mers
    are numbers until the end."""
    counts = cut(tally.residues(texts, k, least))
    common = counts.where("src is null").select("dst")
    edges = counts.where("src is not null")
    found = edges.where(F.col("n") >= least).union(edges.where(F.col("n") < least).join(common, "dst", "left_semi").select("src", "dst", "n"))
    return tally.spelled(found, k, ("src", "dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(v, n_in, n_out)``."""
    ends = edges.select(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("v").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def roles(edges: DataFrame) -> DataFrame:
    """``(v, role)``: source, sink, junction or inner."""
    role = F.when(F.col("n_in") == 0, "source").when(F.col("n_out") == 0, "sink").when((F.col("n_in") > 1) | (F.col("n_out") > 1), "junction").otherwise("inner")
    return degrees(edges).select("v", role.alias("role"))


def trimmed(vertices: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Without vertices ``(v, n)`` below ``depth``, edges that touch them, and vertices left alone."""
    kept = vertices.where(F.col("n") >= depth)
    both = edges.join(kept.select(F.col("v").alias("src")), "src", "left_semi").join(kept.select(F.col("v").alias("dst")), "dst", "left_semi")
    touched = both.select(F.col("src").alias("v")).union(both.select("dst")).distinct()
    return kept.join(touched, "v", "left_semi"), both


def weak_branches(edges: DataFrame, share: float) -> DataFrame:
    """Edges that carry less than ``share`` of what leaves their source."""
    out = F.sum("n").over(Window.partitionBy("src"))
    return edges.withColumn("all", out).where(F.col("n") < share * F.col("all")).drop("all")


def tips_removed(edges: DataFrame, longest: int) -> DataFrame:
    """Without unbranched dead ends of fewer than ``longest`` edges that leave a junction, in both directions.

    A dead end is followed for at most ``longest`` steps, each a join; a path of that length is no tip and stays.
    """
    edges = cut(edges)  # read in each step
    deg = cut(degrees(edges))

    def ends(e: DataFrame, src: str, dst: str) -> DataFrame:
        n_src, n_dst = ("n_in", "n_out") if src == "src" else ("n_out", "n_in")
        # walk back from vertices with nothing beyond them
        walk = e.join(deg.where(F.col(n_dst) == 0).select(F.col("v").alias(dst)), dst, "left_semi").select(F.col(src).alias("at"), "src", "dst", F.lit(1).alias("steps"))
        tips, found = None, walk
        for i in range(1, longest):
            state = found.join(deg.withColumnRenamed("v", "at"), "at")
            # the walk has come to a junction: what it passed is a tip
            done = state.where((F.col(n_dst) > 1))
            part = done.select("src", "dst", "steps")
            tips = part if tips is None else tips.union(part)
            go = state.where((F.col(n_dst) == 1) & (F.col(n_src) == 1)).select(F.col("at").alias(dst))
            if i + 1 < longest:
                found = cut(e.join(go.distinct(), dst, "left_semi").select(F.col(src).alias("at"), "src", "dst", F.lit(i + 1).alias("steps")))
        return tips

    drop = ends(edges, "src", "dst").union(ends(edges, "dst", "src")).select("src", "dst").distinct()
    return edges.join(drop, ["src", "dst"], "left_anti")


def unitigs(edges: DataFrame) -> DataFrame:
    """Unbranched paths of a k-mer graph as sequences: ``(seq, n_edges)``.

    An edge goes on in the next if the vertex between them has one way in and one way out.  Pointers towards the last edge
    of a path are doubled each round, so a path of m edges takes log2(m) joins; rounds end when no more edges have
    arrived.  Closed circles have no last edge, never arrive, and are left out.
    """
    e = cut(edges.select("src", "dst")).withColumn("id", F.xxhash64("src", "dst"))  # ids would not compress
    through = degrees(e).where("n_in = 1 and n_out = 1").select("v")
    step = e.join(through, F.col("dst") == F.col("v"), "left_semi").select("id", F.col("dst").alias("src")).join(e.select("src", F.col("id").alias("next")), "src")
    table = e.select("id").join(step.select("id", "next"), "id", "left").select("id", F.coalesce("next", "id").alias("far"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("next").isNull().alias("there"))

    def jump(t: DataFrame) -> DataFrame:
        ahead = t.select(F.col("id").alias("far"), F.col("far").alias("beyond"), F.col("hops").alias("more"), F.col("there").alias("over"))
        # what has arrived stays as it is, and is only looked up
        gone = t.where("not there").drop("there").join(ahead, "far").select("id", F.col("beyond").alias("far"), F.try_add("hops", "more").alias("hops"), F.col("over").alias("there"))
        return gone.union(t.where("there"))

    done = until_stable(table, jump, lambda t: tuple(t.agg(F.count_if("there")).first()), 60)
    # a path is known by its last edge; order along it by hops still to go
    ends = done.where("there").join(e, "id").select("far", "src", "dst", "hops")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), "src", F.right("dst", F.lit(1)).alias("last"))))
    paths = ends.groupBy("far").agg(rows.alias("p"))
    return paths.select(F.concat(F.col("p")[0]["src"], F.array_join(F.transform("p", lambda x: x["last"]), "")).alias("seq"), F.size("p").cast("long").alias("n_edges"))


def bridged(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """Bridge edges replaced by every way in joined with every way out: (src, dst, n), n the least of the three."""
    b = bridges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("n").alias("bn"))
    into, out = edges.select(F.col("src").alias("p"), F.col("dst").alias("x"), F.col("n").alias("pn")), edges.select(F.col("src").alias("y"), F.col("dst").alias("s"), F.col("n").alias("sn"))
    made = into.join(b, "x").join(out, "y").where("p <> s").select(F.col("p").alias("src"), F.col("s").alias("dst"), F.least("pn", "bn", "sn").alias("n"))
    return edges.join(bridges, ["src", "dst"], "left_anti").unionByName(made)


def reachable(edges: DataFrame, seeds: DataFrame, steps: int, most_out: int) -> DataFrame:
    """``(v, step)``: vertices within ``steps`` of ``seeds(v)``, not going on from those with ``most_out`` ways or more."""
    hubs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= most_out).select("src")
    usable = edges.join(hubs, "src", "left_anti").select("src", "dst")
    found = seeds.select("v", F.lit(0).alias("step")).distinct()
    edge = found
    for i in range(1, steps + 1):
        new = edge.select(F.col("v").alias("src")).join(usable, "src").select(F.col("dst").alias("v")).distinct()
        edge = new.join(found.select("v"), "v", "left_anti").withColumn("step", F.lit(i))
        found = cut(found.union(edge)) if i % 3 == 0 else found.union(edge)
    return found


def spanning_forest(edges: DataFrame, least: int = 1) -> DataFrame:
    """Maximum spanning forest of undirected ``(source, target, n)`` by Boruvka rounds: each component takes its heaviest
    edge out (ties to the smaller edge), components merge, until none has one."""
    pool = cut(edges.where(F.col("n") >= least).select("source", "target", "n"))
    label = cut(pool.select(F.col("source").alias("v")).union(pool.select("target")).distinct().withColumn("c", F.col("v")))
    chosen = None
    for _ in range(40):
        own = pool.join(label.select(F.col("v").alias("source"), F.col("c").alias("a")), "source").join(label.select(F.col("v").alias("target"), F.col("c").alias("b")), "target").where("a <> b")
        both = own.select("a", "source", "target", "n").union(own.select("b", "source", "target", "n"))
        best = both.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("m"), "source", "target")).alias("e")).select("a", F.col("e.source").alias("source"), F.col("e.target").alias("target"), (-F.col("e.m")).alias("n"))
        new = cut(best.select("source", "target", "n").distinct())
        if new.isEmpty():
            break
        chosen = new if chosen is None else chosen.union(new)
        merged = components(new.join(label.select(F.col("v").alias("source"), F.col("c").alias("a")), "source").join(label.select(F.col("v").alias("target"), F.col("c").alias("b")), "target").select(F.col("a").alias("source"), F.col("b").alias("target")))
        label = cut(label.join(merged.select(F.col("v").alias("c"), F.col("component").alias("m")), "c", "left").select("v", F.coalesce("m", "c").alias("c")))
    return chosen.distinct() if chosen is not None else pool.limit(0)


def components(edges: DataFrame) -> DataFrame:
    """``(v, component)``: the smallest vertex reachable, by minimum labels with a shortcut each round."""
    edges = cut(forest(edges))
    both = cut(edges.select(F.col("source").alias("v"), F.col("target").alias("u")).union(edges.select("target", "source")).distinct())
    discard(edges)
    start = both.select("v").distinct().withColumn("component", F.col("v"))

    def step(s: DataFrame) -> DataFrame:
        near = both.join(s.select(F.col("v").alias("u"), F.col("component").alias("c")), "u").groupBy("v").agg(F.min("c").alias("c"))
        low = s.join(near, "v").select("v", F.least("component", "c").alias("component"))
        root = low.select(F.col("v").alias("r"), F.col("component").alias("rc"))
        return low.join(root, F.col("component") == F.col("r")).select("v", F.least("component", "rc").alias("component"))

    return until_stable(start, step, lambda s: tuple(s.agg(F.bit_xor(F.xxhash64("v", "component"))).first()))


# --- association networks -----------------------------------------------------------------------------------------------
def aligned(edges: DataFrame, networks: list[str]) -> DataFrame:
    """Edges ``(network, source, target, weight)`` with one weight column a network, over undirected edges."""
    e = edges.select("network", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")
    return e.groupBy("source", "target").pivot("network", networks).agg(F.first("weight"))


def edge_shares(edges: DataFrame) -> DataFrame:
    """Per network: edges, the share found in no other, the share found in one other or more."""
    e = edges.select("network", "source", "target").distinct()
    spread = e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("k"))
    x = e.join(spread, ["source", "target"])
    return x.groupBy("network").agg(F.count(F.lit(1)).alias("edges"), F.avg((F.col("k") == 1).cast("double")).alias("unique"), F.avg((F.col("k") > 1).cast("double")).alias("shared"))


def shared_edges(edges: DataFrame) -> DataFrame:
    """``(a, b, share)``: edges of a that b has too, as a share of a's."""
    e = edges.select("network", "source", "target").distinct()
    pairs = e.withColumnRenamed("network", "a").join(e.withColumnRenamed("network", "b"), ["source", "target"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = e.groupBy("network").agg(F.count(F.lit(1)).alias("t"))
    return pairs.join(total, F.col("a") == F.col("network")).select("a", "b", (F.col("n") / F.col("t")).alias("share"))


def node_statistics(edges: DataFrame) -> DataFrame:
    """``(v, degree, positive, negative, strength, triangles, clustering)`` of undirected weighted edges."""
    both = edges.select(F.col("source").alias("v"), F.col("target").alias("u"), "weight").union(edges.select("target", "source", "weight"))
    deg = both.groupBy("v").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("weight") > 0).alias("positive"), F.count_if(F.col("weight") < 0).alias("negative"), F.sum("weight").alias("strength"))
    tri = triangles(edges)
    corner = tri.select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("triangles"))
    k = F.col("degree")
    return deg.join(corner, "v", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0))).withColumn("clustering", F.when(k > 1, 2 * F.col("triangles") / (k * (k - 1))).otherwise(0.0))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """``(v, centrality)``: neighbours as a share of all other vertices."""
    both = edges.select(F.col("source").alias("v"), F.col("target").alias("u")).union(edges.select("target", "source")).where("v <> u").distinct()
    deg = both.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    return deg.join(F.broadcast(deg.agg(F.count(F.lit(1)).alias("n"))), F.lit(True)).select("v", (F.col("d") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))


def degree_statistics(edges: DataFrame, fractions: list[float] | None = None) -> DataFrame:
    """``(statistic, in_degree, out_degree)`` of a directed graph ``(src, dst)`` over all its vertices: average, least,
    greatest, and quantiles by index: deciles, percent from 91, tenths of a percent from 99."""
    from .evaluation import index_quantiles

    fractions = fractions or [i / 1000 for i in (*range(100, 901, 100), *range(910, 991, 10), *range(991, 1001))]
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("o")), e.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("i"))
    deg = cut(out.join(into, "v", "full_outer").select("v", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o")))
    whole = deg.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in "io" for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    rows = whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(f"{n}_i").alias("in_degree"), F.col(f"{n}_o").alias("out_degree")) for n in ("avg", "min", "max")])).alias("r")).select("r.*")
    parts = index_quantiles(deg, "i", fractions).join(index_quantiles(deg, "o", fractions), "fraction")
    return rows.unionByName(parts.select(F.concat(F.lit("quantile "), F.col("fraction").cast("string")).alias("statistic"), F.col("i").cast("double").alias("in_degree"), F.col("o").cast("double").alias("out_degree")))


def largest_component(edges: DataFrame) -> DataFrame:
    """One row ``(component, vertices)``: the component with most vertices, ties to the smaller."""
    sizes = components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))
    return sizes.orderBy(F.desc("vertices"), "component").limit(1)


def label_assortativity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman's assortativity of ``labels(v, label)`` over undirected edges between labelled vertices."""
    x, y = labels.select(F.col("v").alias("source"), F.col("label").alias("a")), labels.select(F.col("v").alias("target"), F.col("label").alias("b"))
    e = edges.select("source", "target").join(x, "source").join(y, "target")
    both = e.select("a", "b").union(e.select("b", "a"))
    m = both.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    ends = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(m), F.lit(True))
    shares = ends.agg(F.sum(F.col("n") / F.col("m") * F.col("n") / F.col("m")).alias("chance"), F.first(F.col("same") / F.col("m")).alias("found"))
    return shares.select(((F.col("found") - F.col("chance")) / (1 - F.col("chance"))).alias("assortativity"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c)``, a < b < c.  Each edge is led by its end of lower degree, so a hub leads few pairs."""
    e = edges.select("source", "target").distinct()
    deg = e.select(F.col("source").alias("v")).union(e.select("target")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    led = e.join(deg.select(F.col("v").alias("source"), F.col("d").alias("ds")), "source").join(deg.select(F.col("v").alias("target"), F.col("d").alias("dt")), "target")
    first = (F.col("ds") < F.col("dt")) | ((F.col("ds") == F.col("dt")) & (F.col("source") < F.col("target")))
    led = led.select(F.when(first, F.col("source")).otherwise(F.col("target")).alias("x"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("y"))
    wedges = led.alias("p").join(led.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("x"), F.col("p.y").alias("source"), F.col("q.y").alias("target"))
    found = wedges.join(e, ["source", "target"], "left_semi")
    return found.select(F.array_sort(F.array("x", "source", "target")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def cliques(edges: DataFrame, size: int) -> DataFrame:
    """Cliques of ``size`` vertices, ascending, as arrays ``members``; each component is listed by its tasks, so only edges
    are shuffled."""
    kind = edges.schema["source"].dataType.simpleString()
    names = [f"m{i}" for i in range(size)]

    def work(graph, sources):
        for rows in graph.cliques(size, sources):
            yield [graph.ids[rows[:, i]] for i in range(size)]

    edges = cut(edges.select("source", "target"))
    found = by_component(edges, components(edges), work, ", ".join(f"{n} {kind}" for n in names), size - 1)
    return found.select(F.array(*names).alias("members"))


def distances(edges: DataFrame) -> DataFrame:
    """``(a, b, d)``: hops between all connected pairs, both ways; as many rows as that.  See ``walk_sums`` for sums."""
    kind = edges.schema["source"].dataType.simpleString()

    def work(graph, sources):
        for s in sources:
            for d, (front, *_) in enumerate(graph.levels(s)):
                if d:
                    yield [graph.ids[np.full(len(front), s)], graph.ids[front], np.full(len(front), d, np.int32)]

    edges = cut(edges.select("source", "target"))
    return by_component(edges, components(edges), work, f"a {kind}, b {kind}, d int")


def walk_sums(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(v, degree, triangles, reached, hops, harmonic)``: of each vertex its neighbours, triangles, the vertices within
    reach, the sum of hops to them and of 1 / hops.  ``labels`` as ``components`` gives them."""
    kind = edges.schema["source"].dataType.simpleString()

    def work(graph, sources):
        yield [graph.ids[sources], *graph.all_sums(sources)]

    return by_component(edges, labels, work, f"v {kind}, degree long, triangles long, reached long, hops long, harmonic double")


def global_properties(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, density, components, mean path length, transitivity, degree assortativity."""
    edges = cut(edges.select("source", "target"))
    labels = components(edges)
    stats = cut(walk_sums(edges, labels))
    k = F.col("degree")
    base = stats.agg(F.count(F.lit(1)).alias("vertices"), (F.sum("degree") / 2).cast("long").alias("edges"), (F.sum("triangles") / F.sum(k * (k - 1) / 2)).alias("transitivity"), (F.sum("hops") / F.sum("reached")).alias("mean_path"))
    base = base.withColumn("density", 2 * F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1)))
    parts = labels.agg(F.count_distinct("component").alias("components"))
    d = stats.select("v", "degree")
    both = edges.select("source", "target").union(edges.select("target", "source"))
    mix = both.join(d.select(F.col("v").alias("source"), F.col("degree").alias("x")), "source").join(d.select(F.col("v").alias("target"), F.col("degree").alias("y")), "target").agg(F.corr("x", "y").alias("assortativity"))
    return base.join(parts, F.lit(True)).join(mix, F.lit(True))


def harmonic(edges: DataFrame) -> DataFrame:
    """``(v, harmonic)``: sum of 1 / distance to all others."""
    edges = cut(edges.select("source", "target"))
    return walk_sums(edges, components(edges)).select("v", "harmonic")


def betweenness(edges: DataFrame) -> DataFrame:
    """``(v, betweenness)`` by Brandes' sums, as a share of the (n - 1)(n - 2) / 2 pairs of other vertices, n those of the
    whole network."""
    kind = edges.schema["source"].dataType.simpleString()

    def work(graph, sources):
        yield [graph.ids, graph.all_dependencies(sources)]

    edges = cut(edges.select("source", "target"))
    labels = components(edges)
    sums = by_component(edges, labels, work, f"v {kind}, part double", 2).groupBy("v").agg((F.sum("part") / 2).alias("b"))
    n = labels.count()
    pairs = float((n - 1) * (n - 2) / 2) or 1.0
    return labels.select("v").join(sums, "v", "left").select("v", (F.coalesce("b", F.lit(0.0)) / pairs).alias("betweenness"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``(v, community)``: all vertices at once take the commonest label around them and their own, ties to the smallest."""
    both = edges.select(F.col("source").alias("v"), F.col("target").alias("u")).union(edges.select("target", "source")).distinct()
    own = both.select("v").distinct()
    both = cut(both.union(own.select("v", F.col("v").alias("u"))))
    label = own.withColumn("community", F.col("v"))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("v").alias("u"), "community"), "u").groupBy("v", "community").agg(F.count(F.lit(1)).alias("n"))
        new = cut(votes.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("m"), "community")).alias("x")).select("v", F.col("x.community").alias("community")))
        if new.join(label, ["v", "community"], "left_anti").isEmpty():
            break
        label = new
    return label


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: Newman's modularity of a partition ``(v, community)``."""
    e = edges.select("source", "target").join(communities.select(F.col("v").alias("source"), F.col("community").alias("a")), "source").join(communities.select(F.col("v").alias("target"), F.col("community").alias("b")), "target")
    ends = e.select(F.explode(F.array("a", "b")).alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("d"))
    inside = e.where("a = b").groupBy(F.col("a").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    m = e.agg(F.count(F.lit(1)).alias("m"))
    return ends.join(inside, "community", "left").join(F.broadcast(m), F.lit(True)).agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) * (F.col("d") / (2 * F.col("m")))).alias("modularity"))


def module_leaders(edges: DataFrame, communities: DataFrame, values: DataFrame) -> DataFrame:
    """``(community, v, degree)``: in each community of three vertices or more, the vertex with most edges inside it;
    ties go to the larger ``value`` of ``values(v, value)``, then to the smaller vertex."""
    large = communities.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("community")
    own = communities.join(large, "community")
    ends = own.select(F.col("v").alias("source"), F.col("community").alias("a")), own.select(F.col("v").alias("target"), F.col("community").alias("b"))
    inside = edges.select("source", "target").join(ends[0], "source").join(ends[1], "target").where("a = b")
    degree = inside.select(F.explode(F.array("source", "target")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"))
    rows = own.join(degree, "v", "left").join(values.select("v", "value"), "v", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), F.desc_nulls_last("value"), "v"))
    return rows.withColumn("rank", rank).where("rank = 1").select("community", "v", "degree")


def random_graphs(spark: SparkSession, graphs: int, vertices: int, p: float, seed: int) -> DataFrame:
    """Erdos-Renyi graphs (g, source, target): a pair is an edge where a hash of graph, pair and seed falls below p."""
    pairs = spark.range(graphs).withColumnRenamed("id", "g").withColumn("source", F.explode(F.sequence(F.lit(0), F.lit(vertices - 2)))).withColumn("target", F.explode(F.sequence(F.col("source") + 1, F.lit(vertices - 1))))
    return pairs.where(F.pmod(F.xxhash64("g", "source", "target", F.lit(seed)), F.lit(1 << 30)) < int(p * (1 << 30)))


def partial_correlations(precision: DataFrame) -> DataFrame:
    """``(i, j, r)`` from a precision matrix ``(i, j, w)``: symmetrised, -w_ij / sqrt(w_ii w_jj); the diagonal is -1."""
    back = precision.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("back"))
    sym = precision.join(back, ["i", "j"], "left").withColumn("w", (F.col("w") + F.coalesce("back", "w")) / 2)
    diag = precision.where("i = j").select("i", "w")
    return sym.join(diag.select("i", F.col("w").alias("wi")), "i").join(diag.select(F.col("i").alias("j"), F.col("w").alias("wj")), "j").select("i", "j", (-F.col("w") / F.sqrt(F.col("wi") * F.col("wj"))).alias("r"))


def significant(correlations: DataFrame, n: int, controls: int, z: float = 1.959963984540054) -> DataFrame:
    """Partial correlations whose Fisher-z interval leaves out 0."""
    width = z / (n - controls - 3) ** 0.5
    r = correlations.where("i < j and abs(r) < 1").withColumn("low", F.tanh(F.atanh("r") - width)).withColumn("high", F.tanh(F.atanh("r") + width))
    return r.where("low > 0 or high < 0")


def supported(replicates: DataFrame, total: int, least: float) -> DataFrame:
    """Edges found in at least ``least`` of ``total`` replicates ``(replicate, source, target)``."""
    n = replicates.distinct().groupBy("source", "target").agg((F.count(F.lit(1)) / total).alias("support"))
    return n.where(F.col("support") >= least)


def lineage_classes(edges: DataFrame, taxonomy: DataFrame, ranks: list[str]) -> DataFrame:
    """``(sign, rank, n)``: edges by sign and the lowest rank (first in ``ranks``) that both ends share."""
    x = taxonomy.select(F.col("v").alias("source"), *[F.col(r).alias(f"x_{r}") for r in ranks])
    y = taxonomy.select(F.col("v").alias("target"), *[F.col(r).alias(f"y_{r}") for r in ranks])
    rank = F.lit("none")
    for r in reversed(ranks):
        rank = F.when(F.col(f"x_{r}") == F.col(f"y_{r}"), F.lit(r)).otherwise(rank)
    sign = F.when(F.col("weight") > 0, "positive").otherwise("negative")
    return edges.join(x, "source").join(y, "target").groupBy(sign.alias("sign"), rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def listed_degree(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """``(listed, degree, weight)``: mean degree of vertices in and out of a list ``(v)``, and the mean weight of all their
    edges together (an edge counts once for each end)."""
    both = edges.select(F.col("source").alias("v"), "weight").union(edges.select("target", "weight")).groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.sum("weight").alias("w"))
    flag = both.join(listed.select("v").distinct().withColumn("in", F.lit(True)), "v", "left").withColumn("listed", F.coalesce("in", F.lit(False)))
    return flag.groupBy("listed").agg(F.avg("d").alias("degree"), (F.sum("w") / F.sum("d")).alias("weight"))


def edge_distances(edges: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(source, target, distance)``: Bray-Curtis of the end vertices' profiles ``(v, feature, value)``, on edges only."""
    total = profiles.groupBy("v").agg(F.sum("value").alias("t"))
    x, y = profiles.select(F.col("v").alias("source"), "feature", F.col("value").alias("a")), profiles.select(F.col("v").alias("target"), "feature", F.col("value").alias("b"))
    common = edges.select("source", "target").join(x, "source").join(y, ["target", "feature"]).groupBy("source", "target").agg(F.sum(F.least("a", "b")).alias("c"))
    out = edges.select("source", "target").join(total.select(F.col("v").alias("source"), F.col("t").alias("ta")), "source").join(total.select(F.col("v").alias("target"), F.col("t").alias("tb")), "target").join(common, ["source", "target"], "left")
    return out.select("source", "target", ((F.col("ta") + F.col("tb") - 2 * F.coalesce("c", F.lit(0.0))) / (F.col("ta") + F.col("tb"))).alias("distance"))
