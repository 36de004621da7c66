"""Queries for lookups, filters, reports and small graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alphabet
from ..operators import alignment, assembly, kmers, network as net
from ..sources import readers, sinks
from ..streaming import windows
from .base import NETWORKS, PEPTIDES, networks, peptides, query, r6, sql_kmers, table

_PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
_CODE = f"CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(kmer, ''), lambda x: CAST(instr('{alphabet.CODES}', x) - 1 AS BIGINT))), lambda a, b: a * 32 + b) AS BIGINT)"


@query(f"WITH {PEPTIDES}, {sql_kmers(5)}, c AS (SELECT DISTINCT rid, kmer FROM kmers), k AS (SELECT kmer, {_CODE} AS code FROM (SELECT DISTINCT kmer FROM c)), t AS (SELECT unnest(range(0, 8)) AS i, unnest({list(_PRIMES)}) AS p), b AS (SELECT DISTINCT rid, i, code % p AS bit FROM c JOIN k USING (kmer), t) SELECT rid, CAST(i AS INTEGER) AS \"table\", count(*) AS bits, CAST(sum(bit) AS BIGINT) AS total FROM b GROUP BY rid, i")
def bloom_filters(spark, sf):
    bits = kmers.bloom_bits(peptides(spark, sf), 5, _PRIMES)
    return bits.groupBy("rid", "table").agg(F.count(F.lit(1)).alias("bits"), F.sum("bit").alias("total"))


_EDGES = f"{PEPTIDES}, {sql_kmers(11)}, e AS (SELECT substr(kmer, 1, 10) AS src, substr(kmer, 2, 10) AS dst, count(*) AS n FROM kmers GROUP BY ALL)"


@query(f"WITH {_EDGES}, s AS (SELECT *, sum(n) OVER (PARTITION BY src) AS alls FROM e) SELECT src, dst, n FROM s WHERE n < 0.05 * alls")
def weak_branches(spark, sf):
    return net.weak_branches(net.de_bruijn(peptides(spark, sf), 10), 0.05)


@query(f"WITH {_EDGES}, {sql_kmers(10, 'reads', 'k10')}, v AS (SELECT kmer AS v, count(*) AS n FROM k10 GROUP BY kmer HAVING count(*) >= 20), b AS (SELECT src, dst FROM e WHERE src IN (SELECT v FROM v) AND dst IN (SELECT v FROM v)) SELECT v, n FROM v WHERE v IN (SELECT src FROM b UNION SELECT dst FROM b)")
def trimmed_vertices(spark, sf):
    reads = peptides(spark, sf)
    return net.trimmed(kmers.spectrum(reads, 10).withColumnRenamed("kmer", "v"), net.de_bruijn(reads, 10), 20)[0]


@query()
def tips_removed(spark, sf):
    return net.tips_removed(net.de_bruijn(peptides(spark, sf), 12, 3), 4)


_W = "w AS (SELECT l_linenumber AS i, l_suppkey % 7 + 1 AS j, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), s AS (SELECT a.i, a.j, (a.w + coalesce(b.w, a.w)) / 2 AS w FROM w a LEFT JOIN w b ON a.i = b.j AND a.j = b.i), p AS (SELECT s.i, s.j, -s.w / sqrt(x.w * y.w) AS r FROM s JOIN w x ON x.i = s.i AND x.j = s.i JOIN w y ON y.i = s.j AND y.j = s.j)"


def _correlations(spark, sf):
    w = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("i"), (F.col("l_suppkey") % 7 + 1).alias("j")).agg(F.sum("l_quantity").alias("w"))
    return net.partial_correlations(w)


@query(f"WITH {_W} SELECT CAST(i AS BIGINT) AS i, j, round(r, 6) AS r FROM p")
def partial_correlations(spark, sf):
    return _correlations(spark, sf).withColumn("r", F.round("r", 6))


@query(f"WITH {_W} SELECT CAST(i AS BIGINT) AS i, j, round(r, 6) AS r FROM p WHERE i < j AND abs(r) < 1 AND (tanh(atanh(r) - 1.959963984540054 / sqrt(92.0)) > 0 OR tanh(atanh(r) + 1.959963984540054 / sqrt(92.0)) < 0)")
def significant_correlations(spark, sf):
    return net.significant(_correlations(spark, sf), 100, 5).select("i", "j", r6(F.col("r"), "r"))


@query(f"WITH {NETWORKS} SELECT source, target, round(count(DISTINCT network) / 3.0, 6) AS support FROM edges GROUP BY ALL HAVING count(DISTINCT network) / 3.0 >= 0.6")
def supported_edges(spark, sf):
    return net.supported(networks(spark, sf).select(F.col("network").alias("replicate"), "source", "target"), 3, 0.6).withColumn("support", F.round("support", 6))


@query("SELECT doc_id, md5(CASE WHEN strpos(t, '*') > 0 AND strpos(t, '*') < length(t) THEN split_part(t, '*', 1) ELSE t END) AS digest FROM (SELECT doc_id, replace(replace(text, '-', ''), 'z', '*') AS t FROM documents)")
def assembled_sequences(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("z"), F.lit("*")).alias("seq"))
    return sinks.assembled(docs).select("doc_id", F.md5("seq").alias("digest"))


@query("SELECT 'q' || l_orderkey || '||contig_' || l_linenumber || '::' || l_suppkey || '-' || l_partkey AS header FROM lineitem")
def contig_headers(spark, sf):
    text = lambda c: F.col(c)
    full = sinks.contig_header(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")), text("l_linenumber"), text("l_suppkey"), text("l_partkey"), F.lit(1), F.lit(2), F.lit(3))
    return table(spark, sf, "lineitem").select(F.regexp_replace(full, "::1::2::3$", "").alias("header"))


@query("SELECT 'r' || a.l_orderkey AS name, a.l_partkey AS first, b.l_partkey AS second FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey HAVING count(*) = 2)")
def paired_reads(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_linenumber <= 2")
    once = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("l_orderkey")
    named = lines.join(once, "l_orderkey").select(F.col("l_partkey").alias("rid"), F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("header"))
    return kmers.pair_mates(named)


@query("SELECT 's' || s_suppkey AS contig, 'n' || s_nationkey AS genome, dense_rank() OVER (ORDER BY 'n' || s_nationkey) AS genome_index FROM supplier")
def contig_genome_map(spark, sf):
    line = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(" "), F.lit("n"), F.col("s_nationkey").cast("string"))
    return readers.id_map(table(spark, sf, "supplier").select(line.alias("value")))


@query("SELECT 's' || s_suppkey AS contig, 1000 + 10 * s_suppkey AS length FROM supplier")
def sam_contig_lengths(spark, sf):
    line = F.concat(F.lit("@SQ\tSN:s"), F.col("s_suppkey").cast("string"), F.lit("\tLN:"), (1000 + 10 * F.col("s_suppkey")).cast("string"))
    return readers.sam_headers(table(spark, sf, "supplier").select(line.alias("value")))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def edit_distances(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_size", F.col("p_name").alias("text"), F.col("p_partkey").alias("id"))
    return alignment.edits_within(p, ["p_brand", "p_size"]).select("a", "b", "distance")


@query("SELECT l_suppkey AS rid, min(l_extendedprice) AS e_value FROM lineitem WHERE l_quantity + l_discount * 100 >= 45 GROUP BY l_suppkey")
def reconciled_reads(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("rid"), F.col("l_quantity").alias("score"), (F.col("l_discount") * 100).alias("opposite"), F.col("l_extendedprice").alias("e_value"))
    return assembly.reconciled(hits, 45)


@query("SELECT count(DISTINCT l_orderkey) AS reads FROM lineitem WHERE l_returnflag <> 'N'")
def distinct_reads(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag <> 'N'").agg(F.count_distinct("l_orderkey").alias("reads"))


@query("SELECT l_partkey, round(sum(l_extendedprice), 2) AS importance FROM lineitem GROUP BY l_partkey ORDER BY importance DESC, l_partkey LIMIT 20")
def top_features(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("importance")).orderBy(F.desc("importance"), "l_partkey").limit(20)


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 > 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def taxon_lookup(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 3 > 0")
    out = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def unmapped_reads(spark, sf):
    mapped = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(mapped, "c_custkey", "left_anti")


@query("SELECT c_nationkey AS taxon, o_orderpriority AS gene, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def recruited_by_taxon_gene(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("taxon"), F.col("o_orderpriority").alias("gene")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "30 minutes", "1 hour", "user_id")
