"""Queries for suffix order, spectra arithmetic, summaries, directed degrees and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.register import register
from ..operators import community as com, evaluation as ev, kmers, network as net, suffixes
from .base import MEETINGS, PEPTIDES, TARGETS, network, peptides, query, r6, sql_kmers, table, targets

_SUFFIXES = f"{TARGETS}, s AS (SELECT rid, pos, substr(seq, pos) AS suffix FROM (SELECT rid, seq, unnest(range(1, length(seq) + 1)) AS pos FROM targets)), o AS (SELECT rid, pos, suffix, row_number() OVER (ORDER BY suffix, rid, pos) - 1 AS rank, lag(suffix) OVER (ORDER BY suffix, rid, pos) AS front FROM s)"
_LCP = "CASE WHEN front IS NULL THEN 0 ELSE coalesce(nullif(list_position(list_transform(range(1, least(length(suffix), length(front)) + 1), lambda i: substr(suffix, i, 1) = substr(front, i, 1)), false), 0) - 1, least(length(suffix), length(front))) END"


@query(f"WITH {_SUFFIXES} SELECT rid, pos, rank, length(suffix) AS length, CAST({_LCP} AS BIGINT) AS lcp FROM o")
def suffix_order(spark, sf):
    t = targets(spark, sf)
    return suffixes.common_prefixes(suffixes.suffix_order(t), t)


@query(f"WITH {_SUFFIXES}, n AS (SELECT *, lead(suffix) OVER (ORDER BY rank) AS after FROM o) SELECT rid, pos, rank, length(suffix) AS length, row_number() OVER (ORDER BY rank) - 1 AS block FROM n WHERE after IS NULL OR NOT starts_with(after, suffix)")
def suffix_block_ends(spark, sf):
    t = targets(spark, sf)
    return suffixes.block_ends(suffixes.common_prefixes(suffixes.suffix_order(t), t))


_WORDS = "words AS (SELECT DISTINCT left(seq, CAST(6 + rid % 4 AS INTEGER)) AS word FROM targets)"


@query(f"WITH {PEPTIDES}, {TARGETS}, {_WORDS}, {', '.join(sql_kmers(k, 'reads', f'k{k}') for k in (6, 7, 8, 9))} SELECT word, rid, pos FROM words JOIN ({' UNION ALL '.join(f'SELECT * FROM k{k}' for k in (6, 7, 8, 9))}) ON kmer = word")
def prefix_search(spark, sf):
    words = targets(spark, sf).select(F.left("seq", (6 + F.col("rid") % 4).cast("int")).alias("word"))
    return suffixes.prefix_search(words, peptides(spark, sf))


_TWO = f"{PEPTIDES}, {TARGETS}, {sql_kmers(3)}, {sql_kmers(3, 'targets', 'tk')}, a AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer), b AS (SELECT kmer, count(*) AS n FROM tk GROUP BY kmer)"


@query(f"WITH {_TWO} SELECT 'add' AS how, kmer, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b USING (kmer) UNION ALL SELECT 'subtract', kmer, a.n - coalesce(b.n, 0) FROM a LEFT JOIN b USING (kmer) WHERE a.n > coalesce(b.n, 0) UNION ALL SELECT 'set', kmer, coalesce(b.n, a.n) FROM a FULL JOIN b USING (kmer)")
def spectrum_arithmetic(spark, sf):
    a, b = kmers.spectrum(peptides(spark, sf), 3), kmers.spectrum(targets(spark, sf), 3)
    parts = [f(a, b).select(F.lit(name).alias("how"), "kmer", "n") for name, f in (("add", kmers.add_counts), ("subtract", kmers.subtract_counts), ("set", kmers.set_counts))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TENTHS = [i / 10 for i in range(1, 10)]


@query(f"WITH {PEPTIDES}, l AS (SELECT list_sort(list(length(seq))) AS v, avg(length(seq)) AS mean FROM reads) SELECT unnest(['n', 'min', 'max', 'mean', 'median', {', '.join(f"'decile {i}'" for i in range(1, 10))}]) AS statistic, round(unnest([CAST(len(v) AS DOUBLE), v[1], v[-1], mean, v[len(v) // 2 + 1], {', '.join(f'v[CAST(greatest(floor(len(v) * {f}) - 1, 0) AS BIGINT) + 1]' for f in _TENTHS)}]), 6) AS value FROM l")
def length_summary(spark, sf):
    return ev.summary(peptides(spark, sf).select(F.length("seq").alias("length")), "length").select("statistic", r6(F.col("value"), "value"))


@query("WITH u AS (SELECT p_partkey AS k, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AS t, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1) AS c FROM part) SELECT count(*) FILTER (t AND c) AS tp, count(*) FILTER (NOT t AND c) AS fp, count(*) FILTER (t AND NOT c) AS fn, count(*) FILTER (NOT t AND NOT c) AS tn FROM u")
def confusion_within(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_quantity", "l_discount")
    return ev.confusion_within(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), lines.where("l_returnflag = 'R' and l_quantity > 45"), lines.where("l_discount >= 0.1"), "k")


@query("WITH l AS (SELECT l_suppkey || '||' || l_linenumber AS key, l_returnflag AS s, max_by(l_quantity, l_orderkey) AS n FROM lineitem GROUP BY ALL) SELECT key, coalesce(max(n) FILTER (s = 'A'), 0.0) AS A, coalesce(max(n) FILTER (s = 'N'), 0.0) AS N, coalesce(max(n) FILTER (s = 'R'), 0.0) AS R FROM l GROUP BY key")
def last_value_table(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_suppkey").alias("taxon"), F.col("l_linenumber").alias("gene"), F.col("l_orderkey").alias("line"), F.col("l_quantity").alias("n"))
    return com.last_values(rows, ["A", "N", "R"])


_PARTS = [i / 1000 for i in (*range(100, 901, 100), *range(910, 991, 10), *range(991, 1001))]
_AT = lambda v: ", ".join(f"{v}[CAST(greatest(floor(len({v}) * {f}) - 1, 0) AS BIGINT) + 1]" for f in _PARTS)


@query(f"WITH {TARGETS}, {sql_kmers(5, 'targets')}, e AS (SELECT DISTINCT substr(kmer, 1, 4) AS src, substr(kmer, 2, 4) AS dst FROM kmers), v AS (SELECT src AS v FROM e UNION SELECT dst FROM e), d AS (SELECT coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM v LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY dst) x ON x.dst = v.v LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY src) y ON y.src = v.v), l AS (SELECT list_sort(list(i)) AS i, list_sort(list(o)) AS o, avg(i) AS ai, avg(o) AS ao FROM d) SELECT unnest(['avg', 'min', 'max', {', '.join(f"'quantile {f}'" for f in _PARTS)}]) AS statistic, round(CAST(unnest([ai, i[1], i[-1], {_AT('i')}]) AS DOUBLE), 6) AS in_degree, round(CAST(unnest([ao, o[1], o[-1], {_AT('o')}]) AS DOUBLE), 6) AS out_degree FROM l")
def degree_statistics(spark, sf):
    found = net.degree_statistics(net.de_bruijn(targets(spark, sf), 4), _PARTS)
    return found.select("statistic", r6(F.col("in_degree"), "in_degree"), r6(F.col("out_degree"), "out_degree"))


@query(f"WITH {MEETINGS}, b AS (SELECT source AS v FROM edges UNION ALL SELECT target FROM edges) SELECT v, round(count(*) / ((SELECT count(DISTINCT v) FROM b) - 1), 6) AS centrality FROM b GROUP BY v")
def degree_centrality(spark, sf):
    return net.degree_centrality(network(spark, sf)).select("v", r6(F.col("centrality"), "centrality"))


@query(f"WITH {MEETINGS}, b AS (SELECT x.s_nationkey AS a, y.s_nationkey AS b FROM edges JOIN supplier x ON x.s_suppkey = source JOIN supplier y ON y.s_suppkey = target), e AS (SELECT a, b FROM b UNION ALL SELECT b, a FROM b), c AS (SELECT sum(n * n) / (SELECT count(*) * count(*) FROM e) AS chance FROM (SELECT count(*) AS n FROM e GROUP BY a)) SELECT round(((SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) FROM e) - chance) / (1 - chance), 6) AS assortativity FROM c")
def label_assortativity(spark, sf):
    labels = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_nationkey").alias("label"))
    return net.label_assortativity(network(spark, sf), labels).select(r6(F.col("assortativity"), "assortativity"))


@query()
def welch_tests(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')")
    return com.welch_tests(lines.select(F.col("l_suppkey").alias("feature"), (F.col("l_returnflag") == "R").cast("int").alias("grp"), F.col("l_quantity").alias("value")))


@query(f"WITH {PEPTIDES} SELECT rid, length(seq) AS n, round((0.267 * length(seq) - ln(0.041)) / ln(2), 6) AS bits FROM reads")
def sql_functions(spark, sf):
    register(spark)
    return table(spark, sf, "documents").selectExpr("doc_id AS rid", "cast(length(cf_peptide(text)) AS bigint) AS n", "round(cf_bit_score(length(cf_peptide(text)), 0.267, 0.041), 6) AS bits")
