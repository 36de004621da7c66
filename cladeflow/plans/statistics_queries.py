"""Queries over hits, communities, networks and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import abundance, community as com, evaluation as ev, models, network as net
from ..streaming import windows
from .base import BOTH, COMMUNITY, HITS, MEETINGS, NETWORKS, PEPTIDES, community, contigs, hits, lengths, network, networks, peptides, places, query, r6, sql_kmers, table

_NORM = "SELECT genome, round(share / length / sum(share / length) OVER (), 6) AS abundance FROM s JOIN lengths USING (genome)"
_CELLS = "cells AS (SELECT read, genome, CAST(count(*) AS DOUBLE) AS a FROM hits GROUP BY ALL)"


def _em_sql(rounds: int, last: str) -> str:
    steps = ["p0 AS (SELECT genome, 1.0 / count(*) OVER () AS pi FROM (SELECT DISTINCT genome FROM cells))"]
    for i in range(rounds):
        steps.append(f"q{i} AS (SELECT read, genome, pi * a / sum(pi * a) OVER (PARTITION BY read) AS r FROM cells JOIN p{i} USING (genome)), p{i + 1} AS (SELECT genome, sum(r) / sum(sum(r)) OVER () AS pi FROM q{i} GROUP BY genome)")
    return f"WITH {HITS}, {_CELLS}, {', '.join(steps)} {last}"


# --- abundance ----------------------------------------------------------------------------------------------------------
@query(f"WITH {HITS} SELECT genome, length FROM lengths")
def genome_lengths(spark, sf):
    c = contigs(spark, sf)
    return abundance.genome_lengths(c.select("contig", "length"), c.select("contig", "genome"))


@query(f"WITH {HITS}, s AS (SELECT genome, sum(1.0 / n) AS share FROM hits JOIN (SELECT read, count(*) AS n FROM hits GROUP BY read) USING (read) GROUP BY genome) {_NORM}")
def even_split_abundance(spark, sf):
    return abundance.even_split(hits(spark, sf), lengths(spark, sf)).select("genome", r6(F.col("abundance"), "abundance"))


@query(f"WITH {HITS}, s AS (SELECT genome, CAST(count(*) AS DOUBLE) AS share FROM hits GROUP BY genome) {_NORM}")
def multiple_count_abundance(spark, sf):
    return abundance.multiple_count(hits(spark, sf), lengths(spark, sf)).select("genome", r6(F.col("abundance"), "abundance"))


@query(_em_sql(5, "SELECT genome, round(pi, 6) AS pi FROM p5"))
def em_mixing(spark, sf):
    return abundance.expectation_maximisation(hits(spark, sf), 5, 0.0).select("genome", r6(F.col("pi"), "pi"))


@query(_em_sql(5, ", s AS (SELECT genome, pi AS share FROM p5) " + _NORM))
def em_abundance(spark, sf):
    mixing = abundance.expectation_maximisation(hits(spark, sf), 5, 0.0)
    return abundance.normalised(mixing.withColumnRenamed("pi", "share"), lengths(spark, sf)).select("genome", r6(F.col("abundance"), "abundance"))


@query(_em_sql(3, "SELECT round(sum(ln(q)), 4) AS log_likelihood FROM (SELECT read, sum(pi * a) AS q FROM cells JOIN p3 USING (genome) GROUP BY read) WHERE q > 0"))
def em_log_likelihood(spark, sf):
    h = hits(spark, sf)
    return abundance.log_likelihood(abundance.patterns(h), abundance.expectation_maximisation(h, 3, 0.0)).select(F.round("log_likelihood", 4).alias("log_likelihood"))


@query(_em_sql(3, ", w AS (SELECT genome, round(pi, 9) AS pi FROM p3) SELECT read, genome FROM cells JOIN w USING (genome) QUALIFY row_number() OVER (PARTITION BY read ORDER BY pi * a DESC, genome) = 1"))
def read_assignments(spark, sf):
    h = hits(spark, sf)
    mixing = abundance.expectation_maximisation(h, 3, 0.0).select("genome", F.round("pi", 9).alias("pi"))
    return abundance.assignments(h, mixing)


@query()
def em_bootstrap_intervals(spark, sf):
    return abundance.percentile_interval(abundance.bootstrap(hits(spark, sf), lengths(spark, sf), 100, 0.3, 20, 1e-4))


# --- community ----------------------------------------------------------------------------------------------------------
@query(f"WITH {COMMUNITY} SELECT sample, taxon, round(value / sum(value) OVER (PARTITION BY sample), 6) AS share FROM community")
def relative_abundance(spark, sf):
    return com.relative(community(spark, sf)).select("sample", "taxon", r6(F.col("share"), "share"))


_FULL = "grid AS (SELECT s.cohort, s.sample, t.taxon, coalesce(c.value, 0.0) AS value FROM (SELECT DISTINCT cohort, sample FROM community) s CROSS JOIN (SELECT DISTINCT taxon FROM community) t LEFT JOIN community c ON c.sample = s.sample AND c.taxon = t.taxon)"


def _grid(spark, sf):
    """Community with zeros: samples and taxa are fixed lists of the design."""
    c = community(spark, sf)
    cells = c.select("cohort", "sample").distinct().join(F.broadcast(c.select("taxon").distinct()), F.lit(True))
    return cells.join(c.select("sample", "taxon", "value"), ["sample", "taxon"], "left").na.fill(0.0, ["value"])


@query(f"WITH {COMMUNITY}, {_FULL}, l AS (SELECT sample, taxon, ln(CASE WHEN value = 0 THEN 1e-10 ELSE value END) AS x FROM grid) SELECT sample, taxon, round(x - avg(x) OVER (PARTITION BY sample), 6) AS clr FROM l")
def clr_transform(spark, sf):
    return com.clr(_grid(spark, sf)).select("sample", "taxon", r6(F.col("clr"), "clr"))


@query(f"WITH {COMMUNITY}, {_FULL} SELECT cohort, taxon, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS prevalence, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean_present FROM grid GROUP BY ALL HAVING max(value) > 0")
def prevalence(spark, sf):
    return com.prevalence(_grid(spark, sf)).select("cohort", "taxon", r6(F.col("prevalence"), "prevalence"), r6(F.col("mean_present"), "mean_present"))


@query(f"WITH {COMMUNITY} SELECT sample, CAST(sum(CASE WHEN taxon < 'Brand#2' THEN value ELSE 0 END) AS DOUBLE) AS core FROM community GROUP BY sample")
def core_abundance(spark, sf):
    c = community(spark, sf)
    return com.core_abundance(c, c.where("taxon < 'Brand#2'"))


_RARE = "rare AS (SELECT r_name AS cohort, l_orderkey AS taxon FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL HAVING sum(l_quantity) > 0)"


def _rare(spark, sf):
    """Orders as taxa: their few lines lie in some regions and not in others."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("taxon"), "l_quantity").join(places(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy("cohort", "taxon").agg(F.sum("l_quantity").alias("value"))


@query(f"WITH {_RARE}, n AS (SELECT taxon, count(*) AS k FROM rare GROUP BY taxon) SELECT cohort, count(*) AS taxa, count(*) FILTER (k = 1) AS \"unique\", count(*) - count(*) FILTER (k = 1) AS shared FROM rare JOIN n USING (taxon) GROUP BY cohort")
def exclusive_taxa(spark, sf):
    return com.exclusive(_rare(spark, sf))


@query(f"WITH {_RARE} SELECT taxon FROM rare GROUP BY taxon HAVING count(*) = (SELECT count(DISTINCT cohort) FROM rare)")
def common_taxa(spark, sf):
    return com.common_taxa(_rare(spark, sf))


@query("WITH m AS (SELECT p_type AS species, p_brand AS strain, avg(p_retailprice) AS mean FROM part GROUP BY ALL) SELECT species, strain, round(CASE WHEN count(*) OVER (PARTITION BY species) = 1 THEN 1.0 ELSE mean / sum(mean) OVER (PARTITION BY species) END, 6) AS weight FROM m")
def strain_weights(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("species"), F.col("p_brand").alias("strain"), F.col("p_retailprice").alias("value"))
    return com.strain_weights(p).select("species", "strain", r6(F.col("weight"), "weight"))


@query("WITH m AS (SELECT p_type AS species, p_brand AS strain, avg(p_retailprice) AS mean FROM part GROUP BY ALL), w AS (SELECT species, strain, CASE WHEN count(*) OVER (PARTITION BY species) = 1 THEN 1.0 ELSE mean / sum(mean) OVER (PARTITION BY species) END AS weight FROM m), f AS (SELECT p_brand AS strain, p_size AS feature, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY ALL), p AS (SELECT *, value / sum(value) OVER (PARTITION BY strain) AS x FROM f), s AS (SELECT species, feature, sum(x * weight) AS v FROM p JOIN w USING (strain) GROUP BY ALL) SELECT species, feature, round(v / sum(v) OVER (PARTITION BY species), 6) AS share FROM s")
def weighted_profiles(spark, sf):
    p = table(spark, sf, "part")
    w = com.strain_weights(p.select(F.col("p_type").alias("species"), F.col("p_brand").alias("strain"), F.col("p_retailprice").alias("value")))
    f = p.groupBy(F.col("p_brand").alias("strain"), F.col("p_size").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return com.weighted_profile(f, w).select("species", "feature", r6(F.col("share"), "share"))


@query(f"WITH {COMMUNITY}, {_FULL} SELECT a.sample AS a, b.sample AS b, round(sum(abs(a.value - b.value)) / sum(a.value + b.value), 6) AS distance FROM grid a JOIN grid b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY ALL")
def bray_curtis(spark, sf):
    return com.bray_curtis(community(spark, sf)).select("a", "b", r6(F.col("distance"), "distance"))


@query("SELECT l_shipyear, n_nationkey, count(*) AS n FROM (SELECT year(l_shipdate) AS l_shipyear, s_nationkey AS n_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL")
def recruit_counts(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy(F.year("l_shipdate").cast("long").alias("l_shipyear"), F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY l_suppkey")
def recruit_table(spark, sf):
    return com.recruit_table(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"])


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, n, round(100.0 * n / sum(n) OVER (PARTITION BY c_nationkey), 6) AS percent FROM c")
def row_percentages(spark, sf):
    return com.percentages(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment").withColumn("percent", F.round("percent", 6))


@query("WITH t AS (SELECT p_partkey AS feature, (p_partkey * 7919 % 1000 + 1) / 1000.0 AS p FROM part), r AS (SELECT feature, p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS x FROM t) SELECT feature, round(least(1.0, min(x) OVER (ORDER BY p DESC)), 6) AS q FROM r")
def benjamini_hochberg(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), ((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0).alias("p"))
    return com.benjamini_hochberg(t).select("feature", r6(F.col("q"), "q"))


@query("WITH x AS (SELECT p_brand AS feature, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS g, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM x) SELECT feature, round((avg(v) FILTER (g = 0) - avg(v) FILTER (g = 1)) / sqrt(var_samp(v) FILTER (g = 0) / count(*) FILTER (g = 0) + var_samp(v) FILTER (g = 1) / count(*) FILTER (g = 1)), 6) AS t, sum(rk) FILTER (g = 0) - count(*) FILTER (g = 0) * (count(*) FILTER (g = 0) + 1) / 2.0 AS u FROM r GROUP BY feature")
def two_group_tests(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select(F.col("p_brand").alias("feature"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("grp"), F.col("l_quantity").alias("value"))
    return com.two_group_tests(x).select("feature", r6(F.col("t"), "t"), F.col("u").cast("double").alias("u"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r, round(sqrt((1 - power(corr(l_extendedprice, l_quantity), 2)) * regr_syy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity) / (count(*) - 2)), 5) AS stderr FROM lineitem")
def linear_regression(spark, sf):
    x = com.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return x.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), r6(F.col("r"), "r"), F.round("stderr", 5).alias("stderr"))


@query()
def principal_components(spark, sf):
    model, out = com.principal_components(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", 2)
    from pyspark.ml.functions import vector_to_array

    return out.select("vec_id", vector_to_array("scores").alias("s")).select("vec_id", F.col("s")[0].alias("pc1"), F.col("s")[1].alias("pc2"))


@query()
def principal_coordinates(spark, sf):
    found = com.pcoa(com.bray_curtis(community(spark, sf)))
    rows = [(str(k), *map(float, v)) for k, v in zip(found.index, found.to_numpy(), strict=True)]
    return spark.createDataFrame(rows, "sample string" + "".join(f", {c} double" for c in found.columns))


# --- evaluation ---------------------------------------------------------------------------------------------------------
_TRUTH = "truth AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), called AS (SELECT doc_id FROM documents WHERE n_chars < 700)"


@query(f"WITH {_TRUTH}, c AS (SELECT count(*) FILTER (t.doc_id IS NOT NULL AND c.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (c.doc_id IS NULL) AS fn FROM truth t FULL JOIN called c ON t.doc_id = c.doc_id) SELECT tp, fp, fn, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS \"precision\", round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f FROM c")
def confusion_rates(spark, sf):
    truth = table(spark, sf, "labels").where("quality = 0")
    out = ev.rates(ev.confusion(truth, table(spark, sf, "documents").where("n_chars < 700"), "doc_id"))
    return out.select("tp", "fp", "fn", *[r6(F.col(c), c) for c in ("recall", "precision", "f")])


_COUNTS = "counts AS (SELECT e, l_suppkey AS gene, count(*) FILTER (l_returnflag = 'R') AS truth, count(*) FILTER (l_returnflag = 'R' AND l_discount * 100 <= e) AS tp, count(*) FILTER (l_discount * 100 <= e) AS predicted FROM lineitem, (SELECT unnest(range(0, 11, 2)) AS e) GROUP BY ALL), m AS (SELECT e, avg(CASE WHEN truth = 0 THEN 1.0 ELSE tp / truth END) AS sensitivity, avg(CASE WHEN predicted = 0 THEN 1.0 ELSE tp / predicted END) AS \"precision\" FROM counts GROUP BY e)"


def _counts(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"), F.lit(2).cast("long"))))
    real, hit = F.col("l_returnflag") == "R", F.col("l_discount") * 100 <= F.col("e")
    return lines.groupBy("e", F.col("l_suppkey").alias("gene")).agg(F.count_if(real).alias("truth"), F.count_if(real & hit).alias("tp"), F.count_if(hit).alias("predicted"))


@query(f"WITH {_COUNTS} SELECT e, round(sensitivity, 6) AS sensitivity, round(\"precision\", 6) AS \"precision\" FROM m")
def macro_averages(spark, sf):
    return ev.macro(_counts(spark, sf), "e").select("e", r6(F.col("sensitivity"), "sensitivity"), r6(F.col("precision"), "precision"))


@query(f"WITH {_COUNTS} SELECT e, round(avg(CASE WHEN truth > 0 THEN CASE WHEN predicted > 0 THEN tp / truth ELSE 0.0 END ELSE 1.0 END), 6) AS sensitivity, round(avg(CASE WHEN predicted > 0 THEN CASE WHEN truth > 0 THEN tp / predicted ELSE 0.0 END ELSE 1.0 END), 6) AS \"precision\" FROM counts GROUP BY e")
def macro_averages_strict(spark, sf):
    return ev.macro_strict(_counts(spark, sf), "e").select("e", r6(F.col("sensitivity"), "sensitivity"), r6(F.col("precision"), "precision"))


@query(f"WITH {_COUNTS}, h AS (SELECT e, sensitivity AS s, min(\"precision\") OVER (ORDER BY e) AS p FROM m), l AS (SELECT *, lag(s) OVER (ORDER BY e) AS s0, lag(p) OVER (ORDER BY e) AS p0, lead(e) OVER (ORDER BY e) AS nxt FROM h) SELECT round(sum(CASE WHEN s0 IS NULL THEN 0.5 * s * (1 - p) ELSE 0.5 * (s + s0) * (p0 - p) END + CASE WHEN nxt IS NULL THEN 0.5 * p * (least(p * coalesce((s - s0) / (0.01 + p0 - p) / 2, 0) + s, 1.0) + s) ELSE 0 END), 6) AS auc FROM l")
def area_under_curve(spark, sf):
    return ev.area(ev.macro(_counts(spark, sf), "e").withColumn("method", F.lit("m")), "method", "e").select(r6(F.col("auc"), "auc"))


@query(f"WITH {_COUNTS} SELECT round(max(CASE WHEN sensitivity + \"precision\" = 0 THEN 0.0 ELSE 2 * sensitivity * \"precision\" / (sensitivity + \"precision\") END), 6) AS f FROM m")
def best_f_score(spark, sf):
    return ev.best_f(ev.macro(_counts(spark, sf), "e").withColumn("method", F.lit("m")), "method").select(r6(F.col("f"), "f"))


@query("WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, count(*) AS common, round(2.0 * count(*) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)), 6) AS dice FROM a JOIN b USING (l_partkey)")
def dice_overlap(spark, sf):
    x = table(spark, sf, "lineitem")
    return ev.dice(x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'R'"), "l_partkey").withColumn("dice", F.round("dice", 6))


@query("WITH s AS (SELECT source AS grp, n_chars AS length, sum(n_chars) AS s FROM documents GROUP BY ALL), r AS (SELECT *, sum(s) OVER (PARTITION BY grp ORDER BY length DESC) AS upto, sum(s) OVER (PARTITION BY grp) AS alls FROM s) SELECT grp AS source, max(length) AS n50, CAST(max(alls) AS BIGINT) AS total FROM r WHERE upto * 2 >= alls GROUP BY grp")
def n50_by_source(spark, sf):
    return ev.n50(table(spark, sf, "documents"), "source", "n_chars")


@query("WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS rank, count(*) OVER () AS n FROM documents), f AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS fraction) SELECT CAST(fraction AS DOUBLE) AS fraction, n_chars FROM r JOIN f ON rank = greatest(floor(n * CAST(fraction AS DOUBLE)) - 1, 0)")
def length_quantiles(spark, sf):
    return ev.index_quantiles(table(spark, sf, "documents"), "n_chars", [0.1, 0.25, 0.5, 0.75, 0.9, 1.0])


@query("SELECT n_chars AS median FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS rank, count(*) OVER () AS n FROM documents) WHERE rank = n // 2")
def upper_median(spark, sf):
    return ev.upper_median(table(spark, sf, "documents"), "n_chars")


@query(f"WITH {PEPTIDES}, e AS (SELECT rid, unnest(string_split(seq, '')) AS a FROM reads WHERE seq <> ''), c AS (SELECT rid, a, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT rid, n / sum(n) OVER (PARTITION BY rid) AS p FROM c) SELECT rid, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY rid")
def sequence_entropy(spark, sf):
    each = peptides(spark, sf).where("seq <> ''").select("rid", F.explode(F.split("seq", "")).alias("a")).where("a <> ''")
    return ev.entropy(each.groupBy("rid", "a").agg(F.count(F.lit(1)).alias("n")), "rid").select("rid", r6(F.col("entropy"), "entropy"))


_PLACED = f"{PEPTIDES}, placed AS (SELECT d.source AS path, d.doc_id % 7 AS start, r.seq FROM documents d JOIN reads r ON r.rid = d.doc_id WHERE r.seq <> ''), each AS (SELECT path, start + i - 1 AS col, substr(seq, i, 1) AS residue FROM (SELECT path, start, seq, unnest(range(1, length(seq) + 1)) AS i FROM placed)), prof AS (SELECT path, col, residue, count(*) AS n FROM each GROUP BY ALL)"


def _placed(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("rid"), F.col("source").alias("path"))
    return docs.join(peptides(spark, sf), "rid").where("seq <> ''").select("path", (F.col("rid") % 7).alias("start"), "seq")


@query(f"WITH {_PLACED} SELECT path, col AS \"column\", residue, n FROM prof")
def column_profile(spark, sf):
    return ev.column_profile(_placed(spark, sf))


@query(f"WITH {_PLACED} SELECT path, col AS \"column\", residue FROM prof QUALIFY row_number() OVER (PARTITION BY path, col ORDER BY n DESC, instr('ARNDCQEGHILKMFPSTWYVBZX*', residue) DESC) = 1")
def majority_consensus(spark, sf):
    return ev.consensus(ev.column_profile(_placed(spark, sf)))


@query("WITH o AS (SELECT source, count(*) FILTER (n_chars < 1000) AS k, count(*) AS n FROM documents GROUP BY source) SELECT source, k, n, CAST(sum(k) OVER () AS BIGINT) AS all_k, CAST(sum(n) OVER () AS BIGINT) AS all_n FROM o")
def cluster_contingency(spark, sf):
    return ev.contingency(table(spark, sf, "documents").withColumn("short", F.col("n_chars") < 1000), "source", "short")


@query("SELECT user_id, CAST(sum(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS BIGINT) AS seconds FROM events GROUP BY user_id")
def runtime_sums(spark, sf):
    clock = F.date_format("ts", "HH:mm:ss")
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(ev.seconds(clock)).alias("seconds"))


@query("SELECT l_suppkey, count(*) AS n, round(1e9 * count(*) / (SELECT count(*) FROM lineitem) / (1000 + 10 * l_suppkey), 6) AS rpkm FROM lineitem GROUP BY l_suppkey")
def rpkm(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    total = table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("l_suppkey", "n", r6(scoring.rpkm(F.col("n"), F.col("total"), 1000 + 10 * F.col("l_suppkey")), "rpkm"))


@query("SELECT l_orderkey, min(l_discount) AS best, arg_min(l_linenumber, l_discount * 1000 + l_linenumber) AS line FROM lineitem GROUP BY l_orderkey")
def best_hit_per_read(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_discount").alias("best"), F.min_by("l_linenumber", F.col("l_discount") * 1000 + F.col("l_linenumber")).alias("line"))


# --- networks -----------------------------------------------------------------------------------------------------------
@query(f"WITH {MEETINGS} SELECT source, target, round(weight, 6) AS weight FROM edges")
def association_edges(spark, sf):
    return network(spark, sf).withColumn("weight", F.round("weight", 6))


@query(f"WITH {NETWORKS} SELECT source, target, max(weight) FILTER (network = 'A') AS A, max(weight) FILTER (network = 'N') AS N, max(weight) FILTER (network = 'R') AS R FROM edges GROUP BY ALL")
def aligned_networks(spark, sf):
    return net.aligned(networks(spark, sf), ["A", "N", "R"])


@query(f"WITH {NETWORKS}, k AS (SELECT source, target, count(*) AS k FROM edges GROUP BY ALL) SELECT network, count(*) AS edges, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 6) AS \"unique\", round(avg(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END), 6) AS shared FROM edges JOIN k USING (source, target) GROUP BY network")
def network_edge_shares(spark, sf):
    return net.edge_shares(networks(spark, sf)).select("network", "edges", r6(F.col("unique"), "unique"), r6(F.col("shared"), "shared"))


@query(f"WITH {NETWORKS}, t AS (SELECT network, count(*) AS n FROM edges GROUP BY network), p AS (SELECT a.network AS a, b.network AS b, count(*) AS k FROM edges a JOIN edges b USING (source, target) GROUP BY 1, 2) SELECT a, b, round(k / n, 6) AS share FROM p JOIN t ON t.network = a")
def pairwise_shared_edges(spark, sf):
    return net.shared_edges(networks(spark, sf)).withColumn("share", F.round("share", 6))


_TRI = "tri AS (SELECT e.source AS a, e.target AS b, f.target AS c FROM edges e JOIN edges f ON e.target = f.source JOIN edges g ON g.source = e.source AND g.target = f.target)"


@query(f"WITH {MEETINGS}, {_TRI} SELECT a, b, c FROM tri")
def triangles(spark, sf):
    return net.triangles(network(spark, sf))


@query(f"WITH {MEETINGS}, {_TRI} SELECT t.a, t.b, t.c, e.target AS d FROM tri t JOIN edges e ON e.source = t.c JOIN edges f ON f.source = t.a AND f.target = e.target JOIN edges g ON g.source = t.b AND g.target = e.target")
def four_cliques(spark, sf):
    m = F.col("members")
    return net.cliques(network(spark, sf), 4).select(m[0].alias("a"), m[1].alias("b"), m[2].alias("c"), m[3].alias("d"))


@query(f"WITH {MEETINGS}, {BOTH}, {_TRI}, d AS (SELECT v, count(*) AS degree, count(*) FILTER (weight > 0) AS positive, count(*) FILTER (weight < 0) AS negative, sum(weight) AS strength FROM ends GROUP BY v), t AS (SELECT v, count(*) AS n FROM (SELECT unnest([a, b, c]) AS v FROM tri) GROUP BY v) SELECT d.v, degree, positive, negative, round(strength, 4) AS strength, coalesce(n, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS clustering FROM d LEFT JOIN t ON t.v = d.v")
def node_statistics(spark, sf):
    s = net.node_statistics(network(spark, sf))
    return s.select("v", "degree", "positive", "negative", F.round("strength", 4).alias("strength"), "triangles", r6(F.col("clustering"), "clustering"))


_COMP = "comp AS (WITH RECURSIVE reach(v, u) AS (SELECT v, v FROM ends UNION SELECT r.v, e.u FROM reach r JOIN ends e ON e.v = r.u) SELECT v, min(u) AS component FROM reach GROUP BY v)"


@query(f"WITH {MEETINGS}, {BOTH}, {_COMP} SELECT v, component FROM comp")
def network_components(spark, sf):
    return net.components(network(spark, sf))


_DIST = "dist AS (WITH RECURSIVE walk(a, b, d) AS (SELECT v, u, 1 FROM ends UNION SELECT w.a, e.u, w.d + 1 FROM walk w JOIN ends e ON e.v = w.b WHERE w.d < 14 AND e.u <> w.a) SELECT a, b, min(d) AS d FROM walk GROUP BY ALL)"


@query(f"WITH {MEETINGS}, {BOTH}, {_DIST} SELECT a AS v, round(sum(1.0 / d), 6) AS harmonic FROM dist GROUP BY a")
def harmonic_centrality(spark, sf):
    return net.harmonic(network(spark, sf)).withColumn("harmonic", F.round("harmonic", 6))


@query(f"WITH {MEETINGS}, {BOTH}, {_TRI}, {_COMP}, {_DIST}, d AS (SELECT v, count(*) AS k FROM ends GROUP BY v), x AS (SELECT dx.k AS x, dy.k AS y FROM ends JOIN d dx ON dx.v = ends.v JOIN d dy ON dy.v = ends.u) SELECT (SELECT count(*) FROM d) AS vertices, (SELECT count(*) FROM edges) AS edges, round((SELECT 3.0 * count(*) FROM tri) / (SELECT sum(k * (k - 1) / 2.0) FROM d), 6) AS transitivity, round(2.0 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM d) * ((SELECT count(*) FROM d) - 1)), 6) AS density, (SELECT count(DISTINCT component) FROM comp) AS components, round((SELECT avg(d) FROM dist), 6) AS mean_path, round((SELECT corr(x, y) FROM x), 6) AS assortativity")
def global_network_properties(spark, sf):
    g = net.global_properties(network(spark, sf))
    return g.select("vertices", "edges", *[r6(F.col(c), c) for c in ("transitivity", "density")], "components", *[r6(F.col(c), c) for c in ("mean_path", "assortativity")])


@query()
def betweenness_centrality(spark, sf):
    return net.betweenness(network(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


@query()
def communities(spark, sf):
    return net.label_propagation(network(spark, sf).where("weight > 0"))


@query()
def module_leaders(spark, sf):
    e = network(spark, sf).where("weight > 0")
    values = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("v"), F.col("s_acctbal").alias("value"))
    return net.module_leaders(e, net.label_propagation(e), values)


@query(f"WITH {MEETINGS} SELECT CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END AS sign, CASE WHEN x.s_nationkey = y.s_nationkey THEN 'nation' WHEN n.n_regionkey = m.n_regionkey THEN 'region' ELSE 'none' END AS rank, count(*) AS n FROM edges JOIN supplier x ON x.s_suppkey = source JOIN supplier y ON y.s_suppkey = target JOIN nation n ON n.n_nationkey = x.s_nationkey JOIN nation m ON m.n_nationkey = y.s_nationkey GROUP BY ALL")
def lineage_classes(spark, sf):
    t = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("v"), F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return net.lineage_classes(network(spark, sf), t, ["nation", "region"])


@query(f"WITH {MEETINGS}, {BOTH} SELECT v % 5 = 0 AS listed, round(count(*) / count(DISTINCT v), 6) AS degree, round(avg(weight), 6) AS weight FROM ends GROUP BY 1")
def listed_degree(spark, sf):
    listed = table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("v"))
    return net.listed_degree(network(spark, sf), listed).select("listed", r6(F.col("degree"), "degree"), r6(F.col("weight"), "weight"))


@query(f"WITH {MEETINGS}, p AS (SELECT l_suppkey AS v, l_partkey % 50 AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY ALL), f AS (SELECT DISTINCT feature FROM p), x AS (SELECT e.source, e.target, coalesce(a.value, 0) AS a, coalesce(b.value, 0) AS b FROM edges e CROSS JOIN f LEFT JOIN p a ON a.v = e.source AND a.feature = f.feature LEFT JOIN p b ON b.v = e.target AND b.feature = f.feature) SELECT source, target, round(sum(abs(a - b)) / sum(a + b), 6) AS distance FROM x GROUP BY ALL")
def edge_functional_distance(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("v"), (F.col("l_partkey") % 50).alias("feature")).agg(F.sum("l_quantity").alias("value"))
    return net.edge_distances(network(spark, sf), p).withColumn("distance", F.round("distance", 6))


@query()
def spanning_forest(spark, sf):
    return net.spanning_forest(network(spark, sf).select("source", "target", F.round(F.col("weight") * 1000).cast("long").alias("n")))


@query()
def random_graph_edges(spark, sf):
    return net.random_graphs(spark, 1000, 30, 0.1, 101).groupBy("g").agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH {MEETINGS}, {BOTH}, s(v, step) AS (SELECT 1 AS v, 0 AS step), hubs AS (SELECT v FROM ends GROUP BY v HAVING count(*) >= 20), a AS (SELECT DISTINCT u AS v, 1 AS step FROM ends JOIN s USING (v) WHERE v NOT IN (SELECT v FROM hubs) AND u <> 1), b AS (SELECT DISTINCT u AS v, 2 AS step FROM ends JOIN a USING (v) WHERE v NOT IN (SELECT v FROM hubs) AND u NOT IN (SELECT v FROM a) AND u <> 1) SELECT CAST(v AS BIGINT) AS v, CAST(step AS INTEGER) AS step FROM s UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b")
def bounded_recruitment(spark, sf):
    e = network(spark, sf)
    both = e.select(F.col("source").alias("src"), F.col("target").alias("dst")).union(e.select("target", "source"))
    return net.reachable(both, spark.range(1, 2).select(F.col("id").alias("v")), 2, 20)


# --- models and streams -------------------------------------------------------------------------------------------------
@query()
def sparse_network(spark, sf):
    x = models.matrix(table(spark, sf, "embeddings").select(*[F.col("embedding")[i].alias(f"x{i}") for i in range(8)]), [f"x{i}" for i in range(8)])
    rho, _ = models.select_precision(x)
    return models.bootstrap_network(spark, x, rho, 10, 0.8)


@query()
def gaussian_mixture_starts(spark, sf):
    x = models.matrix(table(spark, sf, "embeddings").select(*[F.col("embedding")[i].alias(f"x{i}") for i in range(4)]), [f"x{i}" for i in range(4)])
    return models.restarts(spark, x, 3, 4, rounds=10).select("start", F.round("bound", 4).alias("bound"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return windows.windowed_counts(table(spark, sf, "events"), "1 hour", "1 hour", "event_type").select("start", "event_type", "n")


@query(f"WITH {PEPTIDES}, {sql_kmers(4)} SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer")
def tetramers(spark, sf):
    from ..operators.kmers import spectrum

    return spectrum(peptides(spark, sf), 4)
