"""Registering of queries, and the tables that stand in for sequences, hits, communities and networks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import kmers, meeting
from .iterate import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the same result as SQL where SQL can say it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def peptides(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.reads(table(spark, sf, "documents"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.reads(table(spark, sf, "benchmark"), "item_id")


_NORMAL = "regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"
PEPTIDES = f"reads AS (SELECT doc_id AS rid, {_NORMAL} AS seq FROM documents)"
TARGETS = f"targets AS (SELECT item_id AS rid, {_NORMAL} AS seq FROM benchmark)"


def sql_kmers(k: int, source: str = "reads", name: str = "kmers") -> str:
    return f"{name} AS (SELECT rid, pos, substr(seq, pos, {k}) AS kmer FROM (SELECT rid, seq, unnest(range(1, length(seq) - {k} + 2)) AS pos FROM {source} WHERE length(seq) >= {k}))"


# contigs are suppliers, genomes their nations, reads orders: a line is a hit of a read on a contig
def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("contig"), (F.lit(1000) + 10 * F.col("s_suppkey")).alias("length"), F.col("s_nationkey").cast("long").alias("genome"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_suppkey").alias("contig"))
    return lines.join(contigs(spark, sf), "contig").select("read", "genome")


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return contigs(spark, sf).groupBy("genome").agg(F.sum("length").alias("length"))


HITS = """contigs AS (SELECT s_suppkey AS contig, 1000 + 10 * s_suppkey AS length, CAST(s_nationkey AS BIGINT) AS genome FROM supplier),
hits AS (SELECT l_orderkey AS read, genome FROM lineitem JOIN contigs ON l_suppkey = contig),
lengths AS (SELECT genome, CAST(sum(length) AS BIGINT) AS length FROM contigs GROUP BY genome)"""


# samples are nations of suppliers, cohorts regions, taxa brands by size of part, values quantities (whole numbers)
def places(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("sample"), F.col("r_name").alias("cohort"))


def community(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    taxa = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("taxon"))
    return lines.join(taxa, F.col("l_partkey") == F.col("p_partkey")).join(places(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("cohort", "sample", "taxon").agg(F.sum("l_quantity").alias("value"))


COMMUNITY = """community AS (SELECT r_name AS cohort, n_name AS sample, p_brand || '-' || p_size AS taxon, sum(l_quantity) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL)"""


# vertices are suppliers; a pair that meets in orders much more (or less) often than the mean pair is an edge
def meetings(spark: SparkSession, sf: str, by: str | None = None) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", *([by] if by else [])).distinct()
    x, y = lines.withColumnRenamed("l_suppkey", "source"), lines.withColumnRenamed("l_suppkey", "target")
    on = ["l_orderkey", *([by] if by else [])]
    return x.join(y, on).where("source < target").groupBy(*([by] if by else []), "source", "target").agg(F.count(F.lit(1)).alias("n"))


def network(spark: SparkSession, sf: str) -> DataFrame:
    m = cut(meeting.meetings(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey"))  # written: its mean is asked first
    mean = m.agg(F.avg("n").alias("mean"))
    return m.join(F.broadcast(mean), F.lit(True)).where("n >= 1.25 * mean or n <= 0.6 * mean").select("source", "target", (F.col("n") - F.col("mean")).alias("weight"))


MEETINGS = """lines AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
meetings AS (SELECT x.l_suppkey AS source, y.l_suppkey AS target, count(*) AS n FROM lines x JOIN lines y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL),
edges AS (SELECT source, target, n - mean AS weight FROM meetings, (SELECT avg(n) AS mean FROM meetings) WHERE n >= 1.25 * mean OR n <= 0.6 * mean)"""
BOTH = "ends AS (SELECT source AS v, target AS u, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)"


def networks(spark: SparkSession, sf: str) -> DataFrame:
    m = meetings(spark, sf, "l_returnflag")
    mean = m.groupBy(F.col("l_returnflag").alias("f")).agg(F.avg("n").alias("mean"))
    return m.join(mean, F.col("l_returnflag") == F.col("f")).where("n >= 1.5 * mean").select(F.col("l_returnflag").alias("network"), "source", "target", F.col("n").cast("double").alias("weight"))


NETWORKS = """lines AS (SELECT DISTINCT l_orderkey, l_returnflag, l_suppkey FROM lineitem),
meetings AS (SELECT x.l_returnflag AS network, x.l_suppkey AS source, y.l_suppkey AS target, count(*) AS n FROM lines x JOIN lines y ON x.l_orderkey = y.l_orderkey AND x.l_returnflag = y.l_returnflag AND x.l_suppkey < y.l_suppkey GROUP BY ALL),
edges AS (SELECT m.network, source, target, CAST(n AS DOUBLE) AS weight FROM meetings m JOIN (SELECT network, avg(n) AS mean FROM meetings GROUP BY network) USING (network) WHERE n >= 1.5 * mean)"""
