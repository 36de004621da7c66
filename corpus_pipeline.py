"""From documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written and read again as the next one's ``docs``.  All
but the last return the columns of ``docs``.  Null, empty and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cladeflow.llm import near_dedup, packing, quality, secrets
from cladeflow.llm.common import only, without, write_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents judged low go."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, five words and 0.8: of each group the document with the smallest id stays; of equal ids the smallest
    text, of equal texts the row whose other columns come first.  Different texts under one id are documents of their
    own: rows of ids that stand on several rows get a key each, so only copies go.  Rows with a null id stay."""
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    again = write_table(again, "repeated")
    if again.isEmpty():
        marked = near_dedup.near_duplicates(docs.select("doc_id", "text"))
        doubles = write_table(marked.where("not kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), "doubles")
        return without(docs, "doc_id", doubles)
    key, rank = "_cladeflow_row", "_cladeflow_rank"
    others = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy("text", *others)
    several = only(docs, "doc_id", again).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    # keys above every id in use
    base = docs.agg(F.max("doc_id")).first()[0]
    several = write_table(several.withColumn(key, F.monotonically_increasing_id() + F.lit(base + 1)), "several")
    if several.agg(F.min(key)).first()[0] <= base:
        raise OverflowError("no room for keys above the largest id")
    once = without(docs, "doc_id", again)
    keyed = once.select(F.col("doc_id").alias("id"), F.col("doc_id").alias(key), "text").unionByName(several.select(F.col("doc_id").alias("id"), key, "text"))
    marked = near_dedup.near_duplicates(keyed.select(key, "text"), id_col=key).where(F.col(key).isNotNull())
    order = several.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), "text")
    placed = write_table(marked.select(F.col(key).alias("key"), "component_id").join(order, "key", "left").select("key", "component_id", F.coalesce("id", "key").alias("id"), "text"), "placed")
    best = placed.groupBy("component_id").agg(F.min(F.struct("id", F.coalesce("text", F.lit("")).alias("text"), "key")).alias("best"))
    doubles = write_table(placed.join(best, "component_id").where("key <> best.key").select(F.col("key").alias("id")).distinct(), "doubles")
    return without(once, "doc_id", doubles).unionByName(without(several, key, doubles).drop(key))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: secrets are replaced by a mark; no document goes."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near_dedup", keep_one), ("secrets", hide_secrets), ("packing", pack)]

#: No SQL: the stages' models and packing can't be expressed; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
