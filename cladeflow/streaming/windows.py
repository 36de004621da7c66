"""Streaming forms of the counts: the same expressions over ``readStream`` sources, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(events: DataFrame, width: str, late: str, by: str, time: str = "ts") -> DataFrame:
    """Rows per tumbling window and key; rows later than ``late`` are dropped."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, gap: str, late: str, by: str, time: str = "ts") -> DataFrame:
    """Rows per session: rows of a key no more than ``gap`` apart."""
    counts = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def kmer_stream(reads: DataFrame, k: int) -> DataFrame:
    """Running k-mer counts over a stream of ``(rid, seq)``."""
    from ..operators.kmers import kmers

    return kmers(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Work through all that is there and return the result (memory sink; for tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
