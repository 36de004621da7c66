"""Joins and sums over closed intervals.  Overlap joins are equi-joins on bins, with each pair met in one bin only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scoring import overlap


def overlap_join(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Rows of ``a(target, begin, end, ...)`` and ``b(target, start, stop, ...)`` on one target that overlap.

    Bins of ``width``; a pair is taken in the bin where the later of both begins, so none is met twice.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x, y = a.withColumn("bin_", bins("begin", "end")), b.withColumn("bin_", bins("start", "stop"))
    met = x.join(y, ["target", "bin_"]).where("begin <= stop and start <= end")
    return met.where(F.floor(F.greatest("begin", "start") / width) == F.col("bin_")).drop("bin_")


def best_overlap(reads: DataFrame, notes: DataFrame, width: int, least: float = 0.6) -> DataFrame:
    """Per read the annotation with the longest overlap, if that is at least ``least`` of the read."""
    met = overlap_join(reads, notes, width).withColumn("shared", overlap(F.col("begin"), F.col("end"), F.col("start"), F.col("stop")))
    fit = met.where(F.col("shared") >= least * (F.col("end") - F.col("begin") + 1))
    return fit.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("shared"), "nid"))).where("rank = 1").select("rid", "nid", "shared")


def included(reads: DataFrame, ranges: DataFrame, place: tuple[str, ...] = ()) -> DataFrame:
    """Reads inside the range of their target; of several ranges the last (largest ``at``) counts, of equal ones the one
    that comes first by the columns ``place``.  Ranges without a start or ``at`` don't count."""
    first = F.struct((-F.col("at")).alias("at"), *place)
    known = ranges.where("start is not null and at is not null")
    last = known.groupBy("target").agg(F.min_by(F.struct("start", "stop"), first).alias("r")).select("target", "r.*")
    return reads.join(last, "target").where("start <= begin and end <= stop").drop("start", "stop")


def base_depth(runs: DataFrame) -> DataFrame:
    """``(path, pos, depth)`` from runs ``(path, start, stop)``, by a sweep: two events a run, whatever its length."""
    events = runs.select("path", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("path", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    on = Window.partitionBy("path").orderBy("pos")
    runs_ = steps.withColumn("depth", F.sum("d").over(on)).withColumn("next", F.lead("pos").over(on)).where("depth > 0")
    return runs_.select("path", F.explode(F.sequence("pos", F.col("next") - 1)).alias("pos"), "depth")


def sub_runs(runs: DataFrame, shortest: int, longest: int) -> DataFrame:
    """``(path, pos, length, n)``: how many runs hold each sub-run with a length from ``shortest`` to ``longest``."""
    size = F.col("stop") - F.col("start") + 1
    fit = runs.where(size >= shortest).withColumn("length", F.explode(F.sequence(F.lit(shortest).cast("long"), F.least(size, F.lit(longest).cast("long")))))
    return fit.select("path", "length", F.explode(F.sequence(F.col("start"), F.col("stop") - F.col("length") + 1)).alias("pos")).groupBy("path", "pos", "length").agg(F.count(F.lit(1)).alias("n"))


def greedy_regions(hits: DataFrame, most_shared: int = 10, shortest: int = 20) -> DataFrame:
    """By E-value, accept a region of ``(target, rid, begin, end, e_value)`` if it shares at most ``most_shared``
    positions with those accepted and is long enough.  Order matters, so a target's hits are worked through in one
    group; exact repeats are removed before."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        rows = []
        for r in pdf.sort_values(["e_value", "begin", "end", "rid"]).itertuples():
            if r.end - r.begin + 1 >= shortest and all(min(r.end, e) - max(r.begin, b) + 1 <= most_shared for b, e in kept):
                kept.append((r.begin, r.end))
                rows.append(r.Index)
        return pdf.loc[rows]

    once = hits.select("target", "rid", "begin", "end", "e_value").where(F.col("end") - F.col("begin") + 1 >= shortest)
    once = once.groupBy("target", "begin", "end").agg(F.min(F.struct("e_value", "rid")).alias("m")).select("target", F.col("m.rid").alias("rid"), "begin", "end", F.col("m.e_value").alias("e_value"))
    return once.groupBy("target").applyInPandas(run, once.schema)
