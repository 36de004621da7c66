"""Evaluation: confusion counts, precision and recall, areas, N50, quantiles, entropies, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.readers import numbered


def confusion(truth: DataFrame, called: DataFrame, key: str) -> DataFrame:
    """One row (tp, fp, fn) over distinct keys of both sides."""
    both = truth.select(key).distinct().withColumn("t", F.lit(True)).join(called.select(key).distinct().withColumn("c", F.lit(True)), key, "full_outer")
    n = lambda c: F.count_if(c).alias
    return both.agg(n(F.col("t") & F.col("c"))("tp"), n(F.col("t").isNull())("fp"), n(F.col("c").isNull())("fn"))


def confusion_within(universe: DataFrame, truth: DataFrame, called: DataFrame, key: str) -> DataFrame:
    """One row (tp, fp, fn, tn) over the distinct keys of a universe; keys outside it do not count."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    both = universe.select(key).where(F.col(key).isNotNull()).distinct().join(flag(truth, "t"), key, "left").join(flag(called, "c"), key, "left").na.fill(False, ["t", "c"])
    n = lambda t, c, name: F.count_if((F.col("t") == t) & (F.col("c") == c)).alias(name)
    return both.agg(n(True, True, "tp"), n(False, True, "fp"), n(True, False, "fn"), n(False, False, "tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Recall, precision and F of (tp, fp, fn); 1 where nothing could be found."""
    recall = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    precision = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    return counts.withColumn("recall", recall).withColumn("precision", precision).withColumn("f", f_score(F.col("recall"), F.col("precision")))


def f_score(s: Column, p: Column) -> Column:
    return F.when(s + p == 0, 0.0).otherwise(2 * s * p / (s + p))


def macro(counts: DataFrame, by: str) -> DataFrame:
    """Means over genes of sensitivity and precision by threshold: ``counts(by, gene, truth, tp, predicted)``; an empty
    denominator counts as 1."""
    sen = F.when(F.col("truth") == 0, 1.0).otherwise(F.col("tp") / F.col("truth"))
    pre = F.when(F.col("predicted") == 0, 1.0).otherwise(F.col("tp") / F.col("predicted"))
    return counts.groupBy(by).agg(F.avg(sen).alias("sensitivity"), F.avg(pre).alias("precision"))


def macro_strict(counts: DataFrame, by: str) -> DataFrame:
    """The variant that takes zeros apart: without truth sensitivity is 1, and precision 1 only if nothing is predicted
    either; without predictions precision is 1, and sensitivity 1 only if nothing is true either."""
    t, p, tp = F.col("truth"), F.col("predicted"), F.col("tp")
    sen = F.when(t == 0, 1.0).when(p == 0, 0.0).otherwise(tp / t)
    pre = F.when(p == 0, 1.0).when(t == 0, 0.0).otherwise(tp / p)
    return counts.groupBy(by).agg(F.avg(sen).alias("sensitivity"), F.avg(pre).alias("precision"))


def area(points: DataFrame, by: str, order: str) -> DataFrame:
    """Area under sensitivity over precision per method, thresholds ascending.

    Precision is held to its running minimum; the first part is a triangle, those that follow trapezoids, the last is
    carried on with half the final slope, the sensitivity at zero at most 1.
    """
    on = Window.partitionBy(by).orderBy(order)
    held = points.withColumn("p", F.min("precision").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    steps = held.withColumn("s0", F.lag("sensitivity").over(on)).withColumn("p0", F.lag("p").over(on)).withColumn("next", F.lead(order).over(on))
    part = F.when(F.col("s0").isNull(), 0.5 * F.col("sensitivity") * (1 - F.col("p"))).otherwise(0.5 * (F.col("sensitivity") + F.col("s0")) * (F.col("p0") - F.col("p")))
    slope = (F.col("sensitivity") - F.col("s0")) / (0.01 + F.col("p0") - F.col("p")) / 2
    end = F.least(F.col("p") * F.coalesce(slope, F.lit(0.0)) + F.col("sensitivity"), F.lit(1.0))
    tail = F.when(F.col("next").isNull(), 0.5 * F.col("p") * (end + F.col("sensitivity"))).otherwise(0.0)
    return steps.groupBy(by).agg(F.sum(part + tail).alias("auc"))


def best_f(points: DataFrame, by: str) -> DataFrame:
    return points.groupBy(by).agg(F.max(f_score(F.col("sensitivity"), F.col("precision"))).alias("f"))


def dice(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of both sets, common keys, 2 * common / (n1 + n2)."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    sizes = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), key, "full_outer")
    out = sizes.agg(F.count("a").alias("n1"), F.count("b").alias("n2"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    return out.withColumn("dice", F.when(F.col("n1") + F.col("n2") == 0, 0.0).otherwise(2 * F.col("common") / (F.col("n1") + F.col("n2"))))


def n50(lengths: DataFrame, by: str, length: str = "length") -> DataFrame:
    """Per group the length at which contigs, longest first, reach half of all.  Equal lengths are summed first."""
    sums = lengths.groupBy(by, length).agg(F.sum(length).alias("s"))
    on = Window.partitionBy(by)
    run = sums.withColumn("upto", F.sum("s").over(on.orderBy(F.desc(length)))).withColumn("all", F.sum("s").over(on))
    return run.where(F.col("upto") * 2 >= F.col("all")).groupBy(by).agg(F.max(length).alias("n50"), F.max("all").alias("total"))


def index_quantiles(values: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """``(fraction, value)``: the element at index int(n * f) - 1 of the sorted values, at least the first, for f = 1 the
    last.  Ranks come from a range shuffle (see ``numbered``), so no task sorts all values."""
    ranked = numbered(values.where(F.col(value).isNotNull()).select(value), [value], "rank")
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.greatest(F.floor(F.col("n") * f) - 1, F.lit(0)).alias("at")) for f in fractions]))
    wanted = total.select(at.alias("w")).select("w.*")
    return ranked.join(F.broadcast(wanted), F.col("rank") == F.col("at")).select("fraction", value)


def summary(values: DataFrame, value: str) -> DataFrame:
    """``(statistic, value)``: n, min, max, mean, the upper median and the deciles by index."""
    base = values.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).cast("double").alias("n"), F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"), F.avg(value).alias("mean"))
    rows = base.select(F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in base.columns])).alias("r")).select("r.*")
    median = upper_median(values, value).select(F.lit("median").alias("statistic"), F.col("median").cast("double").alias("value"))
    tenths = index_quantiles(values, value, [i / 10 for i in range(1, 10)])
    return rows.unionByName(median).unionByName(tenths.select(F.concat(F.lit("decile "), F.round(F.col("fraction") * 10).cast("int").cast("string")).alias("statistic"), F.col(value).cast("double").alias("value")))


def upper_median(values: DataFrame, value: str) -> DataFrame:
    """The element at index n / 2."""
    ranked = numbered(values.where(F.col(value).isNotNull()).select(value), [value], "rank")
    total = ranked.agg(F.floor(F.count(F.lit(1)) / 2).alias("at"))
    return ranked.join(F.broadcast(total), F.col("rank") == F.col("at")).select(F.col(value).alias("median"))


def entropy(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Shannon entropy in bits of counts per group."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(by))
    return counts.where(F.col(n) > 0).withColumn("p", p).groupBy(by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def column_profile(placed: DataFrame) -> DataFrame:
    """``(path, column, residue, n)`` from ``(path, start, seq)``, start from 0; '.' is ignored."""
    each = placed.select("path", "start", F.posexplode(F.split("seq", "")).alias("i", "residue")).where("residue not in ('.', '')")
    return each.groupBy("path", (F.col("start") + F.col("i")).alias("column"), "residue").agg(F.count(F.lit(1)).alias("n"))


def consensus(profile: DataFrame, stop: str = "*") -> DataFrame:
    """``(path, column, residue)``: the residue with the most counts, ties to the larger index in ``CODES``; a stop gives
    way to the next best."""
    from ..functions.alphabet import CODES

    index = F.array_position(F.array(*map(F.lit, CODES)), F.col("residue"))
    order = Window.partitionBy("path", "column").orderBy((F.col("residue") == stop).cast("int"), F.desc("n"), index.desc(), F.desc("residue"))
    return profile.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("path", "column", "residue")


def seconds(clock: Column) -> Column:
    """hh:mm:ss as seconds."""
    part = F.split(clock, ":")
    return part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")


def contingency(items: DataFrame, group: str, flag: str) -> DataFrame:
    """Per group: flagged and all items in it, flagged and all items over all groups."""
    own = items.groupBy(group).agg(F.count_if(F.col(flag)).alias("k"), F.count(F.lit(1)).alias("n"))
    every = own.agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"))
    return own.join(F.broadcast(every), F.lit(True))


def recruited_reads(contigs: DataFrame, shortest: int = 60) -> DataFrame:
    """One row: reads by the ``reads:`` tags of contigs ``(header, seq)`` of at least ``shortest`` residues."""
    n = F.regexp_extract("header", r"reads:(\d+)", 1).try_cast("long")
    return contigs.where(F.length("seq") >= shortest).agg(F.coalesce(F.sum(n), F.lit(0)).alias("reads"))


def starts_before(rows: DataFrame, order: str, flag: str) -> DataFrame:
    """``rows`` with ``before``: how many flagged rows stand in front of each, without a single-task sort."""
    ranked = numbered(rows, [order], "rank")
    flagged = numbered(ranked.where(flag).select("rank"), ["rank"], "nth").select("rank", "nth")
    # a flagged row's number is known; others take that of the last flagged row in front, found in blocks of ranks
    block = 1 << 16
    joined = ranked.join(flagged, "rank", "left").withColumn("block", F.floor(F.col("rank") / block))
    own = joined.groupBy("block").agg(F.count("nth").alias("k"))
    ahead = own.withColumn("ahead", F.coalesce(F.sum("k").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "ahead")
    inside = F.count("nth").over(Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("in_", inside).join(F.broadcast(ahead), "block").withColumn("before", F.col("ahead") + F.col("in_")).drop("block", "nth", "in_", "ahead", "rank")
