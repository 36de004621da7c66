"""Community statistics over long tables (cohort, sample, taxon, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.iterate import cut


def relative(df: DataFrame, by: list[str] = ("sample",), value: str = "value") -> DataFrame:
    """Values as shares of their row (sample)."""
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*by)))


def clr(df: DataFrame, floor: float = 1e-10) -> DataFrame:
    """Centred log ratio within a sample; zeros count as ``floor``."""
    x = F.ln(F.when(F.col("value") == 0, floor).otherwise(F.col("value")))
    return df.withColumn("clr", x - F.avg(x).over(Window.partitionBy("sample")))


def prevalence(df: DataFrame) -> DataFrame:
    """Per cohort and taxon: share of samples with it, mean over samples that have it; taxa nowhere found are dropped."""
    out = df.groupBy("cohort", "taxon").agg(F.avg((F.col("value") > 0).cast("double")).alias("prevalence"), F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("mean_present"))
    return out.where(F.col("prevalence") > 0)


def core_abundance(df: DataFrame, core: DataFrame) -> DataFrame:
    """Per sample the sum over core taxa (0 where it has none)."""
    kept = df.join(core.select("taxon").distinct().withColumn("core", F.lit(True)), "taxon", "left")
    return kept.groupBy("sample").agg(F.sum(F.when(F.col("core"), F.col("value")).otherwise(0.0)).alias("core"))


def exclusive(df: DataFrame) -> DataFrame:
    """Per cohort: its taxa, those found in no other, and the rest, shared with one other or more."""
    found = df.where("value > 0").select("cohort", "taxon").distinct()
    spread = found.groupBy("taxon").agg(F.count(F.lit(1)).alias("in"))
    each = found.join(spread, "taxon")
    return each.groupBy("cohort").agg(F.count(F.lit(1)).alias("taxa"), F.count_if(F.col("in") == 1).alias("unique"), F.count_if(F.col("in") > 1).alias("shared"))


def common_taxa(df: DataFrame) -> DataFrame:
    """Taxa found in every cohort."""
    found = df.where("value > 0").select("cohort", "taxon").distinct()
    total = found.agg(F.count_distinct("cohort").alias("all"))
    return found.groupBy("taxon").agg(F.count(F.lit(1)).alias("in")).join(F.broadcast(total), F.col("in") == F.col("all")).select("taxon")


def last_values(rows: DataFrame, samples: list[str]) -> DataFrame:
    """``(key, <samples>...)`` from ``(sample, taxon, gene, line, n)``: of a sample's lines with one taxon and gene the
    last counts; 0 where a sample has none."""
    last = rows.groupBy(F.concat_ws("||", "taxon", "gene").alias("key"), "sample").agg(F.max_by("n", "line").alias("n"))
    return last.groupBy("key").pivot("sample", samples).agg(F.first("n")).na.fill(0)


def strain_weights(df: DataFrame) -> DataFrame:
    """``(species, strain, weight)``: a strain's mean as a share of its species; a lone strain has 1."""
    mean = df.groupBy("species", "strain").agg(F.avg("value").alias("mean"))
    total, n = F.sum("mean").over(Window.partitionBy("species")), F.count(F.lit(1)).over(Window.partitionBy("species"))
    return mean.withColumn("weight", F.when(n == 1, 1.0).otherwise(F.col("mean") / total)).select("species", "strain", "weight")


def weighted_profile(features: DataFrame, weights: DataFrame) -> DataFrame:
    """``(species, feature, share)``: strain profiles, each normalised, weighted, summed by species and normalised."""
    own = features.withColumn("p", F.col("value") / F.sum("value").over(Window.partitionBy("strain"))).join(weights, "strain")
    summed = own.groupBy("species", "feature").agg(F.sum(F.col("p") * F.col("weight")).alias("w"))
    return summed.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("species"))).select("species", "feature", "share")


def bray_curtis(df: DataFrame) -> DataFrame:
    """``(a, b, distance)`` for a < b: sum |u - v| / sum (u + v).

    Only taxa that both samples hold meet in a join: sum |u - v| = U + V - 2 * sum min(u, v).  Values are not negative.
    """
    own = df.where("value > 0").groupBy("sample", "taxon").agg(F.sum("value").alias("value"))
    totals = df.groupBy("sample").agg(F.sum("value").alias("total"))
    x, y = own.select(F.col("sample").alias("a"), "taxon", F.col("value").alias("u")), own.select(F.col("sample").alias("b"), "taxon", F.col("value").alias("v"))
    common = x.join(y, "taxon").where("a < b").groupBy("a", "b").agg(F.sum(F.least("u", "v")).alias("common"))
    pairs = totals.select(F.col("sample").alias("a"), F.col("total").alias("ta")).join(totals.select(F.col("sample").alias("b"), F.col("total").alias("tb")), F.col("a") < F.col("b"))
    d = F.when(F.col("ta") + F.col("tb") == 0, 0.0).otherwise((F.col("ta") + F.col("tb") - 2 * F.coalesce("common", F.lit(0.0))) / (F.col("ta") + F.col("tb")))
    return pairs.join(common, ["a", "b"], "left").select("a", "b", d.alias("distance"))


def recruit_table(hits: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of rows by column values, with zeros."""
    return hits.groupBy(row).pivot(col, values).count().na.fill(0)


def percentages(df: DataFrame, by: str, item: str) -> DataFrame:
    """``(by, item, n, percent)``: counts and their share of the group, in percent."""
    n = df.groupBy(by, item).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def benjamini_hochberg(df: DataFrame, p: str = "p", key: str = "feature") -> DataFrame:
    """``q``: the least p * m / rank over ranks from this one up, at most 1.

    Equal p-values are counted together first; distinct ones lie in ranges, in which sums and minima run, and what the
    ranges in front and behind add is one row a range.  Null p-values have no q and don't count.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p_")).agg(F.count(F.lit(1)).alias("n_"))
    ranged = cut(counts.repartitionByRange("p_").withColumn("part_", F.spark_partition_id()))
    own = Window.partitionBy("part_")
    sums = ranged.groupBy("part_").agg(F.sum("n_").alias("s_"))
    order = Window.orderBy("part_")  # a row is a range
    front = sums.select("part_", (F.sum("s_").over(order) - F.col("s_")).alias("front_"), F.sum("s_").over(Window.partitionBy()).alias("m_"))
    ranked = ranged.join(F.broadcast(front), "part_").withColumn("rank_", F.col("front_") + F.sum("n_").over(own.orderBy("p_")))
    raw = cut(ranked.select("part_", "p_", (F.col("p_") * F.col("m_") / F.col("rank_")).alias("raw_")))
    least = raw.groupBy("part_").agg(F.min("raw_").alias("l_"))
    behind = least.select("part_", F.min("l_").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("behind_"))
    q = raw.join(F.broadcast(behind), "part_").withColumn("q", F.least(F.lit(1.0), F.min("raw_").over(own.orderBy(F.desc("p_"))), F.coalesce("behind_", F.lit(1.0))))
    return df.join(q.select("p_", "q"), F.col(p) == F.col("p_"), "left").drop("p_")


def two_group_tests(df: DataFrame) -> DataFrame:
    """``(feature, t, u, p)`` from ``(feature, grp, value)`` with groups 0 and 1: Welch's t, the Mann-Whitney U and its
    normal p-value with tie correction.  Ranks come from counts of distinct values, so a feature's rows never meet in
    one Python task."""
    counts = df.groupBy("feature", "value").agg(F.count_if(F.col("grp") == 0).alias("n0"), F.count_if(F.col("grp") == 1).alias("n1"))
    on = Window.partitionBy("feature").orderBy("value")
    c = F.col("n0") + F.col("n1")
    mid = counts.withColumn("below", F.sum(c).over(on) - c).withColumn("rank", F.col("below") + (c + 1) / 2).withColumn("ties", c * c * c - c)
    u = mid.groupBy("feature").agg(F.sum(F.col("n0") * F.col("rank")).alias("r0"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("ties").alias("ties"))
    n = F.col("n0") + F.col("n1")
    stat = u.withColumn("u", F.col("r0") - F.col("n0") * (F.col("n0") + 1) / 2)
    sigma = F.sqrt(F.col("n0") * F.col("n1") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    stat = stat.withColumn("z", (F.abs(F.col("u") - F.col("n0") * F.col("n1") / 2)) / sigma)
    moments = df.groupBy("feature").agg(*[f(F.when(F.col("grp") == g, F.col("value"))).alias(f"{name}{g}") for g in (0, 1) for name, f in (("mean", F.avg), ("var", F.var_samp), ("k", F.count))])
    t = (F.col("mean0") - F.col("mean1")) / F.sqrt(F.col("var0") / F.col("k0") + F.col("var1") / F.col("k1"))
    joined = stat.join(moments, "feature")
    return joined.select("feature", t.alias("t"), "u", (2 * (1 - normal_cdf(F.col("z")))).alias("p"))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t: the incomplete beta function at df / (df + t^2), by its continued fraction."""
    import math

    if not (df > 0) or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x > 0 else 0.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def welch_tests(df: DataFrame) -> DataFrame:
    """``(feature, t, df, p)`` from ``(feature, grp, value)``: Welch's t with its degrees of freedom and p-value; moments
    are aggregated, and only a row a feature goes through Python."""
    m = df.groupBy("feature").agg(*[f(F.when(F.col("grp") == g, F.col("value"))).alias(f"{name}{g}") for g in (0, 1) for name, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    s0, s1 = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    free = (s0 + s1) * (s0 + s1) / (s0 * s0 / (F.col("n0") - 1) + s1 * s1 / (F.col("n1") - 1))
    rows = m.where("n0 > 1 and n1 > 1 and (var0 > 0 or var1 > 0)").select("feature", ((F.col("mean0") - F.col("mean1")) / F.sqrt(s0 + s1)).alias("t"), free.alias("df"))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(p=[student_p(t, d) for t, d in zip(pdf["t"], pdf["df"], strict=True)])

    return rows.mapInPandas(run, f"feature {df.schema['feature'].dataType.simpleString()}, t double, df double, p double")


def normal_cdf(z):
    """Abramowitz and Stegun 26.2.17, absolute error below 7.5e-8; for z of 0 or more."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / (2 * np.pi) ** 0.5 * poly


def pcoa(distances: DataFrame, axes: int = 3, most: int = 5000) -> pd.DataFrame:
    """Principal coordinates of ``(a, b, distance)``, on the driver: an n x n matrix of samples, n at most ``most``."""
    rows = distances.limit(most * most // 2 + 1).toPandas()
    names = sorted({*rows["a"], *rows["b"]})
    if len(names) > most:
        raise ValueError(f"{len(names)} samples; principal coordinates take up to {most}")
    at = {x: i for i, x in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for a, b, x in rows[["a", "b", "distance"]].itertuples(index=False):
        d[at[a], at[b]] = d[at[b], at[a]] = x
    j = np.eye(len(names)) - 1 / max(1, len(names))
    values, vectors = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    order = np.argsort(values)[::-1][:axes]
    coords = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return pd.DataFrame(coords, index=names, columns=[f"axis{i + 1}" for i in range(coords.shape[1])])


def principal_components(df: DataFrame, features: str, k: int):
    """Centred principal components of an array column: (model, transformed)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    points = df.withColumn("point", array_to_vector(F.col(features)))
    scaler = StandardScaler(inputCol="point", outputCol="centred", withMean=True, withStd=False).fit(points)
    model = PCA(k=k, inputCol="centred", outputCol="scores").fit(scaler.transform(points))
    return model, model.transform(scaler.transform(points))


def forest_importance(df: DataFrame, label: str, features: list[str], trees: int = 500, seed: int = 1):
    """Random forest on 70 % of the rows: (importances by feature, accuracy on the others)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    points = VectorAssembler(inputCols=features, outputCol="point").transform(df)
    points = StringIndexer(inputCol=label, outputCol="class").fit(points).transform(points)
    train, test = points.randomSplit([0.7, 0.3], seed)
    model = RandomForestClassifier(labelCol="class", featuresCol="point", numTrees=trees, seed=seed).fit(train)
    right = model.transform(test).agg(F.avg((F.col("prediction") == F.col("class")).cast("double"))).first()[0]
    return dict(zip(features, model.featureImportances.toArray().tolist(), strict=True)), right


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r and the slope's standard error."""
    out = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    error = F.sqrt((1 - F.col("r") * F.col("r")) * F.col("syy") / F.col("sxx") / (F.col("n") - 2))
    return out.select("slope", "intercept", "r", error.alias("stderr"))
