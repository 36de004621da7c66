"""Abundance of genomes from read hits (read, genome)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.iterate import cut


def genome_lengths(contigs: DataFrame, id_map: DataFrame) -> DataFrame:
    return contigs.join(id_map, "contig").groupBy("genome").agg(F.sum("length").alias("length"))


def normalised(shares: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(genome, abundance)``: shares by genome length, made to sum to 1."""
    by = shares.join(lengths, "genome").withColumn("r", F.col("share") / F.col("length"))
    total = by.agg(F.sum("r").alias("total"))
    return by.join(F.broadcast(total), F.lit(True)).select("genome", (F.col("r") / F.col("total")).alias("abundance"))


def even_split(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """A read with N hits gives 1/N to each."""
    n = hits.groupBy("read").agg(F.count(F.lit(1)).alias("n"))
    return normalised(hits.join(n, "read").groupBy("genome").agg(F.sum(1 / F.col("n")).alias("share")), lengths)


def multiple_count(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Each hit counts as one."""
    return normalised(hits.groupBy("genome").agg(F.count(F.lit(1)).cast("double").alias("share")), lengths)


def patterns(hits: DataFrame) -> DataFrame:
    """Reads with the same hits are one pattern with a weight: EM runs over ``(pattern, genome, a, weight)``.

    ``a`` is the number of hits of the read on the genome.  A read's hits are few, so gathering them is bounded by it.
    """
    cells = hits.groupBy("read", "genome").agg(F.count(F.lit(1)).cast("double").alias("a"))
    rows = cells.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("genome", "a"))).alias("cells"))
    kinds = rows.groupBy("cells").agg(F.count(F.lit(1)).alias("weight")).withColumn("pattern", F.xxhash64("cells"))
    return kinds.select("pattern", "weight", F.explode("cells").alias("c")).select("pattern", "weight", F.col("c.genome").alias("genome"), F.col("c.a").alias("a"))


def e_step(cells: DataFrame, mixing: DataFrame) -> DataFrame:
    """Posteriors ``r`` of each cell under mixing weights ``(genome, pi)``."""
    joint = cells.join(mixing, "genome").withColumn("q", F.col("pi") * F.col("a"))
    return joint.withColumn("r", F.col("q") / F.sum("q").over(Window.partitionBy("pattern")))


def m_step(posterior: DataFrame, reads: float) -> DataFrame:
    """New mixing weights; posteriors sum to the number of reads."""
    return posterior.groupBy("genome").agg((F.sum(F.col("r") * F.col("weight")) / reads).alias("pi"))


def uniform(cells: DataFrame) -> DataFrame:
    genomes = cells.select("genome").distinct()
    n = genomes.agg(F.count(F.lit(1)).alias("n"))
    return genomes.join(F.broadcast(n), F.lit(True)).select("genome", (1.0 / F.col("n")).alias("pi"))


def column_sums(cells: DataFrame) -> DataFrame:
    """Start weights by summed hits."""
    sums = cells.groupBy("genome").agg(F.sum(F.col("a") * F.col("weight")).alias("s"))
    return sums.join(F.broadcast(sums.agg(F.sum("s").alias("n"))), F.lit(True)).select("genome", (F.col("s") / F.col("n")).alias("pi"))


def expectation_maximisation(hits: DataFrame, rounds: int = 10000, tolerance: float = 1e-6, start=uniform, every: int = 5) -> DataFrame:
    """Mixing weights ``(genome, pi)`` after ``rounds`` rounds, or when their mean absolute change is below ``tolerance``
    (0: never).  Lineage is cut by written tables."""
    cells = patterns(hits).cache()
    reads = float(cells.select("pattern", "weight").distinct().agg(F.sum("weight")).first()[0] or 0)
    mixing = start(cells)
    for i in range(1, rounds + 1):
        new = m_step(e_step(cells, mixing), reads)
        if i % every == 0:
            new = cut(new)
        if tolerance and i > 1 and i % every == 0:
            change = new.join(mixing.withColumnRenamed("pi", "old"), "genome").agg(F.avg(F.abs(F.col("pi") - F.col("old")))).first()[0]
            if change is None or change < tolerance:
                return new
        mixing = new
    return mixing


def log_likelihood(cells: DataFrame, mixing: DataFrame) -> DataFrame:
    q = cells.join(mixing, "genome").groupBy("pattern", "weight").agg(F.sum(F.col("pi") * F.col("a")).alias("q"))
    return q.where("q > 0").agg(F.sum(F.col("weight") * F.ln("q")).alias("log_likelihood"))


def assignments(hits: DataFrame, mixing: DataFrame) -> DataFrame:
    """``(read, genome)``: the genome with the largest posterior, ties to the smaller."""
    cells = hits.groupBy("read", "genome").agg(F.count(F.lit(1)).cast("double").alias("a")).join(mixing, "genome")
    best = F.min(F.struct((-F.col("pi") * F.col("a")).alias("q"), F.col("genome")))
    return cells.groupBy("read").agg(best.alias("b")).select("read", F.col("b.genome").alias("genome"))


def drawn(share: float, seed: int | Column) -> Column:
    """How often a read is drawn with replacement: Poisson(share), from a hash of ``read`` and seed."""
    import math

    u = (F.pmod(F.xxhash64("read", seed if isinstance(seed, Column) else F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    total, n = 0.0, F.lit(0)
    for k in range(8):
        total += math.exp(-share) * share**k / math.factorial(k)
        n = n + (u >= total).cast("int")
    return n


def resampled(hits: DataFrame, share: float, seed: int | Column) -> DataFrame:
    """Reads drawn with replacement (see ``drawn``); a read drawn twice counts twice."""
    return hits.withColumn("times", drawn(share, seed)).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("read", F.concat_ws("#", F.col("read").cast("string"), "copy")).drop("times", "copy")


def subsampled(hits: DataFrame, share: float, seed: int) -> DataFrame:
    """Hits of exactly floor(share * n) of the n reads, drawn without replacement: those first in order of a hash."""
    from ..sources.readers import numbered

    reads = hits.select("read").distinct().withColumn("hash_", F.xxhash64("read", F.lit(seed)))
    most = int(share * reads.count())
    drawn = numbered(reads, ["hash_", "read"], "rank_").where(F.col("rank_") < most).select("read")
    return hits.join(drawn, "read", "left_semi")


def bootstrap(hits: DataFrame, lengths: DataFrame, replicates: int, share: float, rounds: int = 10000, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """``(replicate, genome, abundance)``: length-corrected abundances of EM runs over resampled reads.

    Reads with the same hits are one pattern with a weight for each replicate, so hits are gathered once, not once a
    replicate.  A round is one pass over the patterns for all replicates; what it sends to the driver, and gets from there,
    are replicates x genomes numbers a task.  Rounds end when the mean change of each replicate is below the tolerance.
    """
    import numpy as np
    import pyarrow as pa

    spark = hits.sparkSession
    each = hits.groupBy("read", "genome").agg(F.count(F.lit(1)).cast("double").alias("a"))
    rows = each.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("genome", "a"))).alias("cells"))
    times = [drawn(share, F.lit(i)).alias(f"t{i}") for i in range(replicates)]
    kinds = rows.select("cells", *times).groupBy("cells").agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(replicates)])
    kinds = cut(kinds.select("cells", F.array(*[F.col(f"t{i}").cast("double") for i in range(replicates)]).alias("weights")))
    names = [r[0] for r in kinds.select(F.explode("cells.genome").alias("g")).distinct().orderBy("g").collect()]
    kind, at = dict(hits.dtypes)["genome"], {g: i for i, g in enumerate(names)}
    table = kinds.select(F.col("cells.genome").alias("genome"), F.col("cells.a").alias("a"), "weights")

    def summed(pi: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of posteriors by replicate and genome; without weights ``pi``: the reads on each."""
        sent = spark.sparkContext.broadcast((at, pi))

        def run(batches):
            at, pi = sent.value
            total, seen = np.zeros((replicates, len(at))), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column(0)
                own = np.fromiter(map(at.__getitem__, lists.flatten().to_pylist()), np.int64)
                a = batch.column(1).flatten().to_numpy()
                weights = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, replicates)
                n = np.diff(lists.offsets.to_numpy())
                heads, which = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
                seen = seen + weights.sum(0)
                for r in range(replicates):
                    q = weights[which, r]
                    if pi is not None:
                        q = np.where(q > 0, pi[r, own] * a, 0.0)
                        whole = np.add.reduceat(q, heads)
                        q *= (weights[:, r] / np.where(whole > 0, whole, 1.0))[which]
                    total[r] += np.bincount(own, q, len(at))
            r, g = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(g), pa.array(total[r, g])], ["r", "g", "s"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(np.full(replicates, -1)), pa.array(np.zeros(replicates) + seen)], ["r", "g", "s"])

        got = table.mapInArrow(run, "r long, g long, s double").groupBy("r", "g").agg(F.sum("s").alias("s")).toPandas()
        out, reads = np.zeros((replicates, len(at))), np.zeros(replicates)
        cell = got["g"] >= 0
        out[got["r"][cell], got["g"][cell]] = got["s"][cell]
        reads[got["r"][~cell]] = got["s"][~cell]
        sent.destroy()
        return out, reads

    seen, reads = summed(None)
    there = seen > 0
    pi = there / np.maximum(there.sum(1, keepdims=True), 1)
    for i in range(1, rounds + 1):
        new = summed(pi)[0] / np.maximum(reads, 1)[:, None]
        gap = (np.abs(new - pi).sum(1) / np.maximum(there.sum(1), 1)).max(initial=0.0)
        pi = new
        if tolerance and i % every == 0 and gap < tolerance:
            break
    r, g = np.nonzero(there)
    schema = f"replicate int, genome {kind}, pi double"
    mixing = spark.createDataFrame([(int(x), names[y], float(pi[x, y])) for x, y in zip(r, g, strict=True)], schema)
    by = mixing.join(lengths, "genome").withColumn("r", F.col("pi") / F.col("length"))
    return by.select("replicate", "genome", (F.col("r") / F.sum("r").over(Window.partitionBy("replicate"))).alias("abundance"))


def percentile_interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """Elements at index round(n * q) - 1 of a genome's sorted replicates, at least the first."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    pis = F.array_sort(F.collect_list("abundance"))  # as many as there are replicates
    at = lambda q: F.element_at(F.col("p"), F.greatest(F.round(F.size("p") * q), F.lit(1)).cast("int"))
    return replicates.groupBy("genome").agg(pis.alias("p")).select("genome", at(lo).alias("low"), at(hi).alias("high"))
