"""Sources: sequence, alignment, profile, matrix and network formats as DataFrames.  gz files are read as they are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.iterate import cut


def numbered(df: DataFrame, order: list[str], name: str = "rid") -> DataFrame:
    """A dense number from 0 in the given order, without a single-task sort: a range shuffle, then running sums of
    partition sizes (one row for each partition)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    # written, so that both uses see the same ranges
    ranged = cut(ranged.withColumn("at_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("n").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part_", "before_")
    return ranged.join(F.broadcast(before), "part_").withColumn(name, F.col("at_") + F.col("before_")).drop("part_", "at_", "before_")


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, header, seq)``: records start with '>', lines that follow are joined; records with an empty header or
    body are skipped.  '>' within a line is no start."""
    return fasta_records(spark.read.text(paths, lineSep="\n>").select(F.input_file_name().alias("file"), "value"))


def fasta_records(chunks: DataFrame) -> DataFrame:
    """From ``(file, value)``, a value per record, as read with the separator newline and '>'."""
    body = F.regexp_replace("value", "^>", "")
    lines = F.split(F.regexp_replace(body, "\r", ""), "\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "")
    return chunks.select("file", F.trim(lines[0]).alias("header"), seq.alias("seq")).where("header <> '' and seq <> ''")


def with_read_ids(records: DataFrame) -> DataFrame:
    """One dense id space over all files, by file and header."""
    return numbered(records, ["file", "header", "seq"])


def sam_headers(lines: DataFrame) -> DataFrame:
    """``(contig, length)`` from @SQ lines of ``lines(value)``."""
    return lines.where(F.startswith("value", F.lit("@SQ"))).select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def sam_rows(lines: DataFrame, mates_mapped: bool = False) -> DataFrame:
    """Mapped primary rows: unmapped, secondary and supplementary ones are dropped, with ``mates_mapped`` also those
    whose mate is unmapped.  ``nm`` is the edit distance, ``xa`` the text of alternatives, wherever they stand."""
    f = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("@"))).select(
        f[0].alias("read"), f[1].cast("int").alias("flag"), f[2].alias("contig"), f[3].cast("long").alias("pos"), f[5].alias("cigar"),
        F.regexp_extract("value", r"\tNM:i:(\d+)", 1).cast("int").alias("nm"), F.regexp_extract("value", r"\tXA:Z:([^\t]+)", 1).alias("xa"),
    )
    return rows.where(F.col("flag").bitwiseAND(0x904 | (8 if mates_mapped else 0)) == 0)


def clipped(cigar: Column) -> Column:
    """Does an alignment hold soft or hard clips, skips or padding?"""
    return cigar.rlike("[SHNP]")


def sam_hits(rows: DataFrame) -> DataFrame:
    """``(read, contig)``: the primary hit and each alternative with no more errors than it, clipped ones left out."""
    alt = rows.where("xa <> ''").select("read", "nm", F.explode(F.split("xa", ";")).alias("a")).where("a <> ''")
    a = F.split("a", ",")
    others = alt.select("read", "nm", a[0].alias("contig"), a[2].alias("cigar"), a[3].cast("int").alias("own"))
    first = rows.where(~clipped(F.col("cigar"))).select("read", "contig")
    return first.union(others.where((F.col("own") <= F.col("nm")) & ~clipped(F.col("cigar"))).select("read", "contig"))


def id_map(lines: DataFrame) -> DataFrame:
    """``(contig, genome, genome_index)`` from pairs between white space; genomes numbered from 1 in order."""
    f = F.split(F.trim("value"), r"\s+")
    pairs = lines.where(F.trim("value") != "").select(f[0].alias("contig"), f[1].alias("genome"))
    index = numbered(pairs.select("genome").distinct(), ["genome"], "i").select("genome", (F.col("i") + 1).alias("genome_index"))
    return pairs.join(index, "genome").select("contig", "genome", "genome_index")


def sparse_matrix(lines: DataFrame) -> DataFrame:
    """``(row, col, value)`` from lines of a row id, a tab and col:value pairs; '#' lines are headers."""
    f = F.split("value", r"\t")
    cells = lines.where(~F.startswith("value", F.lit("#"))).select(f[0].cast("long").alias("row"), F.explode(F.split(F.trim(f[1]), r"\s+")).alias("cell")).where("cell <> ''")
    return cells.select("row", F.split("cell", ":")[0].cast("long").alias("col"), F.split("cell", ":")[1].cast("double").alias("value"))


def wide_matrix(df: DataFrame, key: str, name: str = "taxon", value: str = "value") -> DataFrame:
    """A wide sample table in long form."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in rest]).unpivot(key, rest, name, value)


def correlation_edges(df: DataFrame, key: str, least: float) -> DataFrame:
    """Undirected edges (source < target) of a square matrix with \\|w\\| of at least ``least``."""
    long = wide_matrix(df, key, "target", "weight").withColumnRenamed(key, "source")
    return long.where((F.col("source") < F.col("target")) & (F.abs("weight") >= least))


def gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a network file, attributes as strings by their declared id."""
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").load(path)
    return read("node"), read("edge")


def stockholm(spark: SparkSession, path: str) -> DataFrame:
    """``(id, accession, consensus)`` of alignments that end with '//'; gaps are stripped from the consensus."""
    blocks = spark.read.text(path, lineSep="//\n").where(F.col("value").contains("#=GF"))
    tag = lambda t: F.regexp_extract("value", rf"(?m)^#=GF {t}\s+(\S+)", 1)
    consensus = F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^#=GC seq_cons\s+(\S+)"), F.lit(1)), "")
    return blocks.select(tag("ID").alias("id"), tag("AC").alias("accession"), F.regexp_replace(consensus, r"[.-]", "").alias("consensus"))


def hmm_profiles(spark: SparkSession, path: str) -> DataFrame:
    """HMMER3 models, one row each: name, length, mu and lambda of local Viterbi, and per state the match and insert
    emissions and the transitions, as negative logs times 100000 ('*' as the largest int)."""
    texts = spark.read.text(path, lineSep="//\n").where(F.col("value").rlike(r"(?m)^NAME"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([parse_hmm(x) for x in pdf["value"]], columns=["name", "length", "mu", "lambda", "match", "insert", "transition"])

    kind = "array<array<int>>"
    return texts.mapInPandas(run, f"name string, length int, mu double, lambda double, match {kind}, insert {kind}, transition {kind}")


def parse_hmm(text: str) -> tuple:
    scaled = lambda x: 2**31 - 1 if x == "*" else round(float(x) * 100000)
    head, rows, body = {}, [], False
    for line in text.splitlines():
        words = line.split()
        if not words:
            continue
        if body:
            rows.append(words)
        elif words[0] == "HMM":
            body = True
        elif words[0] == "STATS" and words[1:3] == ["LOCAL", "VITERBI"]:
            head["mu"], head["lambda"] = float(words[3]), float(words[4])
        elif words[0] in ("NAME", "LENG"):
            head[words[0]] = words[1]
    rows = [r for r in rows[1:] if r[0] != "COMPO"]  # the first row names the transitions
    insert, moves = [list(map(scaled, rows[0]))], [list(map(scaled, rows[1]))]
    match: list[list[int]] = []
    for i in range(2, len(rows) - 2, 3):
        match.append([scaled(x) for x in rows[i][1:21]])
        insert.append([scaled(x) for x in rows[i + 1][:20]])
        moves.append([scaled(x) for x in rows[i + 2][:7]])
    return head["NAME"], int(head["LENG"]), head.get("mu"), head.get("lambda"), match, insert, moves


def parameters(lines: DataFrame) -> DataFrame:
    """``(key, value)`` from KEY=VALUE or tab-separated lines; '#' starts a comment."""
    plain = F.trim(F.regexp_replace("value", "#.*$", ""))
    f = F.split(plain, r"\s*=\s*|\t+", 2)
    return lines.where(plain != "").select(f[0].alias("key"), F.get(f, F.lit(1)).alias("value"))
