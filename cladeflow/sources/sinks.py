"""Sinks: records as text lines, tables as Parquet or TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fasta_lines(df: DataFrame, header: Column, seq: Column) -> DataFrame:
    """One text row a record (header line and sequence line)."""
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value"))


def contig_header(query: Column, contig: Column, begin: Column, end: Column, e_value: Column, bits: Column, score: Column) -> Column:
    """query||contig_n::begin-end::e::bits::score"""
    text = lambda c: c.cast("string")
    return F.concat(query, F.lit("||contig_"), text(contig), F.lit("::"), text(begin), F.lit("-"), text(end), F.lit("::"), text(e_value), F.lit("::"), text(bits), F.lit("::"), text(score))


def assembled(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Sequences as reported: gaps out, cut at the first '*' unless it is the last character."""
    plain = F.regexp_replace(seq, "-", "")
    stop = F.instr(plain, "*")
    return df.withColumn(seq, F.when((stop > 0) & (stop < F.length(plain)), F.substring_index(plain, "*", 1)).otherwise(plain))


def alignment_blocks(query: Column, target: Column, middle: Column, width: int = 60) -> Column:
    """A pairwise alignment as text, in blocks of ``width`` columns."""
    n = F.ceil(F.length(query) / width).cast("int")
    block = lambda i: F.concat_ws("\n", *[F.substring(c, i * width + 1, F.lit(width)) for c in (query, middle, target)])
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), block), "\n\n")).otherwise(F.lit(""))


def placements_text(df: DataFrame, path: str, read: str, start: str, seq: str) -> DataFrame:
    """Per path, one text of reads indented to where they start.  Gathers a path's reads, which are bounded by its depth."""
    line = F.concat(F.repeat(F.lit(" "), F.col(start).cast("int")), F.col(seq), F.lit("\t"), F.col(read).cast("string"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(start), F.col(read), line.alias("line"))))
    return df.groupBy(path).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge elements of a network file, a text row each; ``nodes(id, label)``, ``edges(source, target, weight)``."""
    text = lambda c: F.col(c).cast("string")
    n = nodes.select(F.format_string('<node id="%s" label="%s"/>', text("id"), text("label")).alias("value"))
    return n.union(edges.select(F.format_string('<edge source="%s" target="%s" weight="%s"/>', text("source"), text("target"), text("weight")).alias("value")))


def tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def index_tables(tables: dict[str, DataFrame], path: str) -> None:
    """An index (reduced map, seed and read extensions, high-score words, graphs) is a folder of Parquet tables."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def load_index(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def longest_first(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.orderBy(F.length(seq).desc(), seq)
