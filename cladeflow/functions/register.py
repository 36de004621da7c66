"""The library's functions as SQL functions of a session: ``register(spark)``, then ``SELECT cf_bit_score(...)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession, functions as F

from . import alphabet

#: Expressions in SQL, inlined by the optimiser as if they had been written out.
EXPRESSIONS = {
    "cf_peptide(t STRING) RETURNS STRING": "regexp_replace(upper(regexp_replace(coalesce(t, ''), '[^A-Za-z]', '')), '[^ACDEFGHIKLMNPQRSTVWY]', '')",
    "cf_bit_score(score DOUBLE, lambda DOUBLE, k DOUBLE) RETURNS DOUBLE": "(lambda * score - ln(k)) / ln(2)",
    "cf_evalue(score DOUBLE, lambda DOUBLE, k DOUBLE, m DOUBLE, n DOUBLE) RETURNS DOUBLE": "k * m * n * exp(-lambda * score)",
    "cf_overlap(a BIGINT, b BIGINT, c BIGINT, d BIGINT) RETURNS BIGINT": "greatest(0, least(b, d) - greatest(a, c) + 1)",
}


class Kmers:
    """Table function: ``(pos, kmer)`` of a sequence."""

    def eval(self, seq: str, k: int):
        for i in range(len(seq or "") - k + 1):
            yield i + 1, seq[i : i + k]


def register(spark: SparkSession) -> list[str]:
    """Register all; returns their names."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name in alphabet.ALPHABETS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cf_reduced_{name.lower()}(s STRING) RETURNS STRING RETURN translate(s, '{alphabet.RESIDUES}', '{alphabet.classes(name)}')")
    spark.udtf.register("cf_kmers", F.udtf(Kmers, returnType="pos int, kmer string"))
    return [h.split("(")[0] for h in EXPRESSIONS] + [f"cf_reduced_{n.lower()}" for n in alphabet.ALPHABETS] + ["cf_kmers"]


def register_series(spark: SparkSession, name: str, returns: str, function: Callable) -> None:
    """An own function over pandas series under a name; values move in Arrow batches."""
    spark.udf.register(name, F.pandas_udf(function, returns))
