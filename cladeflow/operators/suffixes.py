"""Suffix order of sequences by prefix doubling, common prefixes of neighbours, and searches for words of any length.

No suffix is ever a row of its own text while it is ranked: a suffix is (rid, pos) with the rank of its first h residues;
joining it with the rank at pos + h gives the ranks of the first 2h.  So data stay in proportion to the sequences, over
as many rounds as the logarithm of the longest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.iterate import cut, discard
from ..sources.readers import numbered
from . import kmers

FIRST = 8


def suffix_order(seqs: DataFrame) -> DataFrame:
    """``(rid, pos, rank)`` of every suffix, pos from 1, rank from 0: in order of the suffixes, equal ones by rid and pos."""
    longest = seqs.agg(F.max(F.length("seq"))).first()[0] or 0
    padded = seqs.select("rid", F.concat("seq", F.lit(" " * (FIRST - 1))).alias("seq"))  # a blank is below every letter
    state = cut(padded.transform(lambda d: kmers.kmers(d, FIRST)).select("rid", "pos", F.col("kmer").alias("key")))
    codes = numbered(state.select("key").distinct(), ["key"], "code")
    state = cut(state.join(codes, "key").select("rid", "pos", "code"))
    h = FIRST
    while h < longest:
        later = state.select("rid", (F.col("pos") - h).alias("pos"), F.col("code").alias("next"))
        both = cut(state.join(later, ["rid", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long"))))
        codes = numbered(both.select("code", "next").distinct(), ["code", "next"], "new")
        last, state = state, cut(both.join(codes, ["code", "next"]).select("rid", "pos", F.col("new").alias("code")))
        discard(last)
        h *= 2
    return cut(numbered(state, ["code", "rid", "pos"], "rank").select("rid", "pos", "rank"))


def common_prefixes(order: DataFrame, seqs: DataFrame) -> DataFrame:
    """``order`` with ``length`` of each suffix and ``lcp``: residues it shares with the suffix in front (0 for the first).
    Only neighbours meet, by their ranks."""
    text = order.join(seqs.select("rid", "seq"), "rid").select("rid", "pos", "rank", F.substr("seq", F.col("pos").cast("int")).alias("suffix"))
    text = cut(text)
    before = text.select((F.col("rank") + 1).alias("rank"), F.col("suffix").alias("front"))
    n = F.least(F.length("suffix"), F.length("front"))
    same = F.zip_with(F.split(F.left("suffix", n), ""), F.split(F.left("front", n), ""), lambda x, y: x == y)
    stop = F.array_position(same, False)
    lcp = F.when(F.col("front").isNull() | (n == 0), 0).when(stop > 0, stop - 1).otherwise(n).cast("long")
    return text.join(before, "rank", "left").select("rid", "pos", "rank", F.length("suffix").cast("long").alias("length"), lcp.alias("lcp"))


def block_ends(order: DataFrame) -> DataFrame:
    """``(rid, pos, rank, length, block)``: suffixes that are no prefix of the next one, each the longest extension of the
    run of suffixes that it ends; ``block`` numbers the runs.  ``order`` is that of ``common_prefixes``."""
    after = order.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("next"))
    ends = order.join(after, "rank", "left").where(F.coalesce("next", F.lit(-1).cast("long")) < F.col("length"))
    return numbered(ends.select("rid", "pos", "rank", "length"), ["rank"], "block")


def prefix_search(words: DataFrame, seqs: DataFrame) -> DataFrame:
    """``(word, rid, pos)``: where the words ``(word)``, of any lengths, stand in the sequences; a join for each length."""
    found = seqs.sparkSession.createDataFrame([], f"word string, rid {seqs.schema['rid'].dataType.simpleString()}, pos long")
    distinct = cut(words.select("word").where(F.length("word") > 0).distinct())
    for (k,) in distinct.select(F.length("word")).distinct().collect():  # as many as there are lengths
        own = distinct.where(F.length("word") == k)
        found = found.unionByName(kmers.kmers(seqs, k).join(own, F.col("kmer") == F.col("word")).select("word", "rid", "pos"))
    return found
