"""Regex matches with their places, as Spark SQL expressions only.

Spark's ``regexp_extract_all`` gives matches, ``split`` by the same pattern gives what lies between them; both walk the
text with the same Java matcher, so running sums of their lengths are the places.  Offsets are code points, end
exclusive.  Patterns must not match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


#: Matches of a block: running sums are taken inside blocks and over blocks, so their cost grows with the number of
#: matches times BLOCK, not with its square.
BLOCK = 64


def running(sizes: Column) -> Column:
    """Array of the sums up to and including each entry of an array of integers."""
    sums = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))
    starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    inner = F.transform(starts, lambda b: sums(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))

    def over(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.element_at(b, -1))
        return F.flatten(F.zip_with(blocks, F.slice(F.concat(F.array(F.lit(0)), sums(ends)), F.lit(1), F.size(blocks)), lambda b, before: F.transform(b, lambda x: x + before)))

    return F.when(F.size(sizes) > 0, kept(inner, over)).otherwise(F.array().cast("array<int>"))


def kept(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def located(text: Column, pattern: str, context: int = 32) -> Column:
    """Array of (start, end, text, before, after): ``context`` code points on both sides, over the neighbouring match and
    the gap beyond it (positions are never walked to from the start of the text)."""
    tail = lambda c: F.right(c, F.lit(context))
    head = lambda c: F.substring(c, 1, context)
    nothing = F.struct(F.lit(0).alias("n"), F.lit("").alias("tail"), F.lit("").alias("head"))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), tail(g).alias("tail"), head(g).alias("head")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(both: Column) -> Column:
        m, g = both["m"], both["g"]
        n = F.size(m)
        few = F.greatest(n - 1, F.lit(0))
        row = F.arrays_zip(
            m,
            F.slice(g, F.lit(1), n),
            F.slice(g, F.lit(2), n),
            F.concat(F.array(F.lit("")), F.slice(m, F.lit(1), few)),
            F.concat(F.array(nothing), F.slice(g, F.lit(1), few)),
            F.concat(F.slice(m, F.lit(2), few), F.array(F.lit(""))),
            F.concat(F.slice(g, F.lit(3), few), F.array(nothing)),
            running(F.zip_with(F.slice(g, F.lit(1), n), m, lambda x, y: x["n"] + F.length(y))),
        )

        def one(x: Column) -> Column:
            before = tail(F.concat(x["4"]["tail"], tail(x["3"]), x["1"]["tail"]))
            after = head(F.concat(x["2"]["head"], head(x["5"]), x["6"]["head"]))
            return F.struct((x["7"] - F.length(x["m"])).alias("start"), x["7"].alias("end"), x["m"].alias("text"), before.alias("before"), after.alias("after"))

        return F.transform(row, one)

    none = F.array().cast(SPAN)
    return kept(found, lambda m: F.when(F.size(m) > 0, kept(F.struct(m.alias("m"), gaps.alias("g")), spans)).otherwise(none))
