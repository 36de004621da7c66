"""Substitution scores and alignment statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: BLOSUM62, lower triangle in the order of the residues below.
ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62_ROWS = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
#: Fixed values: (gap open, gap extend) -> (lambda, K, H); (None, None) is ungapped.
KARLIN = {
    "BLOSUM62": {(None, None): (0.318, 0.134, 0.401), (11, 2): (0.297, 0.082, 0.27), (10, 2): (0.291, 0.075, 0.23), (12, 1): (0.283, 0.059, 0.19), (9, 2): (0.279, 0.058, 0.19), (8, 2): (0.264, 0.045, 0.15), (11, 1): (0.267, 0.041, 0.14), (10, 1): (0.243, 0.024, 0.10), (7, 2): (0.239, 0.027, 0.10), (6, 2): (0.201, 0.012, 0.061), (9, 1): (0.206, 0.010, 0.052)},
    "BLOSUM80": {(None, None): (0.343, 0.177, 0.657), (25, 2): (0.342, 0.17, 0.66), (13, 2): (0.336, 0.15, 0.57), (9, 2): (0.319, 0.11, 0.42), (11, 1): (0.314, 0.095, 0.35), (8, 2): (0.308, 0.090, 0.35), (10, 1): (0.299, 0.071, 0.27), (7, 2): (0.293, 0.070, 0.27), (9, 1): (0.279, 0.048, 0.20), (6, 2): (0.268, 0.045, 0.19)},
    "BLOSUM90": {(None, None): (0.335, 0.190, 0.755), (9, 2): (0.310, 0.12, 0.46), (11, 1): (0.302, 0.093, 0.39), (8, 2): (0.300, 0.099, 0.39), (7, 2): (0.283, 0.072, 0.30), (10, 1): (0.290, 0.075, 0.28), (6, 2): (0.259, 0.048, 0.22), (9, 1): (0.265, 0.044, 0.20)},
}


#: BLOSUM62 rows of the codes for N or D, I or L, Q or E, in the order of the residues and then of the codes.
AMBIGUOUS = "BJZ"
BLOSUM62_AMBIGUOUS = """
-2 -1 4 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4
-1 -2 -3 -3 -1 -2 -3 -4 -3 3 3 -3 2 0 -3 -2 -1 -2 -1 2 -3 3
-1 0 0 1 -3 4 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -2 -2 -2 0 -3 4
"""


def blosum62() -> dict[str, int]:
    """Pair of residues -> score, for the twenty residues, B, J, Z, X (-1) and * (-4, 1 with itself)."""
    table: dict[str, int] = {}
    codes = ORDER + AMBIGUOUS
    lines = [*BLOSUM62_ROWS.strip().splitlines(), *BLOSUM62_AMBIGUOUS.strip().splitlines()]
    for i, line in enumerate(lines):
        for j, x in enumerate(map(int, line.split())):
            table[codes[i] + codes[j]] = table[codes[j] + codes[i]] = x
    for other, score in (("X", -1), ("*", -4)):
        for c in (*codes, "X"):
            table[other + c] = table[c + other] = score
    return table | {"**": 1}


def read_matrix(lines: list[str]) -> dict[str, int]:
    """A matrix in the usual text format: '#' comments, a header of residues, a row for each."""
    rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    return {r[0] + c: int(x) for r in rows[1:] for c, x in zip(rows[0], r[1:], strict=True)}


def score_map(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])


def pair_score(table: Column, a: Column, b: Column) -> Column:
    """Unknown residues count as X."""
    known = lambda c: F.when(c.rlike(r"^[ARNDCQEGHILKMFPSTWYVBJZX*]\z"), c).otherwise("X")
    return F.element_at(table, F.concat(known(a), known(b)))


def word_score(table: Column, a: Column, b: Column) -> Column:
    """Sum of residue scores of two words of one length; 0 where lengths differ."""
    total = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: pair_score(table, x, y)), F.lit(0), lambda s, x: s + x)
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), total).otherwise(0)


def mean_self_score(table: dict[str, int], codes: str = "ARNDCQEGHILKMFPSTWYVBJZX*") -> int:
    """Truncated mean of the diagonal, ambiguity codes included."""
    return int(sum(table[c + c] for c in codes) / len(codes))


def karlin(matrix: str, gap_open: int | None, gap_extend: int | None) -> tuple[float, float]:
    """(lambda, K); raises with the known penalties where there are none."""
    known = KARLIN[matrix]
    if (gap_open, gap_extend) not in known:
        raise ValueError(f"no statistics for {gap_open}, {gap_extend}; known: {sorted(k for k in known if k[0])}")
    return known[gap_open, gap_extend][:2]


def bit_score(raw: Column, lam: float, k: float) -> Column:
    return (lam * raw - math.log(k)) / math.log(2)


def e_value(raw: Column, m: Column, n: Column, lam: float, k: float) -> Column:
    return k * m * n * F.exp(-lam * raw)


def raw_cutoff(e: Column, m: Column, n: Column, lam: float, k: float) -> Column:
    """The raw score of an E-value, truncated toward zero."""
    return ((math.log(k) + F.ln(m) + F.ln(n) - F.ln(e)) / lam).cast("int")


def gumbel_p(score: Column, mu: float, lam: float, scale: float = 1.0) -> Column:
    x = -(score / scale - mu) * lam
    return F.exp(F.least(F.greatest(x, F.lit(-5.0)), F.lit(5.0)))


def gumbel_score(p: Column, mu: float, lam: float, scale: float = 1.0) -> Column:
    return scale * (mu - F.ln(p) / lam)


def hamming(a: Column, b: Column) -> Column:
    """Differing positions over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: (x != y).cast("long"))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(0)


def mapping_error(errors: Column, aligned: Column) -> Column:
    return (errors + 1) / aligned


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length shared by the closed intervals [a, b] and [c, d]."""
    return F.greatest(F.lit(0).cast("long"), F.least(b, d) - F.greatest(a, c) + 1)


def interval_jaccard(a: Column, b: Column, c: Column, d: Column) -> Column:
    shared = overlap(a, b, c, d)
    return shared / ((b - a + 1) + (d - c + 1) - shared)


def lifted(start: Column, end: Column, strand: Column, begin: Column, stop: Column) -> tuple[Column, Column]:
    """Protein coordinates (from 1, closed) on a gene [begin, stop] of the genome."""
    first = F.when(strand == "+", begin + (start - 1) * 3).otherwise(stop - end * 3 + 1)
    return first, first + (end - start + 1) * 3 - 1


def qgram_threshold(length: Column, k: int, error: float) -> Column:
    """Shared k-mers guaranteed between a word of this length and one with ``error`` differing positions."""
    return (length - k + 1 - k * (length * error)).cast("int")


def qgram_length(length: Column, shared: Column, error: float) -> Column:
    """The largest k with at least ``shared`` common k-mers."""
    return ((length + 1 - shared) / (1 + length * error)).cast("int")


def end_identity(a: Column, b: Column, right: bool = False) -> Column:
    """Identical positions over the shorter length, aligned at the left or the right end."""
    n = F.least(F.length(a), F.length(b))
    cut = (lambda c: F.right(c, n)) if right else (lambda c: F.left(c, n))
    return F.when(n > 0, 1 - hamming(cut(a), cut(b)) / n).otherwise(0.0)


def positive_rate(table: Column, a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: (pair_score(table, x, y) > 0).cast("long"))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x) / n).otherwise(0.0)


def rpkm(count: Column, total: Column, length: Column) -> Column:
    return 1e9 * count / total / length


def minus_log10(x: Column) -> Column:
    return -F.log10(x + 1e-100)
