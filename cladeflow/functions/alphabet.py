"""Residue alphabets, codons and sequence expressions (columns in, columns out; all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Residue order and the class of each residue in eleven reduced alphabets.
RESIDUES = "PGEKRQDSNTHCIVWYFALM"
ORDERED = "".join(sorted(RESIDUES))
ALPHABETS = {
    "ALL20": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19),
    "DSSP5": (4, 4, 0, 0, 0, 0, 3, 2, 3, 2, 0, 2, 1, 1, 1, 1, 1, 0, 1, 1),
    "DSSP10": (9, 9, 0, 0, 0, 0, 8, 8, 8, 6, 6, 7, 1, 1, 5, 2, 3, 4, 2, 4),
    "GBMR4": (3, 0, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 1, 2, 2),
    "GBMR10": (9, 0, 3, 3, 3, 3, 1, 8, 2, 7, 5, 6, 3, 3, 3, 4, 3, 3, 3, 3),
    "HSDM5": (3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4, 2, 0, 0, 1, 0, 0, 3, 0, 0),
    "SDM6": (5, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4, 1, 0, 0, 2, 0, 0, 3, 0, 0),
    "MURPHY5": (1, 1, 3, 4, 4, 3, 3, 1, 3, 1, 4, 0, 0, 0, 2, 2, 2, 1, 0, 0),
    "MURPHY10": (8, 4, 2, 1, 1, 2, 2, 9, 2, 9, 5, 3, 6, 6, 7, 7, 7, 0, 6, 6),
    "TD5": (0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 4, 4, 4),
    "TD10": (0, 1, 2, 2, 2, 2, 3, 3, 3, 4, 5, 5, 6, 6, 7, 7, 7, 8, 9, 9),
}
#: The 24 residue codes of substitution matrices, in their usual order.
CODES = "ARNDCQEGHILKMFPSTWYVBZX*"


def classes(name: str) -> str:
    """Class letters ('A' + class) in the order of ``RESIDUES``."""
    return "".join(chr(65 + c) for c in ALPHABETS[name])


def reduced(seq: Column, name: str) -> Column:
    """A sequence as class letters; residues outside the twenty stay as they are (see ``standard``)."""
    return F.translate(seq, RESIDUES, classes(name))


def standard(seq: Column) -> Column:
    """Are all residues among the twenty?"""
    return seq.rlike(rf"^[{RESIDUES}]*\z")


def repaired(seq: Column) -> Column:
    """Characters outside the accepted codes become X."""
    return F.regexp_replace(seq, r"[^ARNDCQEGHILKMFPSTWYVBJZX*]", "X")


def trimmed(seq: Column) -> Column:
    """Without trailing characters that are no letters."""
    return F.regexp_replace(seq, r"[^A-Za-z]+$", "")


def normalised(text: Column) -> Column:
    """Any text as a peptide: ASCII letters, upper case, the twenty residues only; null as empty."""
    # one walk over the text; upper comes last, as other letters than ASCII ones may become such
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{ORDERED}{ORDERED.lower()}]+", ""))


def digits() -> tuple[bytes, bytes]:
    """``normalised`` for bytes.translate on UTF-8: residues as 1 to 20 in the order of ``ORDERED``, 255 (no byte of UTF-8) as 0; and the bytes to leave out."""
    table = bytearray(256)
    for i, c in enumerate(ORDERED, 1):
        table[ord(c)] = table[ord(c.lower())] = i
    return bytes(table), bytes(b for b in range(255) if not table[b])


def kmer_array(seq: Column, k: int) -> Column:
    """All substrings of length k, in order."""
    n = F.length(seq) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_code(kmer: Column, bits: int = 5) -> Column:
    """Residue indices shifted together; k * bits must stay below 64."""
    letters = F.array(*map(F.lit, CODES))
    return F.aggregate(F.split(kmer, ""), F.lit(0).cast("long"), lambda a, c: F.shiftleft(a, bits).bitwiseOR(F.array_position(letters, c) - 1))


def kmer_decode(code: Column, k: int, bits: int = 5) -> Column:
    letters = F.array(*map(F.lit, CODES))
    at = lambda i: (F.shiftright(code, bits * (k - 1 - i)).bitwiseAND((1 << bits) - 1) + 1).cast("int")
    return F.concat(*[F.element_at(letters, at(i)) for i in range(k)])


def reverse_complement(rna: Column) -> Column:
    """A and U, C and G change places, reversed; other characters are dropped."""
    return F.reverse(F.translate(F.regexp_replace(rna, "[^ACGU]", ""), "ACGU", "UGCA"))


def codon_table() -> dict[str, str]:
    """The standard genetic code, from its usual listing (bases in order TCAG)."""
    bases, amino = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    return {a + b + c: amino[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


def translated(dna: Column) -> Column:
    """Codons to residues; unknown ones X, '---' a gap; an incomplete last codon is left out."""
    table = F.create_map(*[F.lit(x) for kv in (codon_table() | {"---": "-"}).items() for x in kv])
    codons = F.transform(F.regexp_extract_all(dna, F.lit("..."), F.lit(0)), lambda c: F.coalesce(F.element_at(table, c), F.lit("X")))
    return F.array_join(codons, "")


def back_translated_positions(start: Column, n: Column) -> Column:
    """The nucleotide positions of n residues that begin at residue ``start`` (from 0)."""
    return F.sequence(start * 3, start * 3 + n * 3 - 1)
