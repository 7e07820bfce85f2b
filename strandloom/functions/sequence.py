"""Column functions over nucleotide strings.

Symbols are ``A T G C`` with the codes 0 to 3, in that order (not the alphabet's); ``N`` is any base.
Directions are 0 straight, 1 backward (reversed), 2 inverted (complement), 3 both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = "ATGC"
DIRECTIONS = ("straight", "backward", "inverted", "backward_inverted")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(seq: str | Column) -> Column:
    """A with T and G with C; anything else stays."""
    return F.translate(_col(seq), "ATGC", "TACG")


def oriented(seq: str | Column, direction: int) -> Column:
    seq = _col(seq)
    return (seq, F.reverse(seq), complement(seq), F.reverse(complement(seq)))[direction]


def orientations(seq: str | Column) -> Column:
    """The four orientations as an array, in the order of the directions."""
    return F.array(*[oriented(seq, d) for d in range(4)])


def codes(seq: str | Column) -> Column:
    """The symbols' codes as a string of digits; sorts as the alphabet A, T, G, C does."""
    return F.translate(_col(seq), SYMBOLS, "0123")


def symbols(code: str | Column) -> Column:
    return F.translate(_col(code), "0123", SYMBOLS)


def soft_mask_folded(seq: str | Column) -> Column:
    return F.upper(_col(seq))


def rendered(seq: str | Column) -> Column:
    """Any base as a blank."""
    return F.translate(_col(seq), "N", " ")


def base_count(seq: str | Column, base: str) -> Column:
    seq = _col(seq)
    return F.length(seq) - F.length(F.replace(seq, F.lit(base)))


def most_of_a_base(seq: str | Column) -> Column:
    return F.greatest(*[base_count(seq, b) for b in SYMBOLS])


def is_complex(word: str | Column) -> Column:
    """Neither starting CCC nor with two thirds or more (integer division) of one base."""
    word = _col(word)
    return ~word.startswith("CCC") & (most_of_a_base(word) < F.floor(2 * F.length(word) / 3))


def kmers(seq: str | Column, k: int) -> Column:
    """All words of length k as an array; empty for shorter sequences."""
    seq = _col(seq)
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def base_at(seq: str | Column, pos: Column) -> Column:
    """The symbol at a position from 0."""
    return F.substr(_col(seq), pos + 1, F.lit(1))
