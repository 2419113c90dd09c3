"""Column expressions on DNA words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet in universe order, and the IUPAC complement pairs.
ALPHABET = "ATGC"
COMPLEMENT_FROM = "ACGTRYKMBVDHacgtrykmbvdh"
COMPLEMENT_TO = "TGCAYRMKVBHDtgcayrmkvbhd"

# Bases handled by one exploded piece of a sequence. Windows are cut inside pieces, so
# the work per base does not grow with the length of the sequence.
PIECE = 8192


def reverse_complement(word: Column) -> Column:
    return F.reverse(F.translate(word, COMPLEMENT_FROM, COMPLEMENT_TO))


def universe_order(word: Column) -> Column:
    """A string that sorts words in universe order (A, T, G, C)."""
    return F.translate(word, ALPHABET, "0123")


def canonical(word: Column) -> Column:
    """The member of the strand pair that comes first in the universe."""
    other = reverse_complement(word)
    return F.when(universe_order(word) <= universe_order(other), word).otherwise(other)


def strand_token(word: Column) -> Column:
    """Token ``K.RC`` of the strand pair of a word."""
    first = canonical(word)
    return F.concat(first, F.lit("."), reverse_complement(first))


def word_from_index(index: Column, k: int) -> Column:
    """The word of length ``k`` at a universe index (first letter most significant)."""
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    digit = lambda place: F.shiftright(index, 2 * place).bitwiseAND(F.lit(3)).cast("int")
    return F.concat(*[F.element_at(letters, digit(place) + 1) for place in reversed(range(k))])


def pieces(seq: Column, shortest: int, longest: int, size: int = PIECE) -> Column:
    """Array of stretches of ``size`` start positions, each with the overlap the windows need."""
    pattern = f"(?s)(?=(.{{{shortest},{size + longest - 1}}})).{{1,{size}}}"
    return F.regexp_extract_all(seq, F.lit(pattern), 1)


def windows(seq: Column, k: int) -> Column:
    """Array of all windows of length ``k``, in order; empty for shorter text."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))."), 1)


def children(word: Column) -> Column:
    """The 8 words made by adding one base at the end or at the front.

    For a pair ``A B`` this lengthens the second or the first member.
    """
    bases = [F.lit(c) for c in ALPHABET]
    return F.array(*[F.concat(word, b) for b in bases], *[F.concat(b, word) for b in bases])
