"""Windows of sequences: the base of presence tests and of k-mer mapping.

Sequences are cut into pieces, and pieces are spread over all tasks before their windows are
opened: one shuffle of the plain text, so that an unsplittable file or one very long sequence
does not leave the costly part to a single task. The windows themselves are far larger than
the text and are reduced before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.functions.words import PIECE, pieces, reverse_complement, windows
from kmerlake.session import spread, written


def sequence_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """Every window of length ``k``: (the other columns of ``seqs``, start from 1, word)."""
    keep = [c for c in seqs.columns if c != "seq"]
    cut = seqs.select(*keep, F.posexplode(pieces(F.col("seq"), k, k)).alias("_piece", "_text"))
    cut = spread(cut, *keep, "_piece")
    opened = cut.select(*keep, "_piece", F.posexplode(windows(F.col("_text"), k)).alias("_at", "word"))
    return opened.select(*keep, (F.col("_piece").cast("long") * PIECE + F.col("_at") + 1).alias("start"), "word")


def words_in(seqs: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """Words of the given lengths per sequence, already distinct inside each piece."""
    lengths = sorted(set(lengths))
    keep = [c for c in seqs.columns if c != "seq"]
    cut = seqs.select(*keep, F.explode(pieces(F.col("seq"), lengths[0], lengths[-1])).alias("_text"))
    cut = spread(cut, *keep, "_text")
    found = F.concat(*[windows(F.col("_text"), k) for k in lengths])
    return cut.select(*keep, F.explode(F.array_distinct(found)).alias("word"))


def placed_words(seqs: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """Every window of each of the lengths: (the other columns of ``seqs``, start from 1, word)."""
    lengths = sorted(set(lengths))
    keep = [c for c in seqs.columns if c != "seq"]
    cut = seqs.select(*keep, F.posexplode(pieces(F.col("seq"), lengths[0], lengths[-1])).alias("_piece", "_text"))
    cut = spread(cut, *keep, "_piece")
    # A window that starts beyond the piece belongs to the next one.
    own = [F.slice(windows(F.col("_text"), k), 1, PIECE) for k in lengths]
    placed = F.concat(*[F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("word"))) for w in own])
    opened = cut.select(*keep, "_piece", F.explode(placed).alias("_w"))
    return opened.select(*keep, (F.col("_piece").cast("long") * PIECE + F.col("_w.at") + 1).alias("start"), "_w.word")


def map_kmers(seqs: DataFrame, kmers: DataFrame, k: int | None = None, chromosome: str = "chr1") -> DataFrame:
    """Positions of each listed k-mer on both strands, in the shape of the hit table.

    ``kmer`` is a word of any length or a token ``K.RC``. A hit on ``-`` lies where the reverse
    complement stands in the text. Lengths are read from the k-mers unless all have length ``k``.
    """
    word = F.element_at(F.split("kmer", r"\."), 1)
    other = F.element_at(F.split(F.concat("kmer", F.lit(".")), r"\."), 2)
    targets = kmers.select("kmer", F.explode(F.array(
        F.struct(word.alias("word"), F.lit("+").alias("dir")),
        F.struct(F.when(other == "", reverse_complement(word)).otherwise(other).alias("word"), F.lit("-").alias("dir")))).alias("t"))
    # Written, so that their size is known: of a list of unknown size Spark would take the windows for the smaller side.
    targets = written(targets.select("kmer", "t.word", "t.dir"), "targets")
    if k is not None:
        found = sequence_kmers(seqs.select("gene", "seq"), k)
    else:
        lengths = [r[0] for r in kmers.select(F.length(word)).distinct().collect()]  # one row for each length
        found = placed_words(seqs.select("gene", "seq"), lengths or [1])
    return found.join(targets, "word").select(
        F.lit(chromosome).alias("chr"), "gene", "kmer", "start", (F.col("start") + F.length("word") - 1).alias("end"), "dir")
