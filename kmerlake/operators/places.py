"""Where the words of growing tokens stand: occurrence lists instead of a new search at every level.

Text is cut once into pieces that overlap by the longest word to come. A state row holds a stretch of text, a word length and, as a bit
for each base, the starts of the windows of that length that may be wanted. One base more means the same start or the one before it, so the windows of a
level come from the starts of the level before; a stretch shrinks to the neighbourhood of its starts, and one without starts leaves.

Starts are kept by a bitmap of fixed size over hashes of the wanted words on both strands. It only sorts out: a start that passes by
chance yields a word that no token joins, so results are exact at any number of words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType

from kmerlake.functions.words import COMPLEMENT_FROM, COMPLEMENT_TO, PIECE, pieces, reverse_complement
from kmerlake.session import spread, written

KEYS = ["gene", "class"]
#: The bitmap has 2^BITS bits (4 MB), whatever the number of words.
BITS = 25
#: Starts further apart than their words' reach and this go to rows of their own.
GAP = 256
#: Words in a batch handed back to Spark.
BATCH = 100_000
#: Stands between the stretches of a row; no wanted word holds it.
BETWEEN = "\n"
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_COMPLEMENT = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)


def strand_class(word: Column) -> Column:
    """One word for both strands: the lesser as text."""
    return F.least(word, reverse_complement(word))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _buckets(codes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    value = np.zeros(len(starts), np.uint64)
    for offset in range(k):
        value = value * _FACTOR + codes[starts + offset]
    value ^= value >> np.uint64(32)
    return (value * _MIX) >> np.uint64(64 - BITS)


def _marked(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> np.uint64(6)] >> (buckets & np.uint64(63))) & np.uint64(1) > 0


def _set_bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for k, words in frame["word"].groupby(frame["word"].str.len()):
            at = _buckets(_codes("".join(words)), np.arange(len(words)) * k, int(k))
            bits = np.uint64(1) << (at & np.uint64(63))
            yield pd.DataFrame({"place": (at >> np.uint64(6)).astype(np.int64), "bits": bits.view(np.int64)})


def word_bitmap(tokens: DataFrame) -> Broadcast:
    """The bitmap of the tokens' words on both strands, packed in Spark; at most 2^(BITS - 6) numbers reach the driver."""
    words = tokens.select(F.explode(F.array("token", reverse_complement(F.col("token")))).alias("word"))
    packed = words.mapInPandas(_set_bits, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[packed["place"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64)
    return tokens.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def cut_text(seqs: DataFrame, lengths: Iterable[int], levels: int = 0, size: int = PIECE) -> DataFrame:
    """(gene, class, text): pieces of all sequences, for words of ``lengths`` that grow by up to ``levels`` bases."""
    lengths = sorted(set(lengths))
    cut = seqs.select(*KEYS, F.explode(pieces(F.col("seq"), lengths[0], lengths[-1] + levels, size)).alias("text"))
    return spread(cut, *KEYS, "text")


def with_alone(rows: DataFrame, *more: str) -> DataFrame:
    """Add ``alone``: no other row has the same gene and class (and ``more``), so the words of the row need no shuffle to be distinct.

    ``rows`` is read twice; the keys of several rows are written, so that their size is known.
    """
    several = rows.groupBy(*KEYS, *more).count().where("count > 1").select(*KEYS).distinct()
    several = written(several.select(*[F.col(c).alias(f"_{c}") for c in KEYS], F.lit(True).alias("_several")), "several")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS]
    return rows.join(several, same[0] & same[1], "left").select(*rows.columns, F.col("_several").isNull().alias("alone"))


def _stretches(batch: pa.RecordBatch, lengths: list[int] | None) -> Iterator[tuple]:
    """(row, k, text, codes, starts) of state rows, or of pieces for each of ``lengths`` with all their starts."""
    texts = batch.column("text")
    if lengths is None:
        ks, starts = batch.column("k"), batch.column("starts")
    for row in range(batch.num_rows):
        text = texts[row].as_py()
        codes = _codes(text)
        if lengths is None:
            bits = np.unpackbits(np.frombuffer(starts[row].as_py(), np.uint8), count=len(codes))
            yield row, ks[row].as_py(), text, codes, np.flatnonzero(bits)
        else:
            for k in lengths:
                yield row, k, text, codes, np.arange(max(len(codes) - k + 1, 0))


def _longer(starts: np.ndarray, size: int, k: int) -> np.ndarray:
    """Starts of windows of length ``k`` that have a window of length ``k - 1`` at one of ``starts``."""
    wanted = np.zeros(size + 1, bool)
    wanted[starts] = True
    wanted[starts[starts > 0] - 1] = True
    return np.flatnonzero(wanted[:max(size - k + 1, 0)])


def _states(df: DataFrame, bitmap: Broadcast, longer: bool, margin: int, lengths: list[int] | None, together: bool) -> DataFrame:
    carried = [c for c in (*KEYS, "alone") if c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            rows, ks, texts, lists = [], [], [], []
            for row, k, text, codes, starts in _stretches(batch, lengths):
                starts = starts[_marked(bits, _buckets(codes, starts, k))]
                if longer:
                    k += 1
                    starts = _longer(starts, len(codes), k)
                if not len(starts):
                    continue
                found, marks = [], []
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > k + 2 * margin + GAP) + 1):
                    begin = max(int(part[0]) - margin, 0)
                    found.append(text[begin:int(part[-1]) + k + margin])
                    held = np.zeros(len(found[-1]) + together, bool)
                    held[part - begin] = True
                    marks.append(held)
                if together:
                    found, marks = [BETWEEN.join([*found, ""])], [np.concatenate(marks)]
                rows.extend([row] * len(found))
                ks.extend([k] * len(found))
                texts.extend(found)
                lists.extend(np.packbits(held).tobytes() for held in marks)
            keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in carried]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(ks, pa.int32()), pa.array(texts, pa.string()), pa.array(lists, pa.binary())], [*carried, "k", "text", "starts"])

    schema = StructType([df.schema[c] for c in carried]).add("k", IntegerType()).add("text", StringType()).add("starts", BinaryType())
    return df.select(*carried, *(["text"] if lengths else ["k", "text", "starts"])).mapInArrow(run, schema)


def open_places(cut: DataFrame, bitmap: Broadcast, lengths: Iterable[int], levels: int, together: bool = False) -> DataFrame:
    """State rows with the starts of the words in the bitmap; ``levels`` more bases may follow.

    With ``together`` the stretches of a piece stay in one row, so that ``with_alone`` can tell which genes have one.
    """
    return _states(cut, bitmap, False, levels, sorted(set(lengths)), together)


def grow_places(state: DataFrame, bitmap: Broadcast, levels: int, lengths: Iterable[int] | None = None, together: bool = False) -> DataFrame:
    """State rows one base longer, at starts whose parents are in the bitmap; pieces if ``lengths`` of parents are given."""
    return _states(state, bitmap, True, levels, None if lengths is None else sorted(set(lengths)), together)


def _strand_words(df: DataFrame, bitmap: Broadcast | None, lengths: list[int] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            rows, words = [], []
            for row, k, text, codes, starts in _stretches(batch, lengths):
                if bits is not None:
                    starts = starts[_marked(bits, _buckets(codes, starts, k))]
                found = {text[s:s + k] for s in starts.tolist()}
                found = {min(word, word.translate(_COMPLEMENT)[::-1]) for word in found}
                words.extend(found)
                rows.extend([row] * len(found))
                if len(words) >= BATCH:
                    yield pack(batch, rows, words)
                    rows, words = [], []
            yield pack(batch, rows, words)

    def pack(batch: pa.RecordBatch, rows: list[int], words: list[str]) -> pa.RecordBatch:
        keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in KEYS]
        return pa.RecordBatch.from_arrays([*keys, pa.array(words, pa.string())], [*KEYS, "word"])

    schema = StructType([df.schema[c] for c in KEYS]).add("word", StringType())
    if "alone" not in df.columns:
        return df.mapInArrow(run, schema).distinct()
    return df.where("alone").mapInArrow(run, schema).unionByName(df.where("not alone").mapInArrow(run, schema).distinct())


def words_at(state: DataFrame) -> DataFrame:
    """(gene, class, word): the strand classes at the starts of a state, once a gene."""
    return _strand_words(state, None, None)


def listed_words(cut: DataFrame, bitmap: Broadcast, lengths: Iterable[int]) -> DataFrame:
    """(gene, class, word): the strand classes of ``lengths`` in pieces, once a gene, that the bitmap does not rule out."""
    return _strand_words(cut, bitmap, sorted(set(lengths)))


def counts_at(state: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, pos_count, neg_count) of distinct tokens; those that no gene holds with zeros.

    Genes are counted once for a strand class, also where both of its words are tokens.
    """
    counts = words_at(state).groupBy("word").agg(
        F.count_if(F.col("class") == 1).alias("pos_count"), F.count_if(F.col("class") == 0).alias("neg_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    listed = tokens.select("token", strand_class(F.col("token")).alias("word"))
    return listed.join(counts, "word", "left").select("token", zero("pos_count"), zero("neg_count"))
