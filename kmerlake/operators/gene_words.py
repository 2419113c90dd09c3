"""The words of a gene, each once, without a shuffle of words.

A gene that stands in one row and is not longer than a stretch is opened whole by one task, so its words are distinct there. Only genes of
several rows or stretches have their words shuffled. Text of A, C, G and T goes by numbers of two bits a base, any other text by Python strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from kmerlake.functions.words import COMPLEMENT_FROM, COMPLEMENT_TO, pieces
from kmerlake.session import spread, written

KEYS = ["gene", "class"]
#: Letters of a sequence that a task opens at once.
STRETCH = 1_000_000
#: Words in a batch handed back to Spark.
BATCH = 200_000
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_NUMBERS = np.full(256, 255, np.uint8)
_NUMBERS[_LETTERS] = np.arange(4, dtype=np.uint8)
_COMPLEMENT = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)


def _numbered(bases: np.ndarray, k: int, both: bool) -> bytes:
    """The distinct words of one length, one after the other."""
    many = len(bases) - k + 1
    word, other = np.zeros(many, np.uint64), np.zeros(many, np.uint64)
    for offset in range(k):
        at = bases[offset:offset + many]
        word = word << np.uint64(2) | at
        if both:
            other |= (np.uint64(3) - at) << np.uint64(2 * offset)
    found = np.unique(np.minimum(word, other) if both else word)
    places = np.arange(2 * k - 2, -1, -2, dtype=np.uint64)
    return _LETTERS[(found[:, None] >> places) & np.uint64(3)].tobytes()


def distinct_words(text: str, k: int, both: bool) -> tuple[bytes, list[int] | int]:
    """Distinct words of one length as UTF-8, with their sizes in bytes (a number if all have one)."""
    if len(text) < k:
        return b"", k
    bases = _NUMBERS[np.frombuffer(text.encode(), np.uint8)]
    if k <= 31 and bases.max() < 4:
        return _numbered(bases.astype(np.uint64), k, both), k
    words = {text[s:s + k] for s in range(len(text) - k + 1)}
    if both:
        words = {min(w, w.translate(_COMPLEMENT)[::-1]) for w in words}
    raw = [w.encode() for w in words]
    return b"".join(raw), [len(w) for w in raw]


def _opened(cut: DataFrame, lengths: list[int], both: bool, whole: bool) -> DataFrame:
    """(gene, class, word) of the rows whose flag is ``whole``."""
    def pack(batch: pa.RecordBatch, rows: list, sizes: list, words: list) -> pa.RecordBatch:
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
        ends = np.append(0, np.cumsum(size)).astype(np.int32)
        text = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(words)))
        row = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in KEYS], text], [*KEYS, "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, texts = batch.column("_whole").to_pylist(), batch.column("_text")
            rows, sizes, words, many = [], [], [], 0
            for row in range(batch.num_rows):
                if flags[row] != whole:
                    continue
                text = texts[row].as_py()
                for k in lengths:
                    found, size = distinct_words(text, k, both)
                    size = np.full(len(found) // k, k, np.int32) if isinstance(size, int) else np.array(size, np.int32)
                    words.append(found)
                    sizes.append(size)
                    rows.append(np.full(len(size), row))
                    many += len(size)
                if many >= BATCH:
                    yield pack(batch, rows, sizes, words)
                    rows, sizes, words, many = [], [], [], 0
            yield pack(batch, rows, sizes, words)

    schema = StructType([cut.schema[c] for c in KEYS]).add("word", StringType())
    return cut.mapInArrow(run, schema)


def gene_words(seqs: DataFrame, lengths: Iterable[int], both: bool = False) -> DataFrame:
    """(gene, class, word): every word of the given lengths once for each gene and class; with ``both`` the lesser of it and its reverse complement.

    Genes of several rows or stretches are told apart by a count of the keys alone.
    """
    lengths = sorted(set(lengths))
    seqs = seqs.select(*KEYS, "seq")
    several = seqs.groupBy(*KEYS).count().where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in KEYS], F.lit(True).alias("_several"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS]
    flagged = seqs.join(written(several, "several"), same[0] & same[1], "left")  # written, so that its size is known
    whole = (F.col("_several").isNull() & (F.length("seq") <= STRETCH)).alias("_whole")
    cut = flagged.select(*KEYS, whole, F.explode(pieces(F.col("seq"), lengths[0], lengths[-1], STRETCH)).alias("_text"))
    cut = spread(cut, *KEYS, "_text")  # one shuffle, which both uses share
    return _opened(cut, lengths, both, True).unionByName(_opened(cut, lengths, both, False).distinct())
