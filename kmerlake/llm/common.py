"""Helpers of the text operators: tables on the shared folder and Arrow passes over whole texts."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlake.session import scratch_path

#: Texts are handed to a kernel in runs of about so many characters, so that memory follows
#: this number and the longest text, not the number of rows in a batch.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_remainder(of: int) -> Column:
    """Remainder of the id's check sum; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names compare as Spark does)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row runs of about CHUNK_CHARS bytes of text; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > CHUNK_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def add_columns(
    df: DataFrame, text: str, new: dict[str, T.DataType], kernel: Callable[[], Callable[[list], dict]], keep: list[str] | None = None
) -> DataFrame:
    """Append columns computed from the whole texts of ``text`` in Arrow batches.

    ``kernel()`` runs once in a task and returns a function from a list of texts (None for null)
    to lists by name. ``keep``: input columns to carry on, all by default; an input column named
    like a new one is replaced.
    """
    rest = without(df, new)
    names = [c for c in (rest.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new}]
    carried = [F.col(f"`{c}`") for c in names]
    source = df.select(*carried, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, t) for n, t in new.items()]])
    arrow = [(n, _arrow(t)) for n, t in new.items()]

    def run(batches):
        work = kernel()
        for batch in batches:
            for part in pieces(batch, "_text"):
                texts = part.column("_text").to_pylist()
                got = work(texts)
                columns = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *[pa.array(got[n], type=t) for n, t in arrow]], names=[*names, *[n for n, _ in arrow]])

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
              "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return simple[kind.simpleString()]


def once(key: tuple, make: Callable):
    """``make()`` once in a Python worker: Spark reuses workers, but loads closures anew in each task."""
    kept = sys.modules.setdefault("_kmerlake_kept", types.ModuleType("_kmerlake_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
