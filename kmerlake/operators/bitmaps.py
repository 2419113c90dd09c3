"""Presence of pairs by bitmaps: a bit for each gene, a bitmap for each block of genes and unit.

A unit is a word or a strand class. Genes are numbered once; 32,768 numbers are a block, and Spark's bitmap functions pack what the
genes of a block hold. A pair is then the AND of two bitmaps, so no row is made for a gene and a pair of units before it is asked
for: counts of all pairs come from the bitmaps of a block, and genes are named only where a listed pair is opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kmerlake.operators.windows import words_in
from kmerlake.session import materialise

KEYS = ["gene", "class"]
#: Genes in a block; Spark's bitmaps have this size.
BITS = 32_768
#: Units whose pairs are counted together: a tile of counts is the square of it.
TILE = 1024
#: Rows of terms whose units meet a block together, and genes that a task hands back at once.
PART, OPENED = 4096, 200_000


def held_units(seqs: DataFrame, words: DataFrame, lengths: Iterable[int]) -> DataFrame:
    """(gene, class, block, bit, units): what each gene holds, written once; ``words`` maps ``word`` to ``unit``.

    The text is opened here and nowhere else. Genes without a unit have no row. Row numbers are those of the written
    table, so they are the same in every later use.
    """
    found = words_in(seqs.select(*KEYS, "seq"), lengths).join(words.select("word", "unit"), "word")
    held = materialise(found.groupBy(*KEYS).agg(F.collect_set("unit").alias("units")))
    number = F.monotonically_increasing_id()
    numbered = held.withColumn("_n", number)
    return numbered.select(
        *KEYS, F.shiftright("_n", 15).alias("block"), F.col("_n").bitwiseAND(F.lit(BITS - 1)).alias("bit"), "units")


def unit_bitmaps(held: DataFrame) -> DataFrame:
    """(block, unit, bits)."""
    opened = held.select("block", "bit", F.explode("units").alias("unit"))
    return opened.groupBy("block", "unit").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _tiled(bitmaps: DataFrame, n_units: int) -> DataFrame:
    """Each bitmap once for every tile of pairs it takes part in: tiles a <= b of first and second units."""
    tiles = max(1, -(-n_units // TILE))
    own = F.floor(F.col("unit") / TILE).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    spread = bitmaps.select("*", own.alias("own"), other)
    return spread.select(
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "block", (F.col("own") > F.col("other")).alias("second"),
        F.col("unit").cast("int").alias("unit"), "bits", "positive")


def _words(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


class _Tile:
    """Counts of the pairs of one tile: all genes and genes of class 1."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b
        self.both, self.positive = np.zeros((TILE, TILE), np.int64), np.zeros((TILE, TILE), np.int64)

    def add(self, rows: list[tuple]) -> None:
        """Bitmaps of one block: (second, unit, bits, positive)."""
        first = [r for r in rows if not r[0]]
        second = first if self.a == self.b else [r for r in rows if r[0]]
        if not first or not second:
            return
        left, right, positive = _words([r[2] for r in first]), _words([r[2] for r in second]), _words([rows[0][3]])[0]
        used = np.flatnonzero(left.any(axis=0) & right.any(axis=0))
        left, right, positive = left[:, used], np.ascontiguousarray(right[:, used]), positive[used]
        at = np.array([r[1] for r in second]) - self.b * TILE
        for row, bits in zip(first, left):
            met, i = right & bits, row[1] - self.a * TILE
            self.both[i, at] += np.bitwise_count(met).sum(axis=1, dtype=np.int64)
            self.positive[i, at] += np.bitwise_count(met & positive).sum(axis=1, dtype=np.int64)

    def counts(self) -> Iterator[pa.RecordBatch]:
        kept = np.triu(self.both, 1) if self.a == self.b else self.both
        i, j = np.nonzero(kept)
        pos, both = self.positive[i, j], self.both[i, j]
        columns = [i + self.a * TILE, j + self.b * TILE, pos, both - pos]
        whole = pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["i", "j", "pos_count", "neg_count"])
        yield from (whole.slice(k, 50_000) for k in range(0, len(i), 50_000))


def _count_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile and block; a task holds one block's bitmaps of a tile and the tile's counts."""
    tile, block, rows = None, None, []
    for batch in batches:
        for a, b, at, *row in zip(*[batch.column(n).to_pylist() for n in ("a", "b", "block", "second", "unit", "bits", "positive")]):
            if tile is None or (a, b) != (tile.a, tile.b) or at != block:
                if rows:
                    tile.add(rows)
                if tile is None or (a, b) != (tile.a, tile.b):
                    if tile is not None:
                        yield from tile.counts()
                    tile = _Tile(a, b)
                block, rows = at, []
            rows.append(tuple(row))
    if tile is not None:
        tile.add(rows)
        yield from tile.counts()


def pair_counts(held: DataFrame, n_units: int) -> DataFrame:
    """(i, j, pos_count, neg_count) of all pairs i < j of units that some gene holds together.

    A task adds up the blocks it gets of a tile before anything is shuffled: it gives at most a row for each pair.
    """
    none = F.unhex(F.lit("00" * (BITS // 8)))
    positive = held.where("class = 1").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("positive"))
    bitmaps = unit_bitmaps(held).join(positive, "block", "left").withColumn("positive", F.coalesce("positive", none))
    dealt = _tiled(bitmaps, n_units).repartition("a", "b", "block").sortWithinPartitions("a", "b", "block")
    parts = dealt.mapInArrow(_count_tiles, "i long, j long, pos_count long, neg_count long")
    return parts.groupBy("i", "j").agg(F.sum("pos_count").alias("pos_count"), F.sum("neg_count").alias("neg_count"))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int").alias("part")


class _Units:
    """Bitmaps of the units of one block that the tokens of a part ask for, and the genes of the block by bit."""

    def __init__(self, block: int, part: int, genes: pa.Array, bits: np.ndarray):
        self.at, self.units = (block, part), {}
        self.rows = np.full(BITS, -1, np.int64)
        self.rows[bits] = np.arange(len(bits))
        self.genes = genes

    def held(self, terms: list[list]) -> np.ndarray | None:
        """Rows of the genes where every unit of some term is held."""
        met = None
        for term in terms:
            bits = [self.units.get(unit) for unit in term]
            if any(b is None for b in bits):
                continue
            every = bits[0] if len(bits) == 1 else np.bitwise_and.reduce(bits)
            met = every if met is None else met | every
        return None if met is None else self.rows[np.flatnonzero(np.unpackbits(met, bitorder="little"))]


def _open_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, part and kind: the genes, the bitmaps of units, the tokens; a batch out holds ``OPENED`` genes or one token."""
    group, tokens, rows, size = None, [], [], 0

    def opened() -> pa.RecordBatch:
        places = np.concatenate(rows)
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), group.genes.take(pa.array(places)))
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), keys], names=["token", "keys"])

    for batch in batches:
        kinds, blocks, parts = (batch.column(n).to_pylist() for n in ("kind", "block", "part"))
        for k, kind in enumerate(kinds):
            if kind == 0:
                if rows:
                    yield opened()
                    tokens, rows, size = [], [], 0
                bits = batch.column("places")[k].values.to_numpy(zero_copy_only=False)
                group = _Units(blocks[k], parts[k], batch.column("keys")[k].values, bits)
            elif kind == 1:
                group.units[batch.column("unit")[k].as_py()] = np.frombuffer(batch.column("bits")[k].as_py(), np.uint8)
            elif group is not None and group.at == (blocks[k], parts[k]):
                found = group.held(batch.column("terms")[k].as_py())
                if found is None or not len(found):
                    continue
                tokens.append(batch.column("token")[k].as_py())
                rows.append(found)
                size += len(found)
                if size >= OPENED:
                    yield opened()
                    tokens, rows, size = [], [], 0
    if rows:
        yield opened()


def open_terms(held: DataFrame, terms: DataFrame) -> DataFrame:
    """(gene, class, token): where a token's condition holds, an OR of terms that each are an AND of units.

    ``terms``: (token, term, unit), distinct. Tokens are dealt into parts of about ``PART`` rows of terms; a part meets each block of genes
    once, with the bitmaps of its units and the block's genes, so neither a bitmap of a pair nor a row of gene and token is shuffled.
    """
    spark = held.sparkSession
    listed = terms.groupBy("token", "term").agg(F.collect_list("unit").alias("units")).groupBy("token").agg(F.collect_list("units").alias("terms"))
    parts = max(spark.sparkContext.defaultParallelism, -(-terms.count() // PART))
    keys = F.struct(*KEYS)
    genes = held.groupBy("block").agg(F.collect_list(F.struct(F.col("bit").cast("int").alias("bit"), keys.alias("key"))).alias("g")).select(
        "block", F.col("g.bit").alias("places"), F.col("g.key").alias("keys"))
    wanted = terms.select(_part(parts), "unit").distinct()
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    blocks = held.select("block").distinct()
    rows = genes.select(F.lit(0).alias("kind"), "block", each, "places", "keys").unionByName(
        unit_bitmaps(held).join(wanted, "unit").select(F.lit(1).alias("kind"), "block", "part", "unit", "bits"), True).unionByName(
        listed.crossJoin(blocks).select(F.lit(2).alias("kind"), "block", _part(parts), "token", "terms"), True)
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartition(number, "block", "part").sortWithinPartitions("block", "part", "kind")
    schema = StructType().add("token", terms.schema["token"].dataType).add("keys", genes.schema["keys"].dataType)
    return dealt.mapInArrow(_open_parts, schema).select("token", F.inline("keys")).select(*KEYS, "token")
