"""Near-duplicates by SimHash and covering locality-sensitive hashing.

The fingerprint of a text has 64 bits, set where more than half of its word shingles' hashes have
them set. Each bit gets one of the 2^(radius + 1) - 1 non-zero vectors over {0, 1}; for each such
vector v a table masks the bits whose vector has an odd product with v. The vectors of at most
``radius`` differing bits leave some v orthogonal to them all, so every pair within the radius
agrees on all bits of that table's mask: no pair is missed.

Equal fingerprints are one node. A table's bucket of up to ``most`` nodes is searched in one task,
which gives a spanning forest of the links in it. The nodes of larger buckets go another exact way: two of them are within 2d bits of each other exactly if some
word is within d bits of both, so each is listed under its middle words and linked to the least node
of each. Components follow from all links.

Null and empty texts have no words and the fingerprint zero; they link like any other. Rows with one
``doc_id`` stay apart as rows; null ids are never chosen as component id unless there is no other.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlake.llm.common import add_columns, stored, without
from kmerlake.llm.components import components

BITS = 64
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the shingles of ``width`` words joined by one blank; of all words if there are fewer."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[min(width, len(words)) - 1 :]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, last)], np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """The 64 bits as a signed integer."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        block = hashes[k : k + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(width: int):
    return lambda texts: {"fingerprint": [fingerprint(t, width) for t in texts]}


def covering_masks(radius: int) -> list[int]:
    """Masks (signed) of the 2^(radius + 1) - 1 tables."""
    vectors = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(BITS) if (((i % vectors) + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def _forest(radius: int, batches):
    """Links that join the members of each bucket as far as they are within the radius, without rings."""
    for batch in batches:
        left, right = [], []
        for members in batch.column("members"):
            values = members.values.to_numpy()  # signed
            words = values.view(np.uint64)
            root = np.arange(len(values))
            for i in range(len(values) - 1):
                near = i + 1 + np.flatnonzero(np.bitwise_count(words[i + 1 :] ^ words[i]) <= radius)
                for j in near[root[near] != root[i]]:
                    if root[j] != root[i]:
                        left.append(values[i])
                        right.append(values[j])
                        root[root == root[j]] = root[i]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def links_in_buckets(nodes: DataFrame, radius: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(links from buckets of up to ``most`` nodes, nodes of larger buckets).

    Buckets are counted before their members meet. A bucket is the hash of table and masked bits;
    two that share a hash only add candidates, as the bits of every pair are compared.
    """
    masked = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])
    tables = nodes.select("fingerprint", F.posexplode(masked).alias("table", "key")).select(
        "fingerprint", F.xxhash64("table", "key").alias("bucket"))
    sizes = stored(tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    members = stored(tables.join(sizes.hint("merge"), "bucket"), "simhash-members")
    lists = members.where(F.col("n") <= most).groupBy("bucket").agg(F.collect_list("fingerprint").alias("members"))
    forest = lists.select("members").mapInArrow(partial(_forest, radius), "a long, b long")
    return forest, members.where(F.col("n") > most).select("fingerprint").distinct()


def links_by_middle(nodes: DataFrame, radius: int) -> DataFrame:
    """Links of nodes listed under all words within half the radius, which must be even."""
    if radius % 2:
        raise ValueError("an even radius is needed")
    listed = nodes.select("fingerprint", F.col("fingerprint").alias("middle"), F.lit(-1).alias("last"))
    for _ in range(radius // 2):
        # Flip one more bit beyond the last one, or none (64) from here on: every set of bits comes once.
        more = f"if(last < {BITS - 1}, transform(sequence(last + 1, {BITS - 1}), i -> struct(middle ^ shiftleft(1L, i) AS middle, i AS last)), array())"
        listed = listed.select("fingerprint", F.explode(F.expr(f"concat(array(struct(middle, {BITS} AS last)), {more})")).alias("x")).select(
            "fingerprint", "x.middle", "x.last")
    least = stored(
        listed.groupBy("middle").agg(F.min("fingerprint").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "simhash-middles")
    found = listed.join(least, "middle").where("fingerprint != least")
    return found.select(F.col("least").alias("a"), F.col("fingerprint").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, radius: int = 4, most: int = 2000, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Append ``fingerprint`` (signed 64-bit) and ``component_id``, the least doc_id reachable by links."""
    names = ["fingerprint", "component_id"]
    rest = without(docs, names)
    small = stored(add_columns(rest, text, {"fingerprint": T.LongType()}, partial(_fingerprints, width), ["doc_id"]), "simhash")
    nodes = stored(small.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    direct, crowded = links_in_buckets(nodes, radius, most)
    crowded = stored(crowded, "simhash-crowded")
    if not crowded.isEmpty():
        direct = direct.unionByName(links_by_middle(crowded, radius))
    links = stored(direct, "simhash-links")
    found = components(links)
    placed = nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    placed = stored(placed, "simhash-roots")
    least = stored(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    of_node = stored(placed.join(least, "root").select("fingerprint", "component_id"), "simhash-components")
    if keep == ["doc_id"]:
        return small.join(of_node, "fingerprint").select("doc_id", *names)
    carried = add_columns(rest, text, {"fingerprint": T.LongType()}, partial(_fingerprints, width), keep)
    return carried.join(of_node, "fingerprint").select(*[F.col(f"`{c}`") for c in carried.columns], "component_id")
