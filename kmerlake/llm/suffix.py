"""Removal of long repeated byte strings with a run-length Burrows-Wheeler index.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

1. Anchors. In each window of ``length`` bytes the gram with the least hash (the leftmost of equals)
   is the window's anchor, so equal windows have equal anchors at one offset. Consecutive windows
   with one anchor are a run; the bytes they cover are its context.
2. Runs whose anchor hash occurs once have no repeat. Equal contexts of one anchor are repeats as a
   whole, found by counting hashes; their bytes are not moved.
3. One copy of each other context is fetched and dealt out by anchor hash. Whole groups are joined to
   an index of bounded size: suffix order, Burrows-Wheeler transform, its runs, and samples at the
   first and last row of each run. Only at samples are suffixes compared with their neighbours; the
   matching statistics of all other places follow in one stream through the text, since they fall
   by one from place to place. Windows whose statistic reaches ``length`` are marked.
4. Groups with more than ``most`` runs are cut before they are indexed: the windows of a half (by
   their start against the anchor) all cover a core of bytes, so only runs that agree on the core
   stay together. Equal parts are repeats as a whole; halves of others are cut again until a group
   is small.

Null and empty texts have no bytes, texts shorter than ``length`` no windows. Rows are documents:
repeated rows repeat each other, also with one doc_id. Matches never cross documents.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.llm.common import pieces, stored

GRAM = 64
BLOCK = 1 << 18  # bytes hashed at once
INDEX = 1 << 20  # bytes in one index
FLUSH = 500  # rows worked on at once
CROWDED = ["doc_id", "hash", "anchor", "alone", "start", "place", "low", "high", "bytes"]
_CROWDED_TYPES = "doc_id long, hash binary, anchor long, alone boolean, start long, place int, low int, high int, bytes binary"
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K[0]
    x ^= (b + _K[2]) * _K[1]
    x ^= x >> np.uint64(32)
    x *= _K[3]
    x ^= x >> np.uint64(29)
    return x


def _scramble(words: np.ndarray) -> np.ndarray:
    """One-to-one, so that words that differ in any byte keep different values."""
    x = words * _K[0]
    x ^= x >> np.uint64(32)
    x *= _K[3]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place of ``data`` (uint8)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = np.ndarray(len(data) - 7, "<u8", padded, strides=(1,))
    h, width = _scramble(h), 8
    while width < GRAM:
        h, width = _mix(h[:-width], h[width:]), 2 * width
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor hash, context hash) of each run of a stretch of at least ``length`` bytes."""
    h = gram_hashes(data)
    order = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    least = (_sliding_least(order, length - GRAM + 1) & _LOW).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    windows = np.diff(np.append(start, len(least)))
    wide = lambda at: _mix(h[at], h[at + GRAM])  # noqa: E731  hash of 2 * GRAM bytes
    last = start + windows + length - 1 - 2 * GRAM
    context = windows.astype(np.uint64)
    for step in range(0, 2 * length - GRAM, 2 * GRAM):  # no context has more bytes than 2 * length - GRAM
        context = _mix(context, wide(np.minimum(start + step, last)))
    return start, windows, h[least[start]].view(np.int64), context.view(np.int64)


def _runs(length: int, batches):
    """Runs of all rows; a long text is cut into stretches that share no window."""
    names = ["doc_id", "hash", "anchor", "context", "start", "windows"]
    for batch in batches:
        for part in pieces(batch, "_text"):
            out = [[] for _ in range(5)]
            for row, text in enumerate(part.column("_text")):
                raw = text.as_buffer() if text.is_valid else b""
                data = np.frombuffer(raw, np.uint8) if raw and len(raw) >= length else np.zeros(0, np.uint8)
                for at in range(0, len(data) - length + 1, BLOCK):
                    start, windows, anchor, context = runs_of(data[at : at + BLOCK + length - 1], length)
                    for held, x in zip(out, (np.full(len(start), row), anchor, context, start + at, windows)):
                        held.append(x)
            if out[0]:
                rows, anchor, context, start, windows = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows)), part.column("hash").take(pa.array(rows)), pa.array(anchor),
                     pa.array(context), pa.array(start.astype(np.int64)), pa.array(windows.astype(np.int32))], names=names)


def _pack(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in pieces(batch, "_text"):
            packed = [None if t is None else squeeze.compress(t.encode()) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("hash"), pa.array(packed, pa.binary())], names=["doc_id", "hash", "packed"])


def _unpack(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def _asked_parts(length: int, batch: pa.RecordBatch):
    """Row runs of a batch that ask for about INDEX bytes; contexts overlap, so a long text asks for several times its size."""
    if batch.num_rows == 0:
        return
    lists = batch.column("asked")
    sizes = np.concatenate([[0], np.cumsum(lists.flatten().field("windows").to_numpy(zero_copy_only=False).astype(np.int64) + length - 1)])
    upto = sizes[np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))]
    part = upto // INDEX
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]]).tolist()
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _contexts(length: int, batches):
    """The bytes of the runs asked for."""
    names = ["doc_id", "hash", "anchor", "alone", "crowded", "start", "bytes"]
    for batch in batches:
        for part in _asked_parts(length, batch):
            lists = part.column("asked")
            asked, each = lists.flatten(), pa.array(np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(lists).to_numpy()))
            spans = iter(zip(asked.field("start").to_pylist(), asked.field("windows").to_pylist()))
            cut = []
            for packed, count in zip(part.column("packed"), pa.compute.list_value_length(lists).to_pylist()):
                text = _unpack(packed.as_py())
                cut += [text[a : a + w + length - 1] for a, w in islice(spans, count)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(each), part.column("hash").take(each), asked.field("anchor"), asked.field("alone"),
                 asked.field("crowded"), asked.field("start"), pa.array(cut, pa.binary())], names=names)


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order. ``left``: bytes from each place to the end of its string, where the suffix
    ends; a separator place has 0. Equal suffixes are ordered by place."""
    n = len(symbols)
    key, padded = np.zeros(n, np.int64), np.concatenate([symbols, np.zeros(8, np.int64)])
    for k in range(7):
        key = key << 9 | np.where(left > k, padded[k : k + n] + 1, 0)
    order = np.argsort(key)
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    width, most = 7, int(left.max(initial=0))
    open_ = order[~(first & np.append(first[1:], True))]
    while width < most and len(open_):
        ahead = np.where(left[open_] > width, rank[np.minimum(open_ + width, n - 1)] + 1, 0)
        by = np.argsort(rank[open_] * (n + 1) + ahead)
        open_, ahead, group = open_[by], ahead[by], rank[open_][by]
        new_group = np.concatenate([[True], np.diff(group) != 0])
        new = new_group | np.concatenate([[True], np.diff(ahead) != 0])
        places = np.arange(len(open_))
        rank[open_] = group + np.maximum.accumulate(np.where(new, places, 0)) - np.maximum.accumulate(np.where(new_group, places, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    return np.argsort(rank * n + np.arange(n))


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Equal bytes from places ``a`` and ``b`` on, up to ``limit``; ``data`` has 8 bytes of padding."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out, at = np.zeros(len(a), np.int64), np.arange(len(a))
    done = 0
    while len(at):
        more = words[np.minimum(a[at] + done, len(words) - 1)] ^ words[np.minimum(b[at] + done, len(words) - 1)]
        low = more & (~more + np.uint64(1))
        equal = np.where(more == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        out[at] = done + equal
        at = at[(more == 0) & (limit[at] > done + 8)]
        done += 8
    return np.minimum(out, limit)


def matching_statistics(strings: list[bytes]) -> np.ndarray:
    """For each place of the joined strings (one separator after each) its longest match that starts elsewhere."""
    raw = np.frombuffer(b"\0".join(strings) + b"\0" * 9, np.uint8)
    n = len(raw) - 8
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    left = np.repeat(ends, sizes + 1) - np.arange(n)
    order = suffix_order(raw[:n].astype(np.int64), left)
    # The transform: the symbol before each suffix; the separators before string starts all differ.
    before = np.where(order > 0, raw[order - 1].astype(np.int64), -1)
    starts = np.zeros(n, bool)
    starts[np.concatenate([[0], ends[:-1] + 1])] = True
    before = np.where(starts[order], -1 - order, before)
    head = np.concatenate([[True], before[1:] != before[:-1]])
    tail = np.append(head[1:], True)
    places, best = np.arange(n), np.zeros(n, np.int64)
    for sampled, step in ((head, -1), (tail, 1)):
        rows = np.flatnonzero(sampled)
        other = rows + step
        inside = (other >= 0) & (other < n)
        a, b = order[rows], order[np.clip(other, 0, n - 1)]
        value = np.where(inside, common_prefix(raw, a, b, np.minimum(left[a], left[b])), 0)
        known, at = np.zeros(n, bool), np.zeros(n, np.int64)
        known[a], at[a] = True, value
        source = np.maximum.accumulate(np.where(known, places, 0))
        best = np.maximum(best, at[source] - (places - source))
    return best


def _mark(length: int, batches):
    """Marked windows of the contexts that occur once; rows arrive grouped."""
    held: list[tuple] = []
    size = 0

    def index():
        strings = [h[4] for h in held]
        if len(strings) > 1:
            hit = matching_statistics(strings) >= length
            at = 0
            out = []
            for doc, hash_, alone, start, text in held:
                if alone:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[at : at + len(text)].view(np.int8), [0]])))
                    out += [(doc, hash_, start + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]
                at += len(text) + 1
            if out:
                docs, hashes, starts, windows = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(hashes, pa.binary()), pa.array(starts, pa.int64()), pa.array(windows, pa.int32())],
                    names=["doc_id", "hash", "start", "windows"])

    last = None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("group", "doc_id", "hash", "alone", "start", "bytes")]
        for group, *row in zip(*columns):
            if size > INDEX and group != last:
                yield from index()
                held, size = [], 0
            held.append(tuple(row))
            size += len(row[-1])
            last = group
    yield from index()


def _anchor_place(text: bytes, length: int) -> int:
    """Place of the anchor of the first window."""
    h = gram_hashes(np.frombuffer(text, np.uint8)[:length])
    return int(((h & _HIGH) | np.arange(len(h), dtype=np.uint64)).argmin())


def _halves(length: int, batches):
    """Cut the windows of each row by their start against the anchor, [low, high), in two halves.

    All windows of a half cover a core of bytes; only rows that agree on it can share a window.
    """
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
    for batch in batches:
        for first in range(0, batch.num_rows, FLUSH):
            out: list[tuple] = []
            for row in zip(*[batch.slice(first, FLUSH).column(c).to_pylist() for c in CROWDED]):
                doc, hash_, anchor, alone, start, place, low, high, text = row
                place = _anchor_place(text, length) if place is None else place
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle, high)):
                    one, end = max(a, -place), min(b, len(text) - length + 1 - place)
                    if one < end:
                        core = xxhash.xxh3_128_digest(text[b - 1 + place : a + length + place])
                        part = text[one + place : end - 1 + length + place]
                        same = xxhash.xxh3_128_digest(part)
                        out.append((doc, hash_, anchor, alone, start + one + place, -one, a, b, part, core, same))
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*CROWDED, "core", "part"])


def _split_crowded(rows: DataFrame, length: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(groups of up to ``most`` rows to index, marked windows) of the runs of crowded anchors.

    Halves are grouped by anchor, half and core. Equal parts of a group are repeats as a whole and
    go on as one row; groups of one part vanish, small ones are indexed, and the others are cut
    again. A half of one window is its core, so the cutting ends there.
    """
    whole = [F.lit(None).cast("int").alias("place"), F.lit(GRAM - length).alias("low"), F.lit(1).alias("high")]
    rows = rows.select("doc_id", "hash", "anchor", "alone", "start", *whole, "bytes")
    small, marked, by = [], [], ["anchor", "low", "high", "core"]
    while not rows.isEmpty():
        halves = stored(rows.mapInArrow(partial(_halves, length), f"{_CROWDED_TYPES}, core binary, part binary"), "repeat-halves")
        parts = stored(halves.groupBy(*by, "part").agg(
            F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "hash", "alone", "start", "place", "bytes")).alias("first")), "repeat-parts")
        marked.append(halves.where("alone").join(parts.where("m > 1").select(*by, "part"), [*by, "part"]).select(
            "doc_id", "hash", "start", (F.length("bytes") - length + 1).alias("windows")))
        groups = stored(parts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-groups")
        open_ = stored(parts.join(groups, by).select(
            *by, "n", "first.doc_id", "first.hash", (F.col("first.alone") & (F.col("m") == 1)).alias("alone"),
            "first.start", "first.place", "first.bytes"), "repeat-open")
        small.append(open_.where(F.col("n") <= most).select(F.xxhash64(*by).alias("group"), "doc_id", "hash", "alone", "start", "bytes"))
        rows = open_.where(F.col("n") > most).select(*CROWDED)
    return small, marked


def text_key(text: Column) -> Column:
    """128 bits of a text: rows that share an id, or have none, are told apart by it."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def repeated_windows(docs: DataFrame, length: int = 200, most: int = 1000, text: str = "text") -> DataFrame:
    """(doc_id, hash, start, windows): stretches of window starts whose string starts elsewhere too.

    ``hash`` is the hash of the text, so that a doc_id given twice does not mix two texts.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    source = docs.select(F.col("doc_id").cast("long"), text_key(F.col(text)).alias("hash"), F.col(text).cast("string").alias("_text"))
    runs = source.mapInArrow(
        partial(_runs, length), "doc_id long, hash binary, anchor long, context long, start long, windows int")
    again = stored(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-anchors")
    shared = stored(runs.join(again, "anchor"), "repeat-runs")
    contexts = stored(shared.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("c"), F.max("n").alias("n"),
        F.min(F.struct("doc_id", "hash", "start", "windows")).alias("first")), "repeat-contexts")
    whole = shared.join(contexts.where("c > 1").select("anchor", "context"), ["anchor", "context"]).select(
        "doc_id", "hash", "start", "windows")
    asked = contexts.where("c < n").select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias("hash"),
        F.struct("anchor", (F.col("c") == 1).alias("alone"), (F.col("n") > most).alias("crowded"),
                 F.col("first.start").alias("start"), F.col("first.windows").alias("windows")).alias("ask"))
    wanted = stored(asked.groupBy("doc_id", "hash").agg(F.collect_list("ask").alias("asked")), "repeat-asked")
    fetched = stored(with_packed(source, wanted, "inner").mapInArrow(
        partial(_contexts, length), "doc_id long, hash binary, anchor long, alone boolean, crowded boolean, start long, bytes binary"),
        "repeat-bytes")
    small, marked = _split_crowded(fetched.where("crowded"), length, most)
    groups = fetched.where("not crowded").select(F.col("anchor").alias("group"), "doc_id", "hash", "alone", "start", "bytes")
    groups = reduce(DataFrame.unionByName, small, groups).repartition("group").sortWithinPartitions("group")
    indexed = groups.mapInArrow(partial(_mark, length), "doc_id long, hash binary, start long, windows int")
    return reduce(DataFrame.unionByName, [indexed, *marked], whole)


def with_packed(source: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
    """Texts, compressed for the shuffle, joined with one row for each (doc_id, hash)."""
    packed = source.mapInArrow(_pack, "doc_id long, hash binary, packed binary")
    other = per_text.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    return packed.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), how).drop("_id", "_hash")


def _cut(length: int, batches):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in pieces(batch, "packed"):
            kept, spans, sizes = [], [], []
            for packed, marks in zip(part.column("packed"), part.column("marks")):
                data = np.frombuffer(_unpack(packed.as_py()), np.uint8)
                goes = np.zeros(len(data) + 1, np.int32)
                if marks.is_valid:
                    start = marks.values.field("start").to_numpy()
                    np.add.at(goes, start, 1)
                    np.add.at(goes, start + marks.values.field("windows").to_numpy() + length - 1, -1)
                gone = np.cumsum(goes[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
                kept.append(data[~gone].tobytes())
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200, most: int = 1000, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: the maximal removed byte spans and the bytes that stay."""
    found = repeated_windows(docs, length, most, text)
    marks = stored(found.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("start", "windows")).alias("marks")), "repeat-marks")
    source = docs.select(F.col("doc_id").cast("long"), text_key(F.col(text)).alias("hash"), F.col(text).cast("string").alias("_text"))
    return with_packed(source, marks, "left").mapInArrow(
        partial(_cut, length), "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
