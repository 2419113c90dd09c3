"""Phrase collocations by the stripes pattern.

A stripe belongs to a prefix, a phrase of m - 1 words, and counts the words that come next. Every task forms the stripes of its own texts, a window
of words at a time; stripes of one prefix are merged element by element. A merged stripe gives the counts of the phrases that extend its prefix, the
prefix's own total (occurrences without a counted next word are held under the empty word) and the largest extension, which decides what is subsumed.

One pass over the texts for each length; from three words on over their runs of words that frequent pairs link, which are written once. A phrase can only be frequent if both phrases it has by leaving out its last or first word are; the pass of
length m therefore counts only where a bitmap of a fixed size (``FILTER_BITS``, by hash of language and words) has both. The bitmap is a filter:
two phrases with one bit only add work. Stripes travel in buckets, by the hash of the prefix, a row for each bucket of a window. The stripe of the
empty prefix and of each prefix said ``SPLIT`` times or more (a second bitmap) is dealt over all buckets by the hash of its next words; other stripes
have fewer elements than that. Buckets follow the shuffle partitions; a task merges one bucket at a time.

Words are folded (A-Z only) and cut from pieces between punctuation and line ends; null texts are empty, a null language is ``und``. Repeated rows
count again. Ties are ordered by count and phrase. A table without frequent phrases gives no rows.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.llm.common import stored

#: Words that a task turns into stripes at once; a longer text stands alone.
WINDOW = 500_000
FILTER_BITS = 25
#: Occurrences of a prefix from which its stripe is dealt over all buckets.
SPLIT = 200_000
BUCKETS = 8  # for each shuffle partition
LONGEST = 5
NO_LANG = "und"
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(_UPPER + _CUTS, _LOWER + b"\n" * len(_CUTS))
_END = b"."  # free as a mark once the cuts are folded
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 20_000
#: One bucket of a window: prefixes (after the language in hexadecimal) and words are joined by line ends; sizes (words of each prefix) and
#: counts are packed numbers.
STRIPES = "bucket int, prefixes binary, sizes binary, words binary, counts binary"
MERGED = "lang string, prefix string, total long, words array<string>, counts array<long>"


def tokens(text: bytes) -> list[bytes]:
    """Folded words of a text with a mark after each piece."""
    return [*text.translate(_FOLD).replace(b"\n", b" . ").split(), _END]


def _seed(lang: bytes) -> int:
    return xxhash.xxh64_intdigest(lang)


def _chain(held: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return (held ^ (held >> np.uint64(29))) * _ODD + word


def _bit(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) * _ODD) >> np.uint64(64 - FILTER_BITS)


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = _bit(hashes)
    return (bitmap[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) > 0


class _Numbers(dict):
    """Numbers of one language's words in a window; 0 is the mark."""

    def __init__(self, window: "_Window", lang: bytes):
        super().__init__({_END: 0})
        self.window, self.lang = window, lang

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.window.words)
        self.window.words.append(word)
        self.window.langs.append(self.lang)
        return number


class _Window:
    """Some texts as one array of word numbers, which tell languages apart."""

    def __init__(self):
        self.words, self.langs, self.numbers, self.parts, self.size = [b""], [b""], {}, [], 0

    def add(self, lang: bytes, text: bytes) -> None:
        of = self.numbers.get(lang)
        if of is None:
            of = self.numbers[lang] = _Numbers(self, lang)
        found = tokens(text)
        self.parts.append(np.fromiter(map(of.__getitem__, found), np.int64, len(found)))
        self.size += len(found)

    def hashes(self) -> np.ndarray:
        seeds = {lang: _seed(lang) for lang in self.numbers} | {b"": 0}
        return np.array([xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(self.words, self.langs)], np.uint64)

    def pairs(self, length: int, passed: np.ndarray | None, hashes: np.ndarray):
        """(numbers of the prefix's words, hash of the prefix, next word, count) of each distinct phrase, as arrays.

        The next word is 0 for occurrences of the prefix that no phrase of ``length`` can follow.
        """
        words, many = np.concatenate(self.parts), len(self.words)
        if length == 1:
            counts = np.bincount(words, minlength=many)
            counts[0] = 0
            seen = np.flatnonzero(counts)
            return [], None, seen, counts[seen]
        size = max(len(words) - length + 2, 0)
        alive, held = words[:size] > 0, hashes[words[:size]]
        for j in range(1, length - 1):
            alive &= words[j : j + size] > 0
            held = _chain(held, hashes[words[j : j + size]])
        alive &= _marked(passed, held)
        at = np.flatnonzero(alive)
        going = np.append(alive[1:], False)[at]  # the next place starts a passed phrase too
        following = np.where(going, words[np.minimum(at + length - 1, len(words) - 1)], 0)
        prefix, first = words[at], None
        for j in range(1, length - 1):
            _, prefix = np.unique(prefix * many + words[at + j], return_inverse=True)
        pair, first, counts = np.unique(prefix * many + following, return_index=True, return_counts=True)
        return [words[at[first] + j] for j in range(length - 1)], held[at[first]], pair % many, counts

    def stripes(self, length: int, passed: np.ndarray | None, heavy: np.ndarray | None, buckets: int):
        hashes = self.hashes()
        prefix, held, following, counts = self.pairs(length, passed, hashes)
        if not len(following):
            return
        lang_numbers = {k: i for i, k in enumerate(self.numbers)}
        lang = np.array([lang_numbers.get(k, 0) for k in self.langs])[prefix[0] if prefix else following]
        by = hashes[following] if held is None else held
        if held is not None and heavy is not None:
            by = np.where(_marked(heavy, held) & (following > 0), _chain(held, hashes[following]), held)
        bucket = (by % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort([*prefix[::-1], lang, bucket])
        keys = [k[order] for k in (bucket, lang, *prefix)]
        changed = [k[1:] != k[:-1] for k in keys]
        stripe_starts = np.flatnonzero(np.append(True, reduce(np.logical_or, changed)))
        starts = np.flatnonzero(np.append(True, changed[0]))
        sizes = np.diff(np.append(stripe_starts, len(order))).astype(np.int32)
        text, following, counts = np.array(self.words, object), following[order], counts[order].astype(np.int64)
        langs, rows = [k.hex().encode() for k in self.numbers], []
        for at, end in zip(starts, np.append(starts[1:], len(order))):
            first, last = np.searchsorted(stripe_starts, [at, end])
            stripes = stripe_starts[first:last]
            said = [text[k[stripes]].tolist() for k in keys[2:]]
            prefixes = [b" ".join(p) for p in zip([langs[k] for k in keys[1][stripes].tolist()], *said)]
            rows.append((int(keys[0][at]), b"\n".join(prefixes), sizes[first:last].tobytes(),
                         b"\n".join(text[following[at:end]].tolist()), counts[at:end].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "prefixes", "sizes", "words", "counts"])


    def runs(self, passed: np.ndarray):
        """(language, text) of the maximal runs of words whose neighbours all are passed pairs, with a mark after each."""
        words, hashes = np.concatenate(self.parts), self.hashes()
        linked = (words[:-1] > 0) & (words[1:] > 0)
        linked &= _marked(passed, _chain(hashes[words[:-1]], hashes[words[1:]]))
        before, after = np.append(False, linked), np.append(linked, False)
        at = np.flatnonzero(before | after)
        shown = np.where(after[at], words[at], -words[at])  # the last word of a run, made negative
        text, lang_numbers = np.array([_END, *self.words[1:]], object), {k: i for i, k in enumerate(self.numbers)}
        lang = np.array([lang_numbers.get(k, 0) for k in self.langs])[words[at]]
        for name, number in lang_numbers.items():
            mine = shown[lang == number]
            if len(mine):
                ends = np.flatnonzero(mine < 0) + 1
                yield name, b" ".join(text[np.insert(np.abs(mine), ends, 0)].tolist())


def _windows(batches):
    window = _Window()
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            window.add(lang.as_py(), text.as_py())
            if window.size >= WINDOW:
                yield window
                window = _Window()
    if window.size:
        yield window


def _runs(passed, batches):
    bitmap = np.frombuffer(passed.value, np.uint64)
    for window in _windows(batches):
        rows = list(window.runs(bitmap))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["lang", "text"])


def _stripes(length: int, passed, heavy, buckets: int, batches):
    passed, heavy = (None if b is None else np.frombuffer(b.value, np.uint64) for b in (passed, heavy))
    for window in _windows(batches):
        yield from window.stripes(length, passed, heavy, buckets)


def _merge(least: int, batches):
    """Stripes of one bucket, whose rows follow each other, added up element by element."""
    key, stripes = None, {}

    def merged():
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        rows = []
        for said, stripe in stripes.items():
            lang, _, prefix = said.partition(b" ")
            kept = sorted((w, n) for w, n in stripe.items() if n >= least and w)
            rows.append((bytes.fromhex(lang.decode()), prefix, sum(stripe.values()), [w for w, _ in kept], [n for _, n in kept]))
        for a in range(0, len(rows), _ROWS):
            columns = zip(*rows[a : a + _ROWS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "prefix", "total", "words", "counts"])

    for batch in batches:
        for i in range(batch.num_rows):
            bucket, prefixes, sizes, words, counts = (batch.column(n)[i].as_py() for n in batch.schema.names)
            if bucket != key:
                if key is not None:
                    yield from merged()
                key, stripes = bucket, {}
            words, counts, at = words.split(b"\n"), np.frombuffer(counts, np.int64).tolist(), 0
            for prefix, size in zip(prefixes.split(b"\n"), np.frombuffer(sizes, np.int32).tolist()):
                stripe = stripes.setdefault(prefix, {})
                for word, n in zip(words[at : at + size], counts[at : at + size]):
                    stripe[word] = stripe.get(word, 0) + n
                at += size
    if key is not None:
        yield from merged()


def _phrase_bits(batches):
    """(place, bits) of phrases in a bitmap of 64-bit numbers."""
    for batch in batches:
        hashes = []
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
            seed = _seed(lang)
            hashes.append([xxhash.xxh64_intdigest(w, seed) for w in phrase.split(b" ")])
        if not hashes:
            continue
        table = np.array(hashes, np.uint64)
        held = table[:, 0]
        for j in range(1, table.shape[1]):
            held = _chain(held, table[:, j])
        bits = _bit(held)
        values = (np.uint64(1) << (bits & np.uint64(63))).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array((bits >> np.uint64(6)).astype(np.int32)), pa.array(values)], names=["place", "bits"])


def phrase_filter(phrases: DataFrame) -> bytes:
    """The bitmap of some phrases of one length; its size is 2^FILTER_BITS bits whatever their number."""
    binary = phrases.select(F.col("lang").cast("binary"), F.col("phrase").cast("binary"))
    set_bits = binary.mapInArrow(_phrase_bits, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[set_bits["place"].to_numpy(np.int64)] = set_bits["bits"].to_numpy(np.int64)
    return bitmap.tobytes()


def merged_stripes(texts: DataFrame, length: int, least: int, passed=None, heavy=None) -> DataFrame:
    """Stripes of all prefixes of ``length`` - 1 words that ``passed`` lets through, those in ``heavy`` in several rows; next words from ``least`` on are listed."""
    buckets = BUCKETS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = texts.mapInArrow(partial(_stripes, length, passed, heavy, buckets), STRIPES)
    met = stripes.repartition("bucket").sortWithinPartitions("bucket")
    binary = MERGED.replace("string", "binary")
    merged = met.mapInArrow(partial(_merge, least), binary)
    return merged.select(
        F.col("lang").cast("string"), F.col("prefix").cast("string"), "total", F.col("words").cast("array<string>"), "counts")


def _entries(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, n) of the listed extensions."""
    flat = stripes.select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    return flat.select("lang", F.concat_ws(" ", F.nullif("prefix", F.lit("")), "e.words").alias("phrase"), F.col("e.counts").alias("n"))


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = LONGEST, top: int = 2000, subsume: int = 100, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Phrases of 2 to ``longest`` words said ``least`` times or more, per language, by the score of their weakest cut.

    Score of a cut into parts said l and r times: floor(1000 * a * n / (l * r)), exact in 38 decimal digits. A phrase inside a longer one that is said
    at least ``subsume`` hundredths as often is dropped; as counts never rise with length, the phrases of one word more decide this.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).cast("binary").alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    levels, passed, heavy = [], None, None
    for length in range(1, longest + 1):
        if length == 3:
            texts = stored(texts.mapInArrow(partial(_runs, passed), "lang binary, text binary"), "phrase-runs")
        levels.append(stored(merged_stripes(texts, length, least, passed, heavy), f"stripes-{length}"))
        for bitmap in filter(None, (passed, heavy)):
            bitmap.destroy()
        found = _entries(levels[-1])
        if length == longest or found.isEmpty():
            break
        passed = spark.sparkContext.broadcast(phrase_filter(found))
        many = found.where(F.col("n") >= SPLIT)
        heavy = None if many.isEmpty() else spark.sparkContext.broadcast(phrase_filter(many))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    whole = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    if len(levels) == 1:
        return whole.select("lang", F.lit(1).cast("long").alias("rank"), F.lit("").alias("phrase"), *[F.lit(0).cast("long").alias(c) for c in ("a", "l", "r")],
                            "n", F.lit(0).cast("long").alias("score")).limit(0)
    totals = stored(
        union(levels[1:]).groupBy("lang", "prefix").agg(F.sum("total").alias("said"), F.max(F.array_max("counts")).alias("longer")).where(
            F.col("said") >= least), "phrase-totals")
    candidates = stored(union([_entries(x) for x in levels[1:]]).withColumnRenamed("n", "a"), "phrases")
    words = candidates.withColumn("words", F.split("phrase", " "))
    size = F.size("words")
    # The largest extension to the right stands in the phrase's own stripe; to the left each phrase tells the one without its first word.
    left = words.where(size > 2).select("lang", _part(F.lit(2), size - 1).alias("phrase"), F.col("a").alias("longer"))
    right = totals.where("longer is not null").select("lang", F.col("prefix").alias("phrase"), "longer")
    longer = left.unionByName(right).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = words.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < subsume * F.col("a"), F.lit(True)))
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(totals.select("lang", F.col("prefix").alias("first"), F.col("said").alias("l")), ["lang", "first"])
    cuts = cuts.join(totals.select("lang", F.col("prefix").alias("rest"), F.col("said").alias("r")), ["lang", "rest"]).join(whole, "lang")
    exact = "(cast(a as decimal(19, 0)) * 1000 * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r", "a", "n")).alias("c"))
    rows = weakest.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
