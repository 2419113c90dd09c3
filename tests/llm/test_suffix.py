import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.llm.suffix import gram_hashes, matching_statistics, remove_repeats, runs_of, suffix_order


def longest(strings):
    """Longest match elsewhere of each place, by comparison of all pairs of places."""
    out = []
    for k, s in enumerate(strings):
        for i in range(len(s)):
            best = 0
            for m, t in enumerate(strings):
                for j in range(len(t)):
                    if (k, i) != (m, j):
                        n = 0
                        while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]:
                            n += 1
                        best = max(best, n)
            out.append(best)
        out.append(None)
    return out


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(120):
        letters = rng.sample(range(256), rng.choice([1, 2, 3, 26]))
        base = bytes(rng.choices(letters, k=40))
        strings = [base[rng.randrange(20) :][: rng.randrange(1, 30)] for _ in range(rng.randrange(1, 6))]
        for want, got in zip(longest(strings), matching_statistics(strings)):
            assert want is None or want == got


def test_suffix_order():
    text = b"banana\0bandana\0"
    left = np.array([6, 5, 4, 3, 2, 1, 0, 7, 6, 5, 4, 3, 2, 1, 0])
    order = suffix_order(np.frombuffer(text, np.uint8).astype(np.int64), left)
    assert order.tolist() == sorted(range(15), key=lambda i: (text[i : i + left[i]], i))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    shared = bytes(rng.choices(b"abcd ", k=300))
    found = []
    for _ in range(2):
        data = bytes(rng.choices(b"abcd ", k=500)) + shared + bytes(rng.choices(b"abcd ", k=400))
        start, windows, anchor, _ = runs_of(np.frombuffer(data, np.uint8), 200)
        assert start[0] == 0 and windows.sum() == len(data) - 199
        found.append(np.repeat(anchor, windows)[500 : 500 + 101])
    assert (found[0] == found[1]).all()


def test_hashes_tell_single_bytes_apart():
    rng = np.random.default_rng(9)
    for place in range(64):
        grams = np.repeat(rng.integers(0, 256, (1, 64), dtype=np.uint8), 256, axis=0)
        grams[:, place] = np.arange(256)
        assert len({int(gram_hashes(g)[0]) for g in grams}) == 256


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = set()
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone |= set(range(i, i + length))
        spans = [i for i in sorted(gone) if i - 1 not in gone]
        out.append((len(b), len(gone), len(spans), bytes(c for i, c in enumerate(b) if i not in gone)))
    return out


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghé", k=rng.randrange(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared, other = text(60), text(45)
    texts = [text(50) + shared + text(30) for _ in range(12)] + [other + text(10) + other, text(120)]
    texts += [texts[0], texts[0][:-3] + "zzz", texts[3][100:], "a" * 900, "ab" * 300 + "c" + "ab" * 300, shared[:199], shared[:200], "", None]
    return texts + [f"line {i}\n" * 40 for i in range(3)] + [texts[13] * 2]


@pytest.mark.parametrize("most", [1000, 2])
def test_equals_brute_force(spark, most):
    texts = corpus()
    docs = spark.createDataFrame([(i // 2 * 2, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    rows = remove_repeats(docs, 200, most).collect()
    got = Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in rows)
    assert got == Counter((i // 2 * 2, *x) for i, x in enumerate(brute(texts, 200)))


def test_rows(spark, odd_docs):
    rows = remove_repeats(odd_docs).collect()
    assert len(rows) == 10 and all(not r["removed"] for r in rows)
    assert remove_repeats(odd_docs.limit(0)).count() == 0
    long = odd_docs.where("doc_id = 7").selectExpr("cast(null as long) as doc_id", "text")
    assert [len(r["kept"]) for r in remove_repeats(long.union(long)).collect()] == [0, 0]


def test_context_hash_reads_every_byte():
    from kmerlake.llm.suffix import runs_of

    data = np.random.default_rng(9).integers(97, 123, 900).astype(np.uint8)
    start, windows, anchor, context = runs_of(data, 300)
    for at in range(len(data)):
        other = data.copy()
        other[at] = 65
        places = {(s, w): c for s, w, c in zip(*(x.tolist() for x in (lambda r: (r[0], r[1], r[3]))(runs_of(other, 300))))}
        for s, w, c in zip(start.tolist(), windows.tolist(), context.tolist()):
            if (s, w) in places:
                assert (places[s, w] != c) == (s <= at < s + w + 299)


def test_rows_without_id_are_told_apart_by_more_than_32_bits(spark):
    """Two texts with one 32-bit hash, neither with an id: only the one that stands elsewhere goes."""
    text = F.concat(*[F.sha2(F.concat(F.col("id"), F.lit(f"/{k}")), 256) for k in range(5)])
    texts = spark.range(300_000).select("id", text.alias("text"))
    clash = texts.select("id", F.hash("text").alias("h")).groupBy("h").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").first()["ids"]
    a, b = (texts.where(F.col("id") == k).first()["text"] for k in clash[:2])
    docs = spark.createDataFrame([(None, a), (None, b), (7, a)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, len(r["kept"])) for r in remove_repeats(docs).collect())
    assert rows == [(0, 0), (0, 320), (7, 0)]
