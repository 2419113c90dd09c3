import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from check import connect, difference
from kmerlake.llm import phrases
from kmerlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000, longest=5):
    said, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    said[lang, tuple(words[i : i + m])] += 1
    frequent = {k: a for k, a in said.items() if a >= least and len(k[1]) > 1}
    held = {}
    for (lang, p), a in frequent.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    held[lang, p[i:j]] = max(held.get((lang, p[i:j]), 0), a)
    out = {}
    for (lang, p), a in frequent.items():
        if held.get((lang, p), 0) >= a:
            continue
        cuts = [(1000 * a * n[lang] // (said[lang, p[:k]] * said[lang, p[k:]]), k, said[lang, p[:k]], said[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def random_rows(count, seed):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "é", "d\u0085d", "的", "e\x1cf", "new", "york", "City"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0c"]) for _ in range(rng.randint(0, 60)))
        text = text.replace("cc", "the New York times of today") if rng.random() < 0.3 else text
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", "fr"), (" \t ", None), ("x", "zz"), rows[0], rows[0]]


@pytest.mark.parametrize("least,window", [(3, 50), (2, 2_000_000), (40, 500)])
def test_against_brute_force(spark, monkeypatch, least, window):
    monkeypatch.setattr(phrases, "WINDOW", window)
    monkeypatch.setattr(phrases, "SPLIT", window // 2)
    rows = random_rows(150, least)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5).withColumns({"phrase": F.lit(1), "words": F.lit("x"), "n": F.lit(2)})
    got = rows_of(phrases.collocations(docs, least=least))
    want = brute(rows, least)
    assert want and got == want
    assert rows_of(phrases.collocations(docs, least=least, top=3)) == {r for r in want if r[1] <= 3}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = random_rows(40, 5)
    monkeypatch.setattr(phrases, "phrase_filter", lambda found: b"\xff" * (1 << (phrases.FILTER_BITS - 3)))
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(phrases.collocations(docs, least=4)) == brute(rows, 4)


def test_edges(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(none).collect() == []
    long = "Over and over " * 50_000
    got = phrases.collocations(spark.createDataFrame([(long, None), ("one two", "en")], "text string, lang string"))
    assert rows_of(got) == brute([(long, None)], 100)
    assert [f.dataType.simpleString() for f in phrases.collocations(none).schema] == [f.dataType.simpleString() for f in got.schema]


def test_registered_query(spark):
    got = QUERIES["op12_phrase_collocations"](spark, SF).toPandas()
    assert len(got) and difference(got, connect(SF).execute(ORACLES["op12_phrase_collocations"]).df()) is None


def test_windows_hold_a_bounded_number_of_words():
    """A task holds 500,000 words and one text at a time."""
    import pyarrow as pa
    text = b"a b c d " * 25_000
    batch = pa.RecordBatch.from_arrays([pa.array([b"en"] * 25), pa.array([text] * 25)], names=["lang", "text"])
    sizes = [w.size for w in phrases._windows([batch])]
    assert max(sizes) < 500_000 + 100_002 and sum(sizes) == 25 * 100_001
