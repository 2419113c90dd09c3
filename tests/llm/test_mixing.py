import math

import pytest
from pyspark.sql import functions as F

from kmerlake.llm.mixing import _shares, bisect_exponent, mix_sources, source_totals, weigh


def shares_of(spark, tokens):
    rows = spark.createDataFrame([(s, n) for s, n in tokens.items()], "_source string, n_tokens long")
    return _shares(source_totals(rows))


def entropy(weights):
    return -sum(w * math.log(w) for w in weights) / math.log(len(weights))


def test_entropy_target(spark):
    shares = shares_of(spark, {"a": 9000, "b": 900, "c": 100})
    t = bisect_exponent(shares, 0.8, None, 1.0)
    at = lambda x: entropy([r["weight"] for r in weigh(shares, x).collect()])
    assert 0 < t < 1 and at(t) >= 0.8 > at(t + 1e-4)


def test_repeat_limit_wins(spark):
    shares = shares_of(spark, {"a": 9000, "b": 900, "c": 100})
    t = bisect_exponent(shares, 0.99, 3.0, 1.0)
    most = lambda x: weigh(shares, x).agg(F.max(F.col("weight") / F.col("share"))).first()[0]
    assert most(t) <= 3.0 < most(t - 1e-4)
    assert bisect_exponent(shares, None, 1e9, 1.0) == 0 and bisect_exponent(shares, None, None, 1.0) == 1
    assert bisect_exponent(shares, None, 0.5, 1.0) == 1  # cannot be met: natural shares


def test_budgets(spark):
    rows = [(i, "one two three four", "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mix_sources(docs, target_entropy=0.9, max_repeats=5.0, block_tokens=800)
    got = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    shares = shares_of(spark, {"big": 14400, "small": 1600})
    t = bisect_exponent(shares, 0.9, 5.0, 1.0)
    for r in weigh(shares, t).collect():
        assert got[r["_source"]] == pytest.approx(16000 * r["weight"], rel=0.03)
    small = drawn.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("epoch").alias("e"))
    assert small.where("n != e").isEmpty() and small.count() == 400  # whole passes before a part
    slots = drawn.groupBy("source", "block", "epoch").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d"))
    assert slots.where("n != d or m != n").isEmpty()
    orders = [[r["doc_id"] for r in drawn.where(f"source = 'small' and block = 0 and epoch = {e}").orderBy("slot").collect()] for e in (1, 2)]
    assert orders[0][: len(orders[1])] != orders[1]


def test_rows(odd_docs):
    rows = mix_sources(odd_docs, keep=["doc_id", "text", "source"]).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "1", "2", "3", "4", "5", "6", "7", "8", "None"])
    assert mix_sources(odd_docs.limit(0), 0.9, 2.0).count() == 0
    nothing = odd_docs.where("text is null or text = ''")
    assert mix_sources(nothing, 0.9, 2.0).count() == 2
