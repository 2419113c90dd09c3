import math

import numpy as np
import pytest

from kmerlake.llm import toxicity
from kmerlake.llm.common import id_remainder, table
from kmerlake.llm.queries import QUERIES
from kmerlake.llm.toxicity import SIZE, Block, Judge, Model, fit, gradient, score, sentences, word_features

SF = "/root/testdata/sf0.1"
#: English insults that the generated texts hold.
INSULTS = {"clown", "disgusting", "garbage", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"}


def naive(text, weights, bias):
    """Noisy-or, sentence by sentence."""
    stay = 1.0
    for _, _, words in sentences(text) or [(0, 0, [])]:
        z = bias + sum(weights[k] for w in words for k in word_features(w))
        stay *= 1 - 1 / (1 + math.exp(-z))
    return 1 - stay


def test_sentences():
    text = "Ab cd ab! 12 3.\nÉté_x?"
    assert [(text[a:b], w) for a, b, w in sentences(text)] == [("Ab cd ab", ["ab", "cd"]), ("Été_x", ["été", "x"])]
    assert sentences(None) == sentences("") == sentences("1 2. !") == []


def test_gradient_is_the_slope():
    texts = [("Bad idea here. Good one", 1.0), ("good. fine one. more", 0.0), ("", 0.0), (None, 1.0), ("bad", 1.0)]
    block = Block()
    for t, y in texts:
        block.add(t, y)
    rng = np.random.default_rng(1)
    weights = np.append(rng.normal(0, 0.3, SIZE), -0.7)
    g, loss, docs = gradient(weights, block.packed())
    scores = [naive(t, weights, weights[-1]) for t, _ in texts]
    assert docs == 5 and abs(loss + sum(math.log(s if y else 1 - s) for s, (_, y) in zip(scores, texts))) < 1e-9
    for k in [*word_features("bad"), *word_features("one")[:3], SIZE]:
        moved = weights.copy()
        moved[k] += 1e-6
        assert abs((gradient(moved, block.packed())[1] - loss) / 1e-6 - g[k]) < 1e-4


def test_scores_equal_the_noisy_or():
    weights = np.append(np.random.default_rng(2).normal(0, 0.5, SIZE), -1.0)
    judge = Judge(weights)
    for text in ["one. two three! one", "", None, "x" * 1000, "a. " * 500, "word " * 20000]:
        value, offending = judge.judge(text, 0.3)
        assert abs(value - naive(text, weights, -1.0)) < 1e-9
        for span in offending:
            assert abs(span["score"] - naive(text[span["start"] : span["end"]], weights, -1.0)) < 1e-9 and span["score"] >= 0.3


@pytest.mark.parametrize("blocks", [100, 500_000])
def test_held_out(spark, monkeypatch, blocks):
    """Toxic texts with a known insult are found, at the sentence; clean ones are left alone."""
    if blocks == 100:
        monkeypatch.setattr(toxicity, "_BLOCK_WORDS", 2000)
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = id_remainder(4) == 2
    model = fit(docs.where(~held), labels, "toxic", steps=40 if blocks == 100 else 60)
    rows = score(docs.where(held), model).join(labels, "doc_id").select("text", "toxic", "predicted", "score", "offending").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.55 * len(toxic)  # 329 toxic texts to learn from; see README for the larger table
    said = lambda text: INSULTS & set(text.lower().replace(".", " ").replace(",", " ").split())
    insult = [r for r in toxic if said(r["text"])]
    assert insult and sum(r["predicted"] for r in insult) >= 0.8 * len(insult)
    named = [r["text"][s["start"] : s["end"]].lower() for r in insult for s in r["offending"]]
    assert sum(bool(said(s)) for s in named) >= 0.9 * len(named) > 0


def test_rows_and_degenerate_labels(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0, "x"), (6, 1, "x"), (5, None, "x"), (None, 1, "x"), (99, 1, "x")], "doc_id long, toxic int, score string")
    model = fit(odd_docs, labels, "toxic", steps=3)
    rows = score(odd_docs, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[3] == by_id[4] == by_id[8]
    assert {r["score"] for r in score(odd_docs, fit(odd_docs, labels.limit(0), "toxic")).collect()} == {0.5}
    same = score(odd_docs, fit(odd_docs, labels.where("toxic = 1 and doc_id = 6"), "toxic"), keep=["doc_id"])
    assert {(r["score"], r["predicted"], len(r["offending"])) for r in same.collect()} == {(1.0, 1, 0)}
    assert score(odd_docs.limit(0), model).count() == 0 and score(odd_docs.limit(0), Model(np.zeros(0), 0.5)).count() == 0


def test_registered_query(spark):
    rows = QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.001")
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert rows.count() == table(spark, "/root/testdata/sf0.001", "documents").count()
