import numpy as np
import pytest

from kmerlake.llm.common import id_remainder, table
from kmerlake.llm.langid import DIMENSIONS, Judge, Space, bundle, gram_codes, identify, learn_prototypes


def test_grams():
    decode = lambda codes: ["".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)) for c in codes.tolist()]
    assert decode(gram_codes("Ab, c")) == [" ab", "ab ", "b c", " c "]
    assert len(gram_codes(None)) == len(gram_codes("12 !")) == 0


def test_dots_equal_bundles():
    """Summed dot products are the cosines of whole bundles up to the bundle's length."""
    space = Space(256, 7)
    texts = ["the cat and the dog", "der Hund und die Katze", "ça va très bien"]
    unit = []
    for t in texts:
        v = bundle(space, *np.unique(gram_codes(t), return_counts=True))
        unit.append(v / np.linalg.norm(v))
    cosines = Judge(Space(256, 7), np.array(unit)).cosines(["und die cat", None])
    v = bundle(space, *np.unique(gram_codes("und die cat"), return_counts=True))
    assert np.allclose(cosines[0], np.array(unit) @ v) and np.isnan(cosines[1]).all()


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("held", id_remainder(3) == 1)
    langs, prototypes = learn_prototypes(docs.where("not held"))
    assert np.allclose(np.linalg.norm(prototypes, axis=1), 1) and prototypes.shape == (len(langs), DIMENSIONS)
    rows = identify(docs.where("held"), langs, prototypes).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_rows(odd_docs):
    langs, prototypes = learn_prototypes(odd_docs)
    assert langs == ["de", "en"]  # fr has no letters, null is no language
    rows = {r["doc_id"]: r for r in identify(odd_docs, langs, prototypes).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 8))
    assert rows[6]["lang_pred"] == "de" and 0 <= rows[6]["score"] <= 1
    assert rows[1]["lang_pred"] == "en"


def test_nothing_to_learn(odd_docs):
    langs, prototypes = learn_prototypes(odd_docs.limit(0))
    assert langs == [] and {r["lang_pred"] for r in identify(odd_docs, langs, prototypes).collect()} == {"und"}
    langs, prototypes = learn_prototypes(odd_docs)
    assert identify(odd_docs.limit(0), langs, prototypes).count() == 0
