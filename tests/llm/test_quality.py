import math


from kmerlake.llm.common import id_remainder, table
from kmerlake.llm.quality import Rule, RuleModel, fit_rules, score, statistics

SF = "/root/testdata/sf0.01"


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "Ab 1! é|\nAb"), (2, None), (3, "")], "doc_id long, text string")
    full, names = statistics(docs, "text")
    rows = {r["doc_id"]: r for r in full.collect()}
    one = rows[1]
    assert one["_f_upper"] == 2 / 11 and one["_f_digits"] == 1 / 11 and one["_f_accents"] == 1 / 11 and one["_f_bars"] == 1 / 11
    assert one["_f_words"] == math.log1p(4) and one["_f_distinct_words"] == 3 / 4 and one["_f_line_words"] == math.log1p(2)
    assert all(rows[k][n] is not None for k in rows for n in names)


def test_compiled_rules_equal_evaluation(spark):
    docs = table(spark, SF, "documents")
    model = fit_rules(docs, table(spark, SF, "labels"), "quality")
    assert 0 < len(model.weighted) < 200
    full, names = statistics(docs, "text")
    want = {}
    for r in full.collect():
        total = model.intercept
        for rule, w in model.weighted:
            total += w * all((r[n] <= t) == low for n, low, t in rule.tests)
        want[r["doc_id"]] = 1 / (1 + math.exp(-total))
    for r in score(docs, model).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)


def test_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = id_remainder(5) == 0
    model = fit_rules(docs.where(~held), labels, "quality", fit_rows=5000)
    rows = score(docs.where(held), model).join(labels, "doc_id").select("quality", "predicted").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_rows_and_degenerate_labels(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, "x"), (6, 1, "x"), (5, None, "x")], "doc_id long, quality int, score string")
    model = fit_rules(odd_docs, labels, "quality")
    rows = score(odd_docs, model).collect()
    assert len(rows) == 10 and all(r["score"] > 0.99 and r["predicted"] == 1 for r in rows)
    none = fit_rules(odd_docs, labels.limit(0), "quality")
    assert {r["score"] for r in score(odd_docs, none).collect()} == {0.5}
    assert score(odd_docs.limit(0), none).count() == 0
    ruled = RuleModel(-1.0, ((Rule((("_f_words", True, 0.0),)), 3.0),))
    got = {r["doc_id"]: r["score"] for r in score(odd_docs, ruled).collect()}
    assert abs(got[3] - 1 / (1 + math.exp(-2))) < 1e-12 and got[3] == got[4] == got[8] and got[1] < 0.3
