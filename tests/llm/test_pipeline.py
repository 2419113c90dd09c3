from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from check import connect, difference
from kmerlake.llm.common import stored, table
from kmerlake.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_registry():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_topk", "op6_url_filter", "op9_temperature_mixing"])
def test_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_stages(spark):
    docs = table(spark, SF, "documents")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(5)).withColumn("text", F.lit("a plain text with some words in it. It is short and clean."))
    docs, schema = docs.unionByName(extra), docs.schema
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF), "test")
        assert docs.columns == P.COLUMNS and [f.dataType for f in docs.schema] == [f.dataType for f in schema], name
        if name != "pii":
            assert docs.exceptAll(before.join(docs.select("text").distinct(), "text", "left_semi").select(*P.COLUMNS)).isEmpty() or name == "mixing"
        if name == "near_dedup":
            ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
            assert all(n == 1 for i, n in ids.items() if i is not None) and ids[None] == 1
            assert docs.select("text").distinct().count() >= docs.count() - 1
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and all(r["round_trip"] for r in last)
    empty = table(spark, SF, "documents").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_near_dedup_against_all_pairs(spark):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    marks = [fingerprint(r["text"], P.WIDTH) & (2**64 - 1) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= P.RADIUS:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r["doc_id"])
    assert any(len(g) > 1 for g in groups.values())
    assert sorted(r["doc_id"] for r in P.keep_one_of_each(spark, docs, SF).collect()) == sorted(min(g) for g in groups.values())


def test_clean_documents_stay(spark):
    docs = table(spark, SF, "documents")
    good = table(spark, SF, "labels").where("quality = 1").select("doc_id")
    kept = P.keep_good(spark, docs, SF)
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.95 * docs.join(good, "doc_id", "left_semi").count()
