"""Registered queries against their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check import connect, difference

SF = "/root/testdata/sf0.001"
QUICK = [
    "s1_read_fasta", "s9_write_transfac", "k3_canonical_kmers", "p2_presence_stranded", "p4_presence_pair_stranded_literal",
    "e4_fisher_two_sided", "e6_bh_adjust_families", "e13_pr_points", "g2_grow_level", "c7_welch_copy_number",
    "c8_overlap_enrichment_early", "f1_chi2_select", "m2_kfold", "w9_family_average"]


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    without = {q for q in queries if q not in oracles and not q.startswith("op") and q != "pipeline"}
    assert all(q.split("_")[0] in {"f2", "m4", "m5", "m6", "m7", "m8", "m10", "m11", "w13", "w17", "w18"} for q in without)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got)
    assert difference(got, connect(SF).execute(entry.oracle_sql()[name]).df()) is None
