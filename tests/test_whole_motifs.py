"""Specificity of whole motifs against brute force on a small fixture of the given tables."""

from math import comb

import pytest

import __spark_entry__ as entry
from querybook import fixtures as X
from querybook import motifs as M

SF = "/root/testdata/sf0.001"


def test_specificity_of_whole_motifs(spark, monkeypatch):
    monkeypatch.setattr(M, "FRACTION", 0.7)  # with sites on the smallest tables
    few = M.logodds(spark, SF).where("motif_id < 4")
    monkeypatch.setattr(M, "logodds", lambda *_: few)
    genes = {r["gene"]: r["class"] for r in M.targets(spark, SF).collect()}
    seqs = {r["gene"]: r["seq"] for r in X.sequences(spark, SF).collect()}
    odds, hits = {}, {}
    for r in few.orderBy("motif_id", "pos").collect():
        odds.setdefault(r["motif_id"], []).append({x: r[x.lower()] for x in "ACGT"})
    for m, rows in odds.items():
        least, width = M.FRACTION * sum(max(r.values()) for r in rows) - 1e-9, len(rows)
        turned = [{x: r[y] for x, y in zip("ACGT", "TGCA")} for r in reversed(rows)]
        hits[m] = {g for g, s in seqs.items() if any(
            sum(r.get(x, -1e9) for r, x in zip(way, s[i : i + width])) >= least for way in (rows, turned) for i in range(len(s) - width + 1))}
    got = {r["motif_id"]: r for r in entry.queries()["w15_group_specificity"](spark, SF).collect()}
    n, pos = len(genes), sum(genes.values())
    assert {m for m in hits if hits[m]} == set(got) and all(len(rows) == X.WIDTH for rows in odds.values())
    for m, r in got.items():
        k, both = len(hits[m]), sum(genes[g] for g in hits[m])
        p = sum(comb(pos, x) * comb(n - pos, k - x) for x in range(both, min(pos, k) + 1)) / comb(n, k)
        assert (r["hits"], r["overlap"]) == (k, both) and r["pvalue"] == pytest.approx(p, abs=2e-6)
