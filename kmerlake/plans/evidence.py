"""The criteria table: one row per k-mer with all evidence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.operators import criteria as C
from kmerlake.operators.enrichment import class_counts, class_sizes, fisher_greater
from kmerlake.session import materialise


def criteria_table(
    presence: DataFrame, genes: DataFrame, hits: DataFrame, features: Mapping[str, Column | DataFrame],
    diversity: Column | DataFrame | None = None, importance: dict[str, DataFrame] | None = None, selected: DataFrame | None = None,
    known: list[DataFrame] | None = None,
) -> DataFrame:
    """Enrichment, importances, copy number, overlap with each feature, diversity and motifs, joined by k-mer.

    ``features`` maps a prefix to a condition over ``hits`` (true where a hit overlaps the feature) or to a hit table of its own
    with ``details``; histone marks are features named ``<mark>_A`` or ``<mark>_R``. ``diversity`` is an expression over ``hits`` or a
    table. All expressions come from the one pass over the hits that counts copies; tables of their own are read together in one more.
    ``importance`` maps a column to (feature, importance), ``selected`` holds the selected words for ``fs_overlap``, and ``known``
    the outputs of ``best_match`` and ``best_match_dap``. The counts and the evidence, one row per k-mer and used several times, are
    written to the shared folder once.
    """
    counts = materialise(class_counts(presence))
    base = counts.select(F.col("token").alias("kmer"))
    table = C.attach_enrichment(base, fisher_greater(counts, class_sizes(genes)))
    for name, scores in (importance or {}).items():
        table = C.attach_importance(table, scores, name)
    if selected is not None:
        forward = base.select("kmer", F.element_at(F.split("kmer", r"\."), 1).alias("word"))
        inside = C.fs_overlap(forward.select(F.col("word").alias("kmer")).distinct(), selected).withColumnRenamed("kmer", "word")
        table = C.attach(table, forward.join(inside, "word").select("kmer", "fs_overlap"))
    for best in known or []:
        table = C.attach(table, best)
    flags = {name: flag for name, flag in features.items() if isinstance(flag, Column)}
    own = {name: rows for name, rows in features.items() if name not in flags}
    at_hits = isinstance(diversity, Column)
    evidence = materialise(C.gene_evidence(hits, base, genes, flags, diversity if at_hits else None))
    copies = C.copy_columns(evidence)
    table = C.attach(table, copies)
    if flags:
        table = C.attach(table, C.mark_columns(evidence, list(flags)))
    if own:
        tagged = None
        for name, rows in own.items():
            part = rows.select("gene", "kmer", "details", F.lit(name).alias("mark"))
            tagged = part if tagged is None else tagged.unionByName(part)
        table = C.attach(table, C.feature_enrichment(copies.where("hits_pos is not null"), tagged, list(own), base, genes))
    if diversity is not None:
        found = C.diversity_columns(evidence, "div_") if at_hits else C.diversity_evidence(diversity, base, genes)
        table = C.attach(table, found)
    return table
