"""Motif matrices as cells (motif_id, name, pos, a, c, g, t) and the tables around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kmerlake.functions.exact import ln_fisher_greater
from kmerlake.session import materialise
from kmerlake.sources.motif_text import LETTERS

# The background of the shipped motif file, and the IUPAC base sets.
BACKGROUND = {"a": 0.33, "c": 0.17, "g": 0.17, "t": 0.33}
IUPAC = {
    "A": "a", "C": "c", "G": "g", "T": "t", "R": "ag", "Y": "ct", "S": "cg", "W": "at", "K": "gt",
    "M": "ac", "B": "cgt", "D": "agt", "H": "act", "V": "acg", "N": "acgt",
}


def pwm_from_text(words: DataFrame) -> DataFrame:
    """Probability cells of IUPAC words (motif_id, word); ``#`` lines are skipped."""
    table = F.create_map(*[
        x for letter, bases in IUPAC.items()
        for x in (F.lit(letter), F.array(*[F.lit(1.0 / len(bases) if b in bases else 0.0) for b in LETTERS]))])
    kept = words.where(~F.col("word").startswith("#") & (F.trim("word") != ""))
    letters = kept.select(
        "motif_id", F.col("word").alias("name"), F.posexplode(F.split(F.upper(F.trim("word")), "")).alias("pos", "letter"))
    cells = letters.withColumn("p", F.element_at(table, F.col("letter"))).where("p is not null")
    return cells.select("motif_id", "name", "pos", *[F.col("p")[i].alias(x) for i, x in enumerate(LETTERS)])


def _map_letters(cells: DataFrame, value) -> DataFrame:
    others = [c for c in cells.columns if c not in LETTERS]
    return cells.select(*others, *[value(x).alias(x) for x in LETTERS])


def pwm_from_counts(cells: DataFrame, background: dict[str, float] = BACKGROUND, pseudo: float = 1.0) -> DataFrame:
    """Counts → log2 odds against the background, with a pseudocount shared out by the background."""
    total = sum((F.col(x) for x in LETTERS[1:]), F.col(LETTERS[0])) + pseudo
    return _map_letters(cells, lambda x: F.log2((F.col(x) + pseudo * background[x]) / total / background[x]))


def logodds_to_probs(cells: DataFrame, background: dict[str, float] = BACKGROUND) -> DataFrame:
    return _map_letters(cells, lambda x: F.pow(F.lit(2.0), F.col(x)) * background[x])


# Log-odds of a letter that a position never holds: no window with it reaches any limit.
NEVER = -10_000.0


def probs_to_logodds(cells: DataFrame, background: dict[str, float] = BACKGROUND) -> DataFrame:
    return _map_letters(cells, lambda x: F.when(F.col(x) > 0, F.log2(F.col(x) / background[x])).otherwise(NEVER))


def information(background: dict[str, float] = BACKGROUND) -> Column:
    """Σ p·log2(p/background) of one position; a zero probability adds nothing."""
    parts = [F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / background[x])).otherwise(0.0) for x in LETTERS]
    return parts[0] + parts[1] + parts[2] + parts[3]


def trim(cells: DataFrame, bits: float = 0.4, background: dict[str, float] = BACKGROUND) -> DataFrame:
    """Cut the flanks below ``bits``; positions count from 0 again. A group is one motif's width."""
    by = Window.partitionBy("motif_id")
    good = F.when(F.col("_bits") >= bits, F.col("pos"))
    marked = cells.withColumn("_bits", information(background)).withColumns(
        {"_from": F.min(good).over(by), "_to": F.max(good).over(by)})
    return marked.where("pos between _from and _to").withColumn("pos", F.col("pos") - F.col("_from")).drop(
        "_bits", "_from", "_to")


def without_information(cells: DataFrame, bits: float = 0.4, background: dict[str, float] = BACKGROUND) -> DataFrame:
    """Ids of the motifs that ``trim`` leaves out, as no position reaches ``bits``."""
    return cells.groupBy("motif_id").agg(F.max(information(background)).alias("_most")).where(F.col("_most") < bits).select("motif_id")


def core(cells: DataFrame, width: int, background: dict[str, float] = BACKGROUND) -> DataFrame:
    """The ``width`` adjacent positions of each motif that hold the most information (the first of equals).

    Positions count from 0 again; narrower motifs stay whole. A group is one motif's width.
    """
    by = Window.partitionBy("motif_id")
    bits = F.round(F.sum(information(background)).over(by.orderBy("pos").rowsBetween(0, width - 1)), 9)
    start = F.when(F.col("pos") <= F.max("pos").over(by) - width + 1, F.struct(bits.alias("bits"), (-F.col("pos")).alias("at")))
    first = cells.withColumn("_start", start).withColumn("_first", F.coalesce(-F.max("_start").over(by)["at"], F.lit(0)))
    kept = first.where((F.col("pos") >= F.col("_first")) & (F.col("pos") < F.col("_first") + width))
    return kept.withColumn("pos", F.col("pos") - F.col("_first")).drop("_start", "_first")


def pack(cells: DataFrame) -> DataFrame:
    """(motif_id, p): positions as an array of [a, c, g, t]; bounded by the motif's width."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.array(*LETTERS).alias("p"))))
    return cells.groupBy("motif_id").agg(rows["p"].alias("p"))


# -- distance tables -----------------------------------------------------------------------

def symmetric(distance: DataFrame) -> DataFrame:
    """Both directions of an upper triangle (i, j, d), from one reading of it."""
    turned = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    return distance.select(F.inline(F.array(F.struct("i", "j", "d"), turned)))


def assemble_matrix(blocks: list[DataFrame], fill: str = "-") -> DataFrame:
    """Blocks of one set as text cells (i, j, cell); the lower half holds the fill sign."""
    upper = blocks[0]
    for block in blocks[1:]:
        upper = upper.unionByName(block)
    shown = F.struct("i", "j", F.format_string("%.6f", "d").alias("cell"))
    filled = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(fill).alias("cell"))
    return upper.select(F.inline(F.array(shown, filled)))


def assemble_matrix_2(blocks: list[DataFrame]) -> DataFrame:
    """Rectangular blocks of two sets as one (i, j, d) table."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out.select("i", "j", "d")


def clean_distance(distance: DataFrame) -> DataFrame:
    """``nan`` counts as distance 1."""
    return distance.withColumn("d", F.nanvl("d", F.lit(1.0)))


def check_matrix(cells: DataFrame) -> DataFrame:
    """Violations of a text matrix (i, j, cell): cells not led by 0, 1 or ``-``, and rows of odd length."""
    cell = F.when(F.lower("cell") == "nan", "1").otherwise(F.col("cell"))
    bad = cells.withColumn("cell", cell).where(~F.col("cell").rlike("^[01-]")).select(
        F.lit("cell").alias("problem"), "i", "j")
    widths = materialise(cells.groupBy("i").agg(F.count("*").alias("n")))  # a row for each row, used twice
    usual = widths.groupBy("n").agg(F.count("*").alias("rows")).agg(F.max_by("n", F.struct("rows", "n")).alias("usual"))
    odd = widths.join(F.broadcast(usual)).where("n <> usual").select(
        F.lit("row").alias("problem"), "i", F.lit(None).cast("long").alias("j"))
    return bad.unionByName(odd)


def family_average(distance: DataFrame, families: DataFrame) -> DataFrame:
    """(i, family, d): mean distance of each row to the columns of a family; ``families``: (j, family)."""
    return distance.join(families, "j").groupBy("i", "family").agg(F.avg("d").alias("d"))


def best_family(averages: DataFrame) -> DataFrame:
    return averages.groupBy("i").agg(
        F.min_by("family", F.struct("d", "family")).alias("family"), F.min("d").alias("d"))


def attach_names(matrix: DataFrame, names: DataFrame) -> DataFrame:
    """Names given by row position; both sides carry ``pos``."""
    return matrix.join(names.select("pos", "name"), "pos", "left")


def significant_matches(distance: DataFrame, cutoff: float = 0.39) -> DataFrame:
    return distance.select("i", "j", F.when(F.col("d") <= cutoff, 1).otherwise(0).alias("significant"))


# -- clusters and the choice of a motif per cluster ----------------------------------------

def split_singletons(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(singletons, members of larger clusters) of (motif_id, cluster)."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    sized = clusters.join(sizes, "cluster").select("motif_id", "cluster", "size")
    return sized.where("size = 1"), sized.where("size > 1")


def group_specificity(motif_genes: DataFrame, genes: DataFrame) -> DataFrame:
    """(motif_id, hits, overlap, ln_p, pvalue): are targets (class 1) over-represented among hit genes.

    ``motif_genes``: (motif_id, gene); hypergeometric upper tail over all ``genes`` (gene, class).
    """
    sizes = genes.agg(
        F.count_if(F.col("class") == 1).alias("n_pos"), F.count_if(F.col("class") == 0).alias("n_neg"))
    counts = motif_genes.select("motif_id", "gene").distinct().join(genes, "gene").groupBy("motif_id").agg(
        F.count_if(F.col("class") == 1).alias("overlap"), F.count_if(F.col("class") == 0).alias("others"))
    p = ln_fisher_greater(F.col("overlap"), F.col("n_pos"), F.col("others"), F.col("n_neg"))
    return counts.join(F.broadcast(sizes)).select(
        "motif_id", (F.col("overlap") + F.col("others")).alias("hits"), "overlap", p.alias("ln_p")).withColumn("pvalue", F.exp("ln_p"))


def top_motif(scores: DataFrame, at_least: float = 2.0) -> DataFrame:
    """Per cluster the motif with the greatest −log10 p, if that reaches ``at_least``."""
    rated = scores.withColumn("strength", F.col("ln_p") / -math.log(10))
    return rated.groupBy("cluster").agg(
        F.max_by("motif_id", F.struct(F.round("strength", 9), -F.col("motif_id"))).alias("motif_id"),
        F.max("strength").alias("strength"),
    ).where(F.col("strength") >= at_least)


def missing_clusters(expected: DataFrame, done: DataFrame) -> DataFrame:
    return expected.select("cluster").distinct().join(done.select("cluster"), "cluster", "left_anti")
