"""k-mers joined to genomic evidence: copy number, annotation overlap, diversity, known motifs.

``kmers`` is a (kmer) table, ``genes`` a (gene, class) table and ``hits`` has at least
(gene, kmer). Joins are left to the optimiser, which broadcasts a side by its measured size.
Hits are counted by k-mer and gene, map-side first, before they meet the genes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.functions.exact import ln_fisher_two_sided, odds_ratio
from kmerlake.functions.welch import t_two_tailed, welch
from kmerlake.functions.words import windows
from kmerlake.session import written


def criteria_base(presence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The k-mers of a presence table and its genes with class."""
    return presence.select(F.col("token").alias("kmer")).distinct(), presence.select("gene", "class").distinct()


def attach(base: DataFrame, other: DataFrame, key: str = "kmer") -> DataFrame:
    return base.join(other, key, "left")


def attach_enrichment(base: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Add percent_positives, pvalue and ln_p."""
    facts = enrichment.select(
        F.col("token").alias("kmer"), (100.0 * F.col("pos_count") / F.col("n_pos")).alias("percent_positives"), "pvalue", "ln_p")
    return attach(base, facts)


def attach_importance(base: DataFrame, importance: DataFrame, name: str) -> DataFrame:
    return attach(base, importance.select(F.col("feature").alias("kmer"), F.col("importance").alias(name)))


def semi_filter(hits: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    """Hits of the listed k-mers in the listed genes, with the class of the gene."""
    return hits.join(kmers.select("kmer"), "kmer", "left_semi").join(genes.select("gene", "class"), "gene")


def _is(label: int) -> Column:
    return F.col("class") == label


SIDES = (("pos", 1), ("neg", 0))


def _moment_columns(value: str) -> list[Column]:
    """Mean, sample variance, size and sum of ``value`` per class."""
    def pick(label: int) -> Column:
        return F.when(_is(label) & ~F.isnan(value), F.col(value))

    return [
        fn(pick(label)).alias(f"{name}_{side}") for side, label in SIDES
        for name, fn in (("mean", F.avg), ("var", F.var_samp), ("n", F.count), ("sum", F.sum))]


def _moments(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("kmer").agg(*_moment_columns(value))


def _gene_moments(value: str) -> list[Column]:
    """Size, sum, squared deviations and range of ``value`` for a k-mer and gene; NaN is left out."""
    v = F.when(~F.isnan(value), F.col(value))
    return [
        F.count(v).alias("_n"), F.sum(v).alias("_s"), (F.var_pop(v) * F.count(v)).alias("_m2"), F.min(v).alias("_lo"), F.max(v).alias("_hi")]


def _class_moments(prefix: str = "") -> list[Column]:
    """The moments of the values themselves, per class, from ``_gene_moments``; values that are all equal have variance 0 exactly."""
    out = []
    for side, label in SIDES:
        pick = lambda c, label=label: F.when(_is(label), c)
        n, s = F.coalesce(F.sum(pick(F.col("_n"))), F.lit(0)), F.sum(pick(F.col("_s")))
        squares = F.sum(pick(F.col("_m2") + F.col("_s") * F.col("_s") / F.nullif(F.col("_n"), F.lit(0))))
        equal = F.min(pick(F.col("_lo"))) == F.max(pick(F.col("_hi")))
        var = F.when(n > 1, F.when(equal, 0.0).otherwise(F.greatest(squares - s * s / n, F.lit(0.0)) / (n - 1)))
        mean = s / F.nullif(n, F.lit(0))
        out += [c.alias(f"{prefix}{name}_{side}") for name, c in (("mean", mean), ("var", var), ("n", n), ("sum", s))]
    return out


def _with_welch(moments: DataFrame, prefix: str = "") -> DataFrame:
    c = lambda name: F.col(prefix + name)
    parts = welch(c("mean_pos"), c("var_pos"), c("n_pos"), c("mean_neg"), c("var_neg"), c("n_neg"))
    return moments.withColumns(parts).withColumn("pvalue", t_two_tailed(F.col("t"), F.col("df")))


def _welch_columns(moments: DataFrame) -> DataFrame:
    return _with_welch(moments).select("kmer", "t", "pvalue")


def _per_gene(hits: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    counted = hits.join(kmers.select("kmer"), "kmer", "left_semi").groupBy("kmer", "gene").agg(
        F.count("*").cast("double").alias("copies"))
    return counted.join(genes.select("gene", "class"), "gene")


def copy_number(hits: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    """Mean copies over genes with a hit, and total hits, per class.

    k-mers without a hit in a positive gene are left out.
    """
    total = lambda label: F.sum(F.when(_is(label), F.col("copies"))).cast("long")
    mean = lambda label: F.avg(F.when(_is(label), F.col("copies")))
    return _per_gene(hits, kmers, genes).groupBy("kmer").agg(
        mean(1).alias("copy_pos"), mean(0).alias("copy_neg"),
        total(1).alias("hits_pos"), total(0).alias("hits_neg")).where("hits_pos is not null")


def copy_number_welch(hits: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    """Welch test of copies per gene, positives against negatives."""
    return _welch_columns(_moments(_per_gene(hits, kmers, genes), "copies"))


def copy_evidence(hits: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    """``copy_number`` and its Welch test (copy_t, copy_pval) in one pass over the hits.

    Counts are null for a k-mer without a hit in a positive gene.
    """
    return copy_columns(_moments(_per_gene(hits, kmers, genes), "copies"))


def copy_columns(moments: DataFrame) -> DataFrame:
    """The columns of ``copy_evidence`` from the moments of copies per gene."""
    rows = _with_welch(moments)
    shown = lambda c: F.when(F.col("n_pos") > 0, c)
    return rows.select(
        "kmer", shown(F.col("mean_pos")).alias("copy_pos"), shown(F.col("mean_neg")).alias("copy_neg"),
        shown(F.col("sum_pos").cast("long")).alias("hits_pos"), shown(F.col("sum_neg").cast("long")).alias("hits_neg"),
        F.col("t").alias("copy_t"), F.col("pvalue").alias("copy_pval"))


def overlapping(feature_hits: DataFrame) -> DataFrame:
    return feature_hits.where(~F.col("details").contains("overlap=NA"))


def _two_by_two(df: DataFrame, fill: str) -> DataFrame:
    """From t1, t3 and the totals: odds ratio and two-sided p-value.

    ``fill='late'`` subtracts before filling, so a k-mer without overlapping hits has t1 = t2 = 0;
    ``fill='early'`` fills first and gives t2 = total.
    """
    zero = lambda x: F.coalesce(x, F.lit(0))
    t1, t3 = (zero(F.col(c)) if fill == "early" else F.col(c) for c in ("t1", "t3"))
    counts = df.select(
        "*", zero(F.col("hits_pos") - t1).alias("t2"), zero(F.col("hits_neg") - t3).alias("t4")).withColumns(
        {"t1": zero(F.col("t1")), "t3": zero(F.col("t3"))})
    cells = [F.col("t1"), F.col("t1") + F.col("t2"), F.col("t3"), F.col("t3") + F.col("t4")]
    return counts.withColumn("odds", odds_ratio(*cells)).withColumn("ln_p", ln_fisher_two_sided(*cells)).withColumn(
        "pvalue", F.exp("ln_p"))


def _overlap_counts(feature_hits: DataFrame, kmers: DataFrame, genes: DataFrame, *by: str) -> DataFrame:
    """Hits are counted by k-mer and gene first; only the counts meet the genes."""
    counted = overlapping(feature_hits).groupBy(*by, "kmer", "gene").agg(F.count("*").alias("_hits"))
    rows = semi_filter(counted, kmers, genes)
    count = lambda label: F.sum(F.when(_is(label), F.col("_hits")))
    return rows.groupBy(*by, "kmer").agg(count(1).alias("t1"), count(0).alias("t3"))


def overlap_enrichment(
    totals: DataFrame, feature_hits: DataFrame, kmers: DataFrame, genes: DataFrame, fill: str = "late"
) -> DataFrame:
    """(kmer, t1, t2, t3, t4, odds, pvalue, ln_p) of hits that overlap a feature, positives against negatives.

    ``totals`` is the output of ``copy_number``.
    """
    counts = _overlap_counts(feature_hits, kmers, genes)
    rows = totals.select("kmer", "hits_pos", "hits_neg").join(counts, "kmer", "left")
    return _two_by_two(rows, fill).select("kmer", "t1", "t2", "t3", "t4", "odds", "pvalue", "ln_p")


def overlap_by_mark(
    totals: DataFrame, tagged_hits: DataFrame, marks: list[str], kmers: DataFrame, genes: DataFrame, fill: str = "late"
) -> DataFrame:
    """``overlap_enrichment`` for all marks at once, in long form (mark, kmer, odds, pvalue, ln_p)."""
    counts = _overlap_counts(tagged_hits, kmers, genes, "mark")
    grid = totals.select("kmer", "hits_pos", "hits_neg", F.explode(F.array(*map(F.lit, marks))).alias("mark"))
    return _two_by_two(grid.join(counts, ["mark", "kmer"], "left"), fill).select("mark", "kmer", "odds", "pvalue", "ln_p")


def feature_enrichment(
    totals: DataFrame, tagged_hits: DataFrame, marks: list[str], kmers: DataFrame, genes: DataFrame,
    odds: str = "odds", pval: str = "pval", ln_p: str = "ln_p",
) -> DataFrame:
    """One row per k-mer with ``<mark>_odds``, ``<mark>_pval`` and ``<mark>_ln_p`` for each mark."""
    return _wide(overlap_by_mark(totals, tagged_hits, marks, kmers, genes), marks, odds, pval, ln_p)


def _wide(long: DataFrame, marks: list[str], odds: str, pval: str, ln_p: str) -> DataFrame:
    return long.groupBy("kmer").pivot("mark", marks).agg(
        F.first("odds").alias(odds), F.first("pvalue").alias(pval), F.first("ln_p").alias(ln_p))


def histone_enrichment(
    totals: DataFrame, tagged_hits: DataFrame, marks: list[str], kmers: DataFrame, genes: DataFrame
) -> DataFrame:
    """Columns ``<mark>_<A/R>_Odds`` and ``_pval``; marks are tagged by ``read_manifest_hits``."""
    return feature_enrichment(totals, tagged_hits, marks, kmers, genes, "Odds", "pval")


def _diversity_by_gene(diversity: DataFrame, kmers: DataFrame, genes: DataFrame, *facts: Column) -> DataFrame:
    """Diversity is added up by k-mer and gene before it meets the genes.

    Rows are opened from a struct, so that their keys are made once: Spark tests the keys of the joins below a plain select, and would
    parse every region again for each test.
    """
    rows = diversity.select(F.inline(F.array(F.struct("kmer", "gene", "nt_div"))))
    return semi_filter(rows.groupBy("kmer", "gene").agg(*facts), kmers, genes)


def diversity_means(diversity: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    rows = _diversity_by_gene(diversity, kmers, genes, F.sum("nt_div").alias("_s"), F.count("nt_div").alias("_n"))
    part = lambda c, label: F.sum(F.when(_is(label), F.col(c)))
    mean = lambda label: part("_s", label) / F.nullif(part("_n", label), F.lit(0))
    return rows.groupBy("kmer").agg(mean(1).alias("div_pos"), mean(0).alias("div_neg"))


def _diversity_moments(diversity: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    rows = _diversity_by_gene(diversity, kmers, genes, *_gene_moments("nt_div"))
    return rows.groupBy("kmer").agg(*_class_moments())


def diversity_welch(diversity: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    return _welch_columns(_diversity_moments(diversity, kmers, genes))


def diversity_evidence(diversity: DataFrame, kmers: DataFrame, genes: DataFrame) -> DataFrame:
    """Class means and Welch test of the diversity in one pass."""
    return diversity_columns(_diversity_moments(diversity, kmers, genes))


def diversity_columns(moments: DataFrame, prefix: str = "") -> DataFrame:
    """The columns of ``diversity_evidence`` from the moments of the diversity."""
    return _with_welch(moments, prefix).select(
        "kmer", F.col(f"{prefix}mean_pos").alias("div_pos"), F.col(f"{prefix}mean_neg").alias("div_neg"),
        F.col("t").alias("div_t"), F.col("pvalue").alias("div_pval"))


def gene_evidence(
    hits: DataFrame, kmers: DataFrame, genes: DataFrame, flags: dict[str, Column], diversity: Column | None = None
) -> DataFrame:
    """One row per k-mer with all that the hits tell, from one pass over them.

    ``flags`` says for each feature or mark whether a hit overlaps it, ``diversity`` gives the diversity at a hit; both are
    expressions over ``hits``. Hits are added up by k-mer and gene, and the sums meet the genes once. Read the result with
    ``copy_columns``, ``mark_columns`` and ``diversity_columns`` (prefix ``div_``).
    """
    shown = [flag.alias(f"_f{i}") for i, flag in enumerate(flags.values())]
    facts = [F.count("*").cast("double").alias("copies"), *[F.count_if(F.col(f"_f{i}")).alias(f"_f{i}") for i in range(len(flags))]]
    if diversity is not None:
        shown.append(diversity.alias("_div"))
        facts += _gene_moments("_div")
    rows = hits.join(kmers.select("kmer"), "kmer", "left_semi").select("kmer", "gene", *shown)
    joined = rows.groupBy("kmer", "gene").agg(*facts).join(genes.select("gene", "class"), "gene")
    # A k-mer without an overlapping hit has no count, as where only overlapping hits are read.
    overlaps = [
        F.nullif(F.sum(F.when(_is(label), F.col(f"_f{i}"))), F.lit(0)).alias(f"{cell}_{i}")
        for i in range(len(flags)) for cell, label in (("t1", 1), ("t3", 0))]
    return joined.groupBy("kmer").agg(*_moment_columns("copies"), *overlaps, *(_class_moments("div_") if diversity is not None else []))


def mark_columns(
    evidence: DataFrame, marks: list[str], fill: str = "late", odds: str = "odds", pval: str = "pval", ln_p: str = "ln_p"
) -> DataFrame:
    """``feature_enrichment`` from ``gene_evidence``; ``marks`` are its flags in order."""
    cells = [F.struct(F.lit(mark).alias("mark"), F.col(f"t1_{i}").alias("t1"), F.col(f"t3_{i}").alias("t3")) for i, mark in enumerate(marks)]
    hits = [F.col(f"sum_{side}").cast("long").alias(f"hits_{side}") for side, _ in SIDES]
    long = evidence.where("n_pos > 0").select("kmer", *hits, F.explode(F.array(*cells)).alias("x")).select("kmer", "hits_pos", "hits_neg", "x.*")
    return _wide(_two_by_two(long, fill), marks, odds, pval, ln_p)


def fs_overlap(kmers: DataFrame, selected: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """1 when any selected word is contained in the k-mer. Lengths are read from the words unless stated.

    Containment is an equi-join on the windows of the k-mer, not a comparison of all pairs.
    """
    if lengths is None:
        lengths = sorted(r[0] for r in selected.select(F.length("token")).distinct().collect()) or [1]  # one row for each length
    inside = F.array_distinct(F.concat(*[windows(F.col("kmer"), k) for k in lengths]))
    matched = kmers.select("kmer", F.explode(inside).alias("token")).join(
        selected.select("token"), "token", "left_semi").select("kmer").distinct()
    return kmers.select("kmer").join(matched.withColumn("fs_overlap", F.lit(1)), "kmer", "left").select(
        "kmer", F.coalesce("fs_overlap", F.lit(0)).alias("fs_overlap"))


def best_match(distance: DataFrame, name: str = "TFBM", value: str = "TFBM_PCCD") -> DataFrame:
    """Nearest known motif per k-mer; the first column wins ties. ``distance``: (kmer, motif, pos, d)."""
    return distance.groupBy("kmer").agg(
        F.min_by("motif", F.struct("d", "pos")).alias(name), F.min("d").alias(value))


def best_match_dap(distance: DataFrame) -> DataFrame:
    return best_match(distance, "DAPSeq_TFBM", "DAPSeq_TFBM_PCCD")


def label_sites(matrix: DataFrame, positives: DataFrame, negatives: DataFrame, key: str = "gene") -> DataFrame:
    """Rows of a gene × site matrix for two gene lists with ``Class``; a gene in both appears twice."""
    part = lambda genes, label: matrix.join(genes.select(key), key, "left_semi").withColumn("Class", F.lit(label))
    return part(positives, 1).unionByName(part(negatives, 0))


def map_loci(pos_map: DataFrame, neg_map: DataFrame, kmers: DataFrame) -> DataFrame:
    """(kmer, class, locus) of the wanted k-mers; a locus is ``gene:start:stop:strand``.

    The maps come from ``read_block_map`` with the tag of the class.
    """
    both = pos_map.withColumn("class", F.lit(1)).unionByName(neg_map.withColumn("class", F.lit(0)))
    wanted = written(kmers.select("kmer"), "wanted")  # written, so that its size is known and the loci are not shuffled for it
    return both.join(wanted, "kmer", "left_semi").select("kmer", "class", "locus")
