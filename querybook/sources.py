"""Text sources and sinks (row S of the survey): write with the engine, read back, compare.

Each query writes a text form of whole driver tables to a fresh folder below the shared
folder and reads it with the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.operators import criteria as C
from kmerlake.operators import motifs as W
from kmerlake.operators import presence as P
from kmerlake.operators import universe as U
from kmerlake.session import scratch_path
from kmerlake.sources import motif_text as T
from kmerlake.sources import sinks as O
from kmerlake.sources import text as S
from querybook import fixtures as X
from querybook.evidence import HITS, K, hit_table, kmers
from querybook.select import _IMP, importance

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def wrapped(df):
    """Sequences broken into lines of 60 letters."""
    return df.withColumn("seq", F.regexp_replace("seq", "(.{60})", "$1\n"))


@query("s1_read_fasta", f"WITH {X.SEQ} SELECT CAST(gene AS VARCHAR) AS gene, class, length(seq) AS n, md5(seq) AS seq_md5 FROM sequences")
def s1(spark, sf):
    seqs, root = X.sequences(spark, sf), scratch_path(spark, "fasta")
    header = F.concat(F.col("gene").cast("string"), F.lit(" from >"), F.col("class").cast("string")).alias("gene")
    parts = []
    for label in (1, 0):
        O.write_fasta(wrapped(seqs.where(F.col("class") == label)).select(header, "seq"), f"{root}/{label}")
        parts.append(S.read_fasta(spark, f"{root}/{label}", label, keep="last"))
    return S.sequence_set(*parts).select(
        "gene", "class", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("seq_md5"))


@query("s2_read_token_list", f"WITH {X.SEQ}, {X.stranded_sql(4)} SELECT DISTINCT token FROM stranded")
def s2(spark, sf):
    path = scratch_path(spark, "tokens")
    held = P.presence_stranded(X.sequences(spark, sf), U.canonical_words(spark, 4), [4])
    held.select("token").distinct().select(F.concat(F.col("token"), F.lit(" \n"))).write.text(path)
    return S.read_token_list(spark, path)


def _wide(spark, sf):
    seqs = X.sequences(spark, sf)
    held = P.presence_stranded(seqs, U.canonical_words(spark, 3), [3])
    tokens = [r["token"] for r in U.canonical_words(spark, 3).orderBy("idx").collect()]
    return O.wide_matrix(held, X.genes(spark, sf), tokens)


_LONG3 = f"WITH {X.SEQ}, {X.stranded_sql(3)} "


@query("s3_read_matrix", _LONG3 + 'SELECT CAST(gene AS VARCHAR) AS gene, CAST(class AS VARCHAR) AS "Class", token, 1.0::DOUBLE AS value FROM stranded')
def s3(spark, sf):
    path = scratch_path(spark, "matrix")
    O.write_table(_wide(spark, sf), path)
    return S.matrix_to_long(S.read_matrix(spark, path))


def _hit_file(spark, sf):
    rows = X.annotate(hit_table(spark, sf), 5)
    return rows.select(F.lit("chr1").alias("chr"), "gene", "kmer", "start", "end", F.lit(".").alias("x"), "dir", F.lit(".").alias("y"), "details")


@query("s4_read_hits", f"""{HITS} SELECT kmer, CASE WHEN (start + gene) % 5 = 0 THEN 'overlap=peak' ELSE 'overlap=NA' END AS details,
count(*) AS n, count(DISTINCT gene) AS n_genes FROM hits GROUP BY 1, 2""")
def s4(spark, sf):
    path = scratch_path(spark, "hits")
    O.write_table(_hit_file(spark, sf), path, header=False, packed=True)
    return S.read_hits(spark, path).groupBy("kmer", "details").agg(
        F.count("*").alias("n"), F.countDistinct("gene").alias("n_genes"))


def _block_files(spark, sf, label, root=None, name=None):
    """A head line led by a number, then the locus, led by a letter."""
    folder = f"{root}/{name}" if root else scratch_path(spark, f"blocks{label}")
    # The text meets the genes of the class before it is opened: its hits are many times as large.
    seqs = X.sequences(spark, sf).drop("class").join(X.genes(spark, sf).where(F.col("class") == label), "gene")
    rows = X.hits(spark, sf, K, seqs)
    locus = F.concat_ws("\t", F.concat(F.lit("g"), F.col("gene").cast("string")), "start", "end", "dir", F.lit("x"))
    rows.select(F.concat(F.lit("1\t"), F.col("kmer"), F.lit("\n"), locus)).write.options(**O.PACKED).text(folder)
    return folder


@query("s5_read_block_map", f"""{HITS} SELECT class, kmer, count(*) AS n, min('g' || gene || ':' || start || ':' || stop || ':' || dir) AS first_locus,
  max('g' || gene || ':' || start || ':' || stop || ':' || dir) AS last_locus FROM hits GROUP BY 1, 2""")
def s5(spark, sf):
    root = scratch_path(spark, "blocks")
    for label, name in ((1, "pos_0.9max.out.pvalue"), (0, "neg_0.9max.out.pvalue"), (1, "pos_other")):
        _block_files(spark, sf, label, root, name)
    parts = [S.read_block_map(spark, f"{root}/*", tag).withColumn("class", F.lit(label)) for tag, label in (("pos", 1), ("neg", 0))]
    return S.text_range(parts[0].unionByName(parts[1]), ["class", "kmer"], "locus")


@query("c20_map_loci", f"""{HITS} SELECT kmer, class, 'g' || gene || ':' || start || ':' || stop || ':' || dir AS locus FROM hits
WHERE kmer IN (SELECT kmer FROM totals WHERE hits_pos * 7 >= hits_neg)""")
def c20(spark, sf):
    pos, neg = (S.read_block_map(spark, _block_files(spark, sf, label)) for label in (1, 0))
    totals = C.copy_number(hit_table(spark, sf), kmers(spark), X.genes(spark, sf))
    return C.map_loci(pos, neg, totals.where("hits_pos * 7 >= hits_neg").select("kmer"))


@query("s6_read_diversity", f"""{HITS} SELECT kmer, count(*) AS n, sum(start)::BIGINT AS sum_start, sum(gene)::BIGINT AS sum_gene,
  round(avg(CASE WHEN start % 7 = 0 THEN 0.0::DOUBLE ELSE ((start * 31 + gene) % 100) / 997.0::DOUBLE END), 6) AS nt_div FROM hits GROUP BY 1""")
def s6(spark, sf):
    path = scratch_path(spark, "diversity")
    O.write_table(X.diversity_text(hit_table(spark, sf)), path, packed=True)
    return S.read_diversity(spark, path).groupBy("kmer").agg(
        F.count("*").alias("n"), F.sum("start").alias("sum_start"), F.sum(F.col("gene").cast("long")).alias("sum_gene"),
        X.r6(F.avg("nt_div")).alias("nt_div"))


_LOG = f"""WITH {X.PROBS}, cells AS (SELECT motif_id, name, pos, log2(a / 0.33) AS a, log2(c / 0.17) AS c, log2(g / 0.17) AS g, log2(t / 0.33) AS t FROM probs)"""


def logodds(spark, sf):
    return W.probs_to_logodds(X.motif_probs(spark, sf))


@query("s7_read_motifs", f"{_LOG} SELECT motif_id, name, pos, round(a, 3) AS a, round(c, 3) AS c, round(g, 3) AS g, round(t, 3) AS t FROM cells")
def s7(spark, sf):
    path = scratch_path(spark, "motifs")
    T.write_motifs(logodds(spark, sf), path)
    return T.read_motifs(spark, path)


def _floor(x: str) -> str:
    return f"floor(power(2.0::DOUBLE, {x}) * 100)"


@query("s8_read_transfac", f"{_LOG} SELECT name, pos, {', '.join(f'{_floor(x)} AS {x}' for x in 'acgt')} FROM cells")
def s8(spark, sf):
    path = scratch_path(spark, "transfac")
    T.write_transfac(logodds(spark, sf), path)
    return T.read_transfac(spark, path)


_NAMED = "CASE WHEN motif_id % 2 = 0 THEN 'src_' || (motif_id + 1) ELSE name END"


@query("s9_write_transfac", f"""{_LOG} SELECT motif_id, 'DE' || chr(9) || max({_NAMED}) || chr(9) || max({_NAMED}) || chr(10) ||
  string_agg(pos || chr(9) || {" || chr(9) || ".join(f"{_floor(x)}::INTEGER" for x in 'acgt')} || chr(9), chr(10) ORDER BY pos) || chr(10) || 'XX' AS value
FROM cells GROUP BY 1""")
def s9(spark, sf):
    cells = logodds(spark, sf).withColumn("name", F.when(F.col("motif_id") % 2 == 0, "").otherwise(F.col("name")))
    return T.transfac_text(T.default_names(cells, "src"))


@query("s10_read_family_index", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, 'm' || vec_id AS tf, 'fam' || label AS family FROM embeddings")
def s10(spark, sf):
    path = scratch_path(spark, "families")
    rows = X.table(spark, sf, "embeddings").select("vec_id", F.concat(
        F.when(F.col("vec_id") % 50 == 0, "# note\n\n").otherwise(""),
        F.concat_ws("\t", F.concat(F.lit("m"), "vec_id"), F.lit("a"), F.lit("b"), F.concat(F.lit("fam"), "label"))).alias("value"))
    rows.orderBy("vec_id").select("value").write.text(path)
    return S.read_family_index(spark, path)


@query("s11_write_matrix", _LONG3 + "SELECT CAST(g.gene AS VARCHAR) AS gene, CAST(g.class AS VARCHAR) AS \"Class\", count(s.token)::DOUBLE AS n_ones "
       "FROM genes g LEFT JOIN stranded s ON s.gene = g.gene GROUP BY g.gene, g.class")
def s11(spark, sf):
    path = scratch_path(spark, "wide")
    O.write_table(_wide(spark, sf), path)
    back = S.read_matrix(spark, path)
    total = sum((F.col(f"`{c}`") for c in back.columns[3:]), F.col(f"`{back.columns[2]}`"))
    return back.select("gene", "Class", total.alias("n_ones"))


@query("s11_write_matrix_rows", f"WITH {X.SEQ}, {X.stranded_sql(4)} SELECT CAST(gene AS VARCHAR) AS gene, CAST(class AS VARCHAR) AS \"Class\", token FROM stranded")
def s11_rows(spark, sf):
    path = scratch_path(spark, "rows")
    seqs, tokens = X.sequences(spark, sf), U.canonical_words(spark, 4)
    O.write_matrix(P.presence_stranded(seqs, tokens, [4]), X.genes(spark, sf), O.numbered_tokens(tokens), path)
    return O.read_matrix_rows(spark, path)


@query("s11_append_run", f"WITH {X.SEQ} SELECT run, CAST(class AS VARCHAR) AS label, count(*)::VARCHAR AS n FROM genes, (VALUES ('run1'), ('run2')) r(run) GROUP BY 1, 2")
def s11_append(spark, sf):
    path = scratch_path(spark, "runs")
    for run in ("run1", "run2"):
        O.append_run(X.genes(spark, sf).groupBy("class").agg(F.count("*").alias("n")).select(F.lit(run), "class", "n"), path)
    return spark.read.schema("run string, label string, n string").csv(path, sep="\t")


@query("s12_read_importance", f"{_IMP} SELECT 'rep' || (CASE WHEN feature < 'G' THEN 1 ELSE 2 END) || '_imp.txt' AS replicate, count(*) AS n, round(sum(importance) * 1000000) AS total FROM imp GROUP BY 1")
def s12(spark, sf):
    root = scratch_path(spark, "importance")
    scores = importance(spark, sf)
    for n, part in ((1, scores.where("feature < 'G'")), (2, scores.where("feature >= 'G'"))):
        O.write_table(part, f"{root}/rep{n}_imp.txt", header=False)
    return S.read_importance(spark, root).groupBy(F.regexp_extract("replicate", r"(rep\d_imp.txt)", 1).alias("replicate")).agg(
        F.count("*").alias("n"), F.round(F.sum("importance") * 1000000).alias("total"))
