"""k-mers joined to genomic evidence (row C of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.operators import criteria as C
from kmerlake.operators import enrichment as E
from kmerlake.operators import presence as P
from kmerlake.operators import universe as U
from kmerlake.operators.selection import chi2_scores, top_n
from kmerlake.operators.windows import map_kmers
from kmerlake.session import scratch_path
from kmerlake.sources.sinks import write_split
from kmerlake.sources.text import clean_diversity, parse_region, read_manifest, read_manifest_hits
from querybook import fixtures as X
from querybook.enrich import base_sql, counts, sizes

QUERIES, ORACLES = {}, {}
K = 4


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def kmers(spark):
    return U.canonical_words(spark, K).select(F.col("token").alias("kmer"))


def hit_table(spark, sf):
    """Hits without the class: operators take it from the gene list."""
    return X.hits(spark, sf, K).drop("class")


# k-mers are all strand classes of length 4; hits are their places on both strands.
HITS = f"""WITH {X.SEQ}, {X.windows_sql(K)},
hits AS (SELECT gene, class, tok.token AS kmer, start, start + {K - 1} AS stop,
  CASE WHEN tok.fwd = wins.word THEN '+' ELSE '-' END AS dir
  FROM wins JOIN (SELECT word, {X.canon_sql('word')} AS fwd, {X.token_sql('word')} AS token FROM (SELECT DISTINCT word FROM wins)) tok ON tok.word = wins.word),
per_gene AS (SELECT kmer, gene, class, count(*) AS copies FROM hits GROUP BY 1, 2, 3),
totals AS (SELECT kmer, avg(copies) FILTER (class = 1) AS copy_pos, avg(copies) FILTER (class = 0) AS copy_neg,
  (sum(copies) FILTER (class = 1))::BIGINT AS hits_pos, (sum(copies) FILTER (class = 0))::BIGINT AS hits_neg
  FROM per_gene GROUP BY 1 HAVING sum(copies) FILTER (class = 1) IS NOT NULL)"""


def round_all(df, *columns):
    return df.withColumns({c: X.r6(F.col(c)) for c in columns})


@query("c1_criteria_base", f"WITH {X.SEQ}, {X.stranded_sql(K)} SELECT 'kmer' AS kind, token AS name, -1 AS class FROM stranded GROUP BY 2 "
       "UNION ALL SELECT 'gene', CAST(gene AS VARCHAR), class FROM stranded GROUP BY gene, class")
def c1(spark, sf):
    held = P.presence_stranded(X.sequences(spark, sf), U.canonical_words(spark, K), [K])
    words, genes = C.criteria_base(held)
    return words.select(F.lit("kmer").alias("kind"), F.col("kmer").alias("name"), F.lit(-1).alias("class")).unionByName(
        genes.select(F.lit("gene").alias("kind"), F.col("gene").cast("string").alias("name"), "class"))


@query("c2_attach", f"""{HITS} SELECT u.kmer, coalesce(t.hits_pos, 0) AS hits_pos FROM (SELECT DISTINCT kmer FROM hits) u LEFT JOIN (SELECT * FROM totals WHERE hits_pos * 7 >= hits_neg) t ON t.kmer = u.kmer""")
def c2(spark, sf):
    hits = hit_table(spark, sf)
    totals = C.copy_number(hits, kmers(spark), X.genes(spark, sf)).where("hits_pos * 7 >= hits_neg").select("kmer", "hits_pos")
    return C.attach(hits.select("kmer").distinct(), totals).fillna(0)


@query("c3_attach_enrichment", f"{base_sql(K)} SELECT token AS kmer, round(100.0::DOUBLE * pos_count / n_pos, 6) AS percent_positives, round(pvalue, 6) AS pvalue, {X.log_p_sql()} FROM tested")
def c3(spark, sf):
    tested = E.fisher_greater(counts(spark, sf, K), sizes(spark, sf))
    return logged(round_all(C.attach_enrichment(kmers(spark), tested), "percent_positives", "pvalue"))


_CHI2 = """chi AS (SELECT token AS feature, power(pos_count - tot * n_pos / n, 2) / (tot * n_pos / n) + power(neg_count - tot * n_neg / n, 2) / (tot * n_neg / n) AS chi2
  FROM (SELECT *, (pos_count + neg_count)::DOUBLE AS tot, (n_pos + n_neg)::DOUBLE AS n FROM tested WHERE pos_count + neg_count > 0))"""


@query("c4_attach_importance", f"{base_sql(K)}, {_CHI2} SELECT t.token AS kmer, round(c.chi2, 6) AS chi2_imp FROM tested t LEFT JOIN chi c ON c.feature = t.token")
def c4(spark, sf):
    held = P.presence_stranded(X.sequences(spark, sf), U.canonical_words(spark, K), [K])
    scores = chi2_scores(held, X.genes(spark, sf)).withColumnRenamed("chi2", "importance")
    return round_all(C.attach_importance(kmers(spark), scores, "chi2_imp"), "chi2_imp")


@query("c5_semi_filter", f"""{HITS} SELECT kmer, class, count(*) AS n, min(start) AS first_start FROM hits
WHERE gene IN (SELECT doc_id FROM labels WHERE quality = 1) AND kmer <= 'C' GROUP BY 1, 2""")
def c5(spark, sf):
    good = X.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("gene"))
    wanted = X.genes(spark, sf).join(good, "gene", "left_semi")
    return C.semi_filter(hit_table(spark, sf), kmers(spark).where("kmer <= 'C'"), wanted).groupBy("kmer", "class").agg(
        F.count("*").alias("n"), F.min("start").alias("first_start"))


@query("c6_copy_number", f"{HITS} SELECT kmer, round(copy_pos, 6) AS copy_pos, round(copy_neg, 6) AS copy_neg, hits_pos, hits_neg FROM totals")
def c6(spark, sf):
    return round_all(C.copy_number(hit_table(spark, sf), kmers(spark), X.genes(spark, sf)), "copy_pos", "copy_neg")


def welch_sql(source: str, value: str) -> str:
    return f"""m AS (SELECT kmer, avg({value}) FILTER (class = 1) AS m1, var_samp({value}) FILTER (class = 1) AS v1, (count({value}) FILTER (class = 1))::DOUBLE AS n1,
  avg({value}) FILTER (class = 0) AS m0, var_samp({value}) FILTER (class = 0) AS v0, (count({value}) FILTER (class = 0))::DOUBLE AS n0 FROM {source} GROUP BY 1),
tt AS (SELECT kmer, CASE WHEN n1 >= 2 AND n0 >= 2 AND v1 / n1 + v0 / n0 > 0 THEN (m1 - m0) / sqrt(v1 / n1 + v0 / n0) END AS t,
  CASE WHEN n1 >= 2 AND n0 >= 2 AND v1 / n1 + v0 / n0 > 0 THEN power(v1 / n1 + v0 / n0, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v0 / n0, 2) / (n0 - 1)) END AS df FROM m)
SELECT kmer, round(t, 6) AS t, CASE WHEN t IS NOT NULL THEN round({X.t_two_tailed_sql('t', 'df')}, 6) END AS pvalue FROM tt"""


@query("c7_welch_copy_number", f"{HITS}, {welch_sql('per_gene', 'copies')}")
def c7(spark, sf):
    return round_all(C.copy_number_welch(hit_table(spark, sf), kmers(spark), X.genes(spark, sf)), "t", "pvalue")


def overlap_sql(m: int, fill: str = "late") -> str:
    t1, t3 = ("coalesce(t1, 0)", "coalesce(t3, 0)") if fill == "early" else ("t1", "t3")
    args = ("t1", "(t1 + t2)", "t3", "(t3 + t4)")
    return f"""SELECT kmer, t1, t2, t3, t4, odds, round(exp(ln_p), 6) AS pvalue, {X.log_p_sql()}
FROM (SELECT *, round({X.odds_sql(*args)}, 6) AS odds, {X.ln_fisher_two_sql(*args)} AS ln_p FROM (SELECT kmer, coalesce(t1, 0) AS t1, coalesce(hits_pos - {t1}, 0) AS t2, coalesce(t3, 0) AS t3, coalesce(hits_neg - {t3}, 0) AS t4
  FROM totals LEFT JOIN (SELECT kmer, nullif(count(*) FILTER (class = 1), 0) AS t1, nullif(count(*) FILTER (class = 0), 0) AS t3
    FROM hits WHERE (start + gene) % {m} = 0 GROUP BY 1) USING (kmer)))"""


def logged(df):
    """Replace every ``ln_p`` column by its −log10 form ``log_p``."""
    for name in [c for c in df.columns if c.endswith("ln_p")]:
        out = name.removesuffix("ln_p") + "log_p"
        df = df.withColumn(name, X.log_p(name, out)).withColumnRenamed(name, out)
    return df


def overlap(spark, sf, m, fill="late"):
    hits, words, genes = hit_table(spark, sf), kmers(spark), X.genes(spark, sf)
    totals = C.copy_number(hits, words, genes)
    return logged(round_all(C.overlap_enrichment(totals, X.annotate(hits, m), words, genes, fill), "odds", "pvalue"))


# Peaks at every 397th place: some k-mers have no overlapping hit, so the fill rule shows.
@query("c8_overlap_enrichment", f"{HITS} {overlap_sql(397)}")
def c8(spark, sf):
    return overlap(spark, sf, 397)


@query("c8_overlap_enrichment_early", f"{HITS} {overlap_sql(397, 'early')}")
def c8_early(spark, sf):
    return overlap(spark, sf, 397, "early")


def feature(spark, sf, name, m):
    hits, words, genes = hit_table(spark, sf), kmers(spark), X.genes(spark, sf)
    tagged = X.annotate(hits, m).withColumn("mark", F.lit(name))
    out = C.feature_enrichment(C.copy_number(hits, words, genes), tagged, [name], words, genes)
    named = out.withColumnsRenamed({c: f"{name}_{c}" for c in ("odds", "pval", "ln_p")})
    return logged(round_all(named, f"{name}_odds", f"{name}_pval"))


for _name, _m, _row in (("DAP", 5, "c9"), ("DHS", 7, "c10"), ("CNS", 11, "c11")):
    query(f"{_row}_{_name.lower()}_enrichment", f"{HITS} SELECT kmer, odds AS {_name}_odds, pvalue AS {_name}_pval, log_p AS {_name}_log_p FROM ({overlap_sql(_m)})")(
        lambda spark, sf, name=_name, m=_m: feature(spark, sf, name, m))

MARKS = {"mark1_A": 3, "mark2_R": 4, "mark3_A": 6, "mark4_R": 9}


def histone(spark, sf):
    hits, words, genes = hit_table(spark, sf), kmers(spark), X.genes(spark, sf)
    place = F.col("start") + F.col("gene")
    marks = F.array(*[F.struct(F.lit(n).alias("mark"), (place % m == 0).alias("peak")) for n, m in MARKS.items()])
    tagged = hits.select("gene", "kmer", F.explode(marks).alias("x")).select(
        "gene", "kmer", "x.mark", F.when(F.col("x.peak"), "overlap=peak").otherwise("overlap=NA").alias("details"))
    return C.histone_enrichment(C.copy_number(hits, words, genes), tagged, list(MARKS), words, genes)


_MARKS_SQL = (f"{HITS} SELECT kmer, " + ", ".join(
    f"a{i}.odds AS {n}_Odds, a{i}.pvalue AS {n}_pval, a{i}.log_p AS {n}_log_p" for i, n in enumerate(MARKS)) + " FROM " + " JOIN ".join(
    f"({overlap_sql(m)}) a{i}" + (" USING (kmer)" if i else "") for i, m in enumerate(MARKS.values())))


@query("c12_histone_enrichment", _MARKS_SQL)
def c12(spark, sf):
    return _shown(histone(spark, sf))


@query("c12_histone_manifest", _MARKS_SQL)
def c12_manifest(spark, sf):
    """Hit tables of all marks, of the hits that overlap, and their manifest are written, and read again in one scan."""
    base = scratch_path(spark, "marks")
    hits, words, genes = hit_table(spark, sf), kmers(spark), X.genes(spark, sf)
    place = F.col("start") + F.col("gene")
    marks = F.array_compact(F.array(*[F.when(place % m == 0, F.lit(name)) for name, m in MARKS.items()]))
    write_split(hits.select(
        F.lit("chr1").alias("chr"), F.col("gene").cast("string").alias("gene"), "kmer", "start", "end", F.lit(".").alias("x"), "dir",
        F.lit(".").alias("y"), F.lit("overlap=peak").alias("details"), F.explode(marks).alias("mark"),
    ), base, "mark", len(MARKS))
    listed = [(name.split("_")[0], {"A": "Activator", "R": "Repressor"}[name[-1]], f"{base}/mark={name}") for name in MARKS]
    manifest = scratch_path(spark, "manifest")
    spark.createDataFrame(listed, "mark string, kind string, path string").write.csv(manifest, sep="\t")
    listed = read_manifest(spark, manifest)
    tagged = read_manifest_hits(spark, listed).withColumn("gene", F.col("gene").cast("long"))
    return _shown(C.histone_enrichment(C.copy_number(hits, words, genes), tagged, list(MARKS), words, genes))


def _shown(out):
    return logged(round_all(out, *[c for c in out.columns if c != "kmer" and not c.endswith("ln_p")]))


def diversity(spark, sf):
    text = X.diversity_text(hit_table(spark, sf))
    return text.select(*[c.alias(n) for n, c in parse_region(F.col("Region")).items()],
                       clean_diversity(F.col("NtDiversity")).alias("nt_div")).withColumn("gene", F.col("gene").cast("long"))


DIV = f"{HITS}, div AS (SELECT kmer, class, CASE WHEN start % 7 = 0 THEN 0.0::DOUBLE ELSE ((start * 31 + gene) % 100) / 997.0::DOUBLE END AS nt_div FROM hits)"


@query("c13_diversity_means", f"{DIV} SELECT kmer, round(avg(nt_div) FILTER (class = 1), 6) AS div_pos, round(avg(nt_div) FILTER (class = 0), 6) AS div_neg FROM div GROUP BY 1")
def c13(spark, sf):
    return round_all(C.diversity_means(diversity(spark, sf), kmers(spark), X.genes(spark, sf)), "div_pos", "div_neg")


@query("c14_diversity_welch", f"{DIV}, {welch_sql('div', 'nt_div')}")
def c14(spark, sf):
    return round_all(C.diversity_welch(diversity(spark, sf), kmers(spark), X.genes(spark, sf)), "t", "pvalue")


# Selected words: the 4-mers of the positives' commonest strand classes; k-mers: all enriched 6-mers.
@query("c15_fs_overlap", f"""{base_sql(6)}, {X.windows_sql(K, 'sequences', 'w4')},
selected AS (SELECT word FROM w4 GROUP BY 1 HAVING count(DISTINCT gene) FILTER (class = 1) * 7 >= count(DISTINCT gene) FILTER (class = 0)),
enriched AS (SELECT split_part(token, '.', 1) AS kmer FROM tested WHERE pvalue <= 0.05)
SELECT kmer, max(CASE WHEN contains(kmer, word) THEN 1 ELSE 0 END)::INTEGER AS fs_overlap FROM enriched, selected GROUP BY 1""")
def c15(spark, sf):
    words = U.kmer_universe(spark, K).select(F.col("word").alias("token"))
    found = E.class_counts(P.presence_single(X.sequences(spark, sf), words, [K]))
    tested = E.filter_enriched(E.fisher_greater(counts(spark, sf, 6), sizes(spark, sf)), 0.05)
    long = tested.select(F.element_at(F.split("token", r"\."), 1).alias("kmer"))
    return C.fs_overlap(long, found.where("pos_count * 7 >= neg_count"), [K])


def known(spark, sf, dap: bool):
    """Distances of all other motifs to the members of two families, standing for k-mer × known motif."""
    from kmerlake.operators.distance import pcc_distance_2
    cells = X.motif_probs(spark, sf)
    family = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("motif_id"), "label")
    side = family.where("label >= 8" if dap else "label < 2").select("motif_id")
    rest = family.where("label < 8" if dap else "label >= 2").select("motif_id")
    d = pcc_distance_2(cells.join(rest, "motif_id", "left_semi"), cells.join(side, "motif_id", "left_semi"), aligned=False)
    return d.select(F.concat(F.lit("k"), "i").alias("kmer"), F.concat(F.lit("m"), "j").alias("motif"),
                    F.col("j").alias("pos"), X.r6(F.col("d")).alias("d"))


def distance_sql(left: str, right: str, pair: str, name: str = "dist") -> str:
    """Distances (i, j, d) by the definition: every shift, both orientations, mean column correlation."""
    n = X.WIDTH
    return f"""unitc AS (SELECT motif_id, pos, a - 0.25 AS a, c - 0.25 AS c, g - 0.25 AS g, t - 0.25 AS t FROM probs),
unit AS (SELECT motif_id, pos, CASE WHEN s > 1e-12 THEN a / s ELSE 0 END AS a, CASE WHEN s > 1e-12 THEN c / s ELSE 0 END AS c,
  CASE WHEN s > 1e-12 THEN g / s ELSE 0 END AS g, CASE WHEN s > 1e-12 THEN t / s ELSE 0 END AS t
  FROM (SELECT *, sqrt(a * a + c * c + g * g + t * t) AS s FROM unitc)),
turned AS (SELECT motif_id, pos, 0 AS flip, a, c, g, t FROM unit UNION ALL SELECT motif_id, {n - 1} - pos, 1, t, g, c, a FROM unit),
cells AS (SELECT x.motif_id AS i, y.motif_id AS j, y.flip, x.pos - y.pos AS shift, avg(x.a * y.a + x.c * y.c + x.g * y.g + x.t * y.t) AS r
  FROM unit x JOIN turned y ON {pair} AND abs(x.pos - y.pos) <= {n - n // 2}
  WHERE {left} AND {right} GROUP BY 1, 2, 3, 4),
{name} AS (SELECT i, j, 1 - max(r) AS d FROM cells GROUP BY 1, 2)"""


def _family(side: str, cond: str) -> str:
    return f"{side}.motif_id IN (SELECT vec_id FROM embeddings WHERE label {cond})"


for _dap, _row, _col, _val in ((False, "c16_best_match", "TFBM", "TFBM_PCCD"), (True, "c17_best_match_dap", "DAPSeq_TFBM", "DAPSeq_TFBM_PCCD")):
    query(_row, f"""WITH {X.PROBS}, {distance_sql(_family('x', '< 8' if _dap else '>= 2'), _family('y', '>= 8' if _dap else '< 2'), 'true')}
SELECT 'k' || i AS kmer, 'm' || arg_min(j, round(d, 6) * 1000000 * 100000 + j) AS {_col}, min(round(d, 6)) AS {_val} FROM dist GROUP BY i""")(
        lambda spark, sf, dap=_dap: (C.best_match_dap if dap else C.best_match)(known(spark, sf, dap)))


# Annotations and histone marks of the criteria table, with the step of their made peaks.
FEATURES = {"DAP": 5, "DHS": 7, "CNS": 11, **MARKS}
#: The best 3-mers by chi-square stand for the selected words.
SELECTED = 3


def _criteria(spark, sf):
    from kmerlake.plans.evidence import criteria_table
    seqs, genes = X.sequences(spark, sf), X.genes(spark, sf)
    held = P.presence_stranded(seqs, U.canonical_words(spark, K), [K])
    scores = chi2_scores(held, genes).withColumnRenamed("chi2", "importance")
    words = P.presence_single(seqs, U.kmer_universe(spark, 3).select(F.col("word").alias("token")), [3])
    ranked = chi2_scores(words, genes).withColumnRenamed("chi2", "importance")
    selected = top_n(ranked, SELECTED).select(F.col("feature").alias("token"))
    place = lambda a, m: (F.col("start") * a + F.col("gene")) % m
    div = F.when(F.col("start") % 7 == 0, 0.0).otherwise(place(31, 100) / 997.0)
    return criteria_table(
        held, genes, hit_table(spark, sf), {name: place(1, m) == 0 for name, m in FEATURES.items()}, div, {"chi2_imp": scores}, selected)


_TABLE = f"""{HITS}, {X.counts_sql('(SELECT DISTINCT gene, class, kmer AS token FROM hits)', 'counts')}, {X.tested_sql()}, {_CHI2}, {X.windows_sql(3, 'sequences', 'w3')},
w3counts AS (SELECT word, count(DISTINCT gene) FILTER (class = 1) AS p, count(DISTINCT gene) FILTER (class = 0) AS q FROM w3 GROUP BY 1),
w3chi AS (SELECT word, power(p - tot * n_pos / n, 2) / (tot * n_pos / n) + power(q - tot * n_neg / n, 2) / (tot * n_neg / n) AS chi2
  FROM (SELECT *, (p + q)::DOUBLE AS tot, (n_pos + n_neg)::DOUBLE AS n FROM w3counts, sizes)),
selected AS (SELECT word FROM w3chi ORDER BY chi2 DESC, word LIMIT {SELECTED}),
div AS (SELECT kmer, class, CASE WHEN start % 7 = 0 THEN 0.0::DOUBLE ELSE ((start * 31 + gene) % 100) / 997.0::DOUBLE END AS nt_div FROM hits),
w1 AS ({'WITH ' + welch_sql('per_gene', 'copies')}), w2 AS ({'WITH ' + welch_sql('div', 'nt_div')}),
dm AS (SELECT kmer, avg(nt_div) FILTER (class = 1) AS div_pos, avg(nt_div) FILTER (class = 0) AS div_neg FROM div GROUP BY 1)
SELECT b.token AS kmer, round(100.0::DOUBLE * b.pos_count / b.n_pos, 6) AS percent_positives, round(b.pvalue, 6) AS pvalue,
  {X.log_p_sql('b.ln_p')}, c2.chi2_imp, coalesce(f.fs_overlap, 0) AS fs_overlap,
  round(t.copy_pos, 6) AS copy_pos, round(t.copy_neg, 6) AS copy_neg, t.hits_pos::DOUBLE AS hits_pos, t.hits_neg::DOUBLE AS hits_neg, w1.t AS copy_t, w1.pvalue AS copy_pval,
  {', '.join(f'x{m}.odds AS {n}_odds, x{m}.pvalue AS {n}_pval, x{m}.log_p AS {n}_log_p' for n, m in FEATURES.items())},
  round(dm.div_pos, 6) AS div_pos, round(dm.div_neg, 6) AS div_neg, w2.t AS div_t, w2.pvalue AS div_pval
FROM tested b LEFT JOIN totals t ON t.kmer = b.token LEFT JOIN w1 ON w1.kmer = b.token LEFT JOIN w2 ON w2.kmer = b.token
LEFT JOIN dm ON dm.kmer = b.token {' '.join(f'LEFT JOIN ({overlap_sql(m)}) x{m} ON x{m}.kmer = b.token' for m in FEATURES.values())}
LEFT JOIN (SELECT feature, round(chi2, 6) AS chi2_imp FROM chi) c2 ON c2.feature = b.token
LEFT JOIN (SELECT DISTINCT token, 1 AS fs_overlap FROM tested JOIN selected ON contains(split_part(token, '.', 1), word)) f ON f.token = b.token"""


@query("c18_criteria_table", _TABLE)
def c18(spark, sf):
    out = _criteria(spark, sf)
    skip = [c for c in out.columns if c in ("kmer", "hits_pos", "hits_neg", "fs_overlap") or c.endswith("ln_p")]
    return logged(round_all(out, *[c for c in out.columns if c not in skip])).withColumns(
        {c: F.col(c).cast("double") for c in ("hits_pos", "hits_neg")})


@query("c19_label_sites", """WITH m AS (SELECT vec_id AS gene, label, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS tf1, CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS tf2 FROM embeddings)
SELECT gene, label, tf1, tf2, 1 AS "Class" FROM m WHERE gene IN (SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT gene, label, tf1, tf2, 0 FROM m WHERE gene IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def c19(spark, sf):
    labels = X.table(spark, sf, "labels").withColumnRenamed("doc_id", "gene")
    site = lambda i: F.when(F.col("embedding")[i] > 0, 1).otherwise(0)
    matrix = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("gene"), "label", site(0).alias("tf1"), site(1).alias("tf2"))
    return C.label_sites(matrix, labels.where("quality = 0"), labels.where("toxic = 0"))


_SHORT = ["AC", "CAG.CTG", "GATTC", "TTGACA"]
_LENGTHS = sorted({len(w.split(".")[0]) for w in _SHORT})


@query("c21_map_kmers_mixed", f"""WITH {X.SEQ}, listed AS (SELECT kmer, split_part(kmer, '.', 1) AS word FROM (VALUES {', '.join(f"('{w}')" for w in _SHORT)}) t(kmer)),
target AS (SELECT kmer, word, '+' AS dir FROM listed UNION ALL SELECT kmer, {X.rc_sql('word')}, '-' FROM listed),
{', '.join(X.windows_sql(k, 'sequences', f'wins{k}') for k in _LENGTHS)},
places AS ({' UNION ALL '.join(f'SELECT gene, start, word FROM wins{k}' for k in _LENGTHS)})
SELECT gene, kmer, dir, count(*) AS n, sum(start)::BIGINT AS sum_start, max(start + length(word) - 1) AS last_end
FROM places JOIN target USING (word) GROUP BY 1, 2, 3""")
def c21_mixed(spark, sf):
    words = spark.createDataFrame([(w,) for w in _SHORT], "kmer string")
    return map_kmers(X.sequences(spark, sf), words).groupBy("gene", "kmer", "dir").agg(
        F.count("*").alias("n"), F.sum("start").alias("sum_start"), F.max("end").alias("last_end"))


@query("c21_map_kmers", f"""{HITS} SELECT gene, dir, count(*) AS n, count(DISTINCT kmer) AS n_kmers, sum(start)::BIGINT AS sum_start, max(stop) AS last_end
FROM (SELECT gene, kmer, start, stop, dir FROM hits UNION ALL
      SELECT gene, kmer, start, stop, '-' FROM hits WHERE dir = '+' AND split_part(kmer, '.', 1) = split_part(kmer, '.', 2)) GROUP BY 1, 2""")
def c21(spark, sf):
    words = U.canonical_words(spark, K).select(F.col("word").alias("kmer"))
    return map_kmers(X.sequences(spark, sf), words, K).groupBy("gene", "dir").agg(
        F.count("*").alias("n"), F.countDistinct("kmer").alias("n_kmers"), F.sum("start").alias("sum_start"), F.max("end").alias("last_end"))
