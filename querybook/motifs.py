"""Motif matrices, distances, clusters and scans (row W of the survey); all embeddings are motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerlake.operators import clustering as L
from kmerlake.operators import distance as D
from kmerlake.operators import motifs as W
from kmerlake.sources.motif_text import LETTERS
from querybook import fixtures as X
from querybook.evidence import _family, distance_sql
from querybook.sources import _LOG, logodds

QUERIES, ORACLES = {}, {}
# Embedding motifs are far apart: the cut lies where some clusters form.
HEIGHT = 0.25
BITS = 0.12
FRACTION = 0.9
# Targets of the motifs: the documents in the language that has most of their sites; AT_LEAST is the -log10 p of a winner.
TARGETS, AT_LEAST = "en", 1.0


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(df, *columns):
    return df.withColumns({c: X.r6(F.col(c)) for c in columns})


_R = ", ".join(f"round({x}, 6) AS {x}" for x in LETTERS)

# Words: the letters of each part name that are IUPAC signs; small parts are commented out.
_ALLOWED = "".join(W.IUPAC)


@query("w1_pwm_from_text", f"""WITH words AS (SELECT p_partkey AS motif_id, regexp_replace(upper(p_name), '[^{_ALLOWED}]', '', 'g') AS word FROM part WHERE p_size > 5),
letters AS (SELECT motif_id, word AS name, pos::INTEGER AS pos, substr(word, pos + 1, 1) AS l FROM (SELECT *, unnest(range(length(word))) AS pos FROM words WHERE word <> ''))
SELECT motif_id, name, pos, {', '.join("CASE " + ' '.join(f"WHEN l = '{k}' THEN {round(1 / len(v), 6)}::DOUBLE" for k, v in W.IUPAC.items() if x in v) + f" ELSE 0.0::DOUBLE END AS {x}" for x in LETTERS)} FROM letters""")
def w1(spark, sf):
    text = F.regexp_replace(F.upper("p_name"), f"[^{_ALLOWED}]", "")
    words = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("motif_id"), F.when(F.col("p_size") > 5, text).otherwise(F.concat(F.lit("#"), text)).alias("word"))
    return r6(W.pwm_from_text(words), *LETTERS)


_COUNTS = f"WITH {X.PROBS}, counts AS (SELECT motif_id, name, pos, {', '.join(f'floor({x} * 100) AS {x}' for x in LETTERS)} FROM probs)"


def count_cells(spark, sf):
    return W._map_letters(X.motif_probs(spark, sf), lambda x: F.floor(F.col(x) * 100).cast("double"))


@query("w2_pwm_from_counts", f"""{_COUNTS} SELECT motif_id, name, pos, {', '.join(
    f"round(log2(({x} + {W.BACKGROUND[x]}::DOUBLE) / (a + c + g + t + 1) / {W.BACKGROUND[x]}::DOUBLE), 6) AS {x}" for x in LETTERS)} FROM counts""")
def w2(spark, sf):
    return r6(W.pwm_from_counts(count_cells(spark, sf)), *LETTERS)


@query("w3_logodds_to_probs", f"WITH {X.PROBS} SELECT motif_id, name, pos, {_R} FROM probs")
def w3(spark, sf):
    return r6(W.logodds_to_probs(logodds(spark, sf)), *LETTERS)


_BITS = " + ".join(f"{x} * log2({x} / {W.BACKGROUND[x]}::DOUBLE)" for x in LETTERS)
_TRIM = f"""ranged AS (SELECT *, min(CASE WHEN bits >= {BITS} THEN pos END) OVER (PARTITION BY motif_id) AS lo, max(CASE WHEN bits >= {BITS} THEN pos END) OVER (PARTITION BY motif_id) AS hi
  FROM (SELECT *, {_BITS} AS bits FROM probs))"""


@query("w4_trim", f"WITH {X.PROBS}, {_TRIM} SELECT motif_id, name, (pos - lo)::INTEGER AS pos, {_R} FROM ranged WHERE pos BETWEEN lo AND hi")
def w4(spark, sf):
    return r6(W.trim(X.motif_probs(spark, sf), BITS), *LETTERS)


_SELF = f"WITH {X.PROBS}, {distance_sql('true', 'true', 'x.motif_id < y.motif_id')}"


def distance(spark, sf):
    return D.pcc_distance(X.motif_probs(spark, sf), aligned=False)


@query("w5_pcc_distance", f"{_SELF} SELECT i, j, round(d, 6) AS d FROM dist")
def w5(spark, sf):
    return distance(spark, sf).select("i", "j", X.r6(F.col("d")).alias("d"))


@query("w6_assemble_matrix", f"{_SELF} SELECT i, j, printf('%.4f', round(d, 4)) AS cell FROM dist UNION ALL SELECT j, i, '-' FROM dist")
def w6(spark, sf):
    d = distance(spark, sf).withColumn("d", F.round("d", 4))
    cells = W.assemble_matrix([d.where("i % 2 = 0"), d.where("i % 2 = 1")])
    number = F.format_string("%.4f", F.col("cell").try_cast("double"))
    return cells.select("i", "j", F.when(F.col("cell") == "-", "-").otherwise(number).alias("cell"))


@query("w7_assemble_matrix_2", f"WITH {X.PROBS}, {distance_sql(_family('x', '< 5'), _family('y', '>= 5'), 'true')} SELECT i, j, round(d, 6) AS d FROM dist")
def w7(spark, sf):
    cells = X.motif_probs(spark, sf)
    family = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("motif_id"), "label")
    pick = lambda cond: cells.join(family.where(cond).select("motif_id"), "motif_id", "left_semi")
    left = pick("label < 5")
    blocks = [D.pcc_distance_2(left, pick(cond), aligned=False) for cond in ("label in (5, 6, 7)", "label in (8, 9)")]
    return r6(W.assemble_matrix_2(blocks), "d")


# Text cells with faults: some distances are scaled out of range, some are nan, some are missing.
_CELL = "CASE WHEN (i + j) % 17 = 0 THEN 'nan' ELSE CAST(CAST(floor(d * 5) AS BIGINT) AS VARCHAR) END"


@query("w8_check_matrix", f"""{_SELF}, texts AS (SELECT i, j, {_CELL} AS cell FROM dist WHERE NOT (i % 50 = 0 AND j % 3 = 0)),
widths AS (SELECT i, count(*) AS n FROM texts GROUP BY 1), usual AS (SELECT n FROM (SELECT n, count(*) AS r FROM widths GROUP BY 1) ORDER BY r DESC, n DESC LIMIT 1)
SELECT 'cell' AS problem, i, j FROM texts WHERE NOT regexp_matches(replace(cell, 'nan', '1'), '^[01-]')
UNION ALL SELECT 'row', i, -1 FROM widths WHERE n <> (SELECT n FROM usual)""")
def w8(spark, sf):
    cells = distance(spark, sf).where("not (i % 50 = 0 and j % 3 = 0)").select("i", "j", F.when(
        (F.col("i") + F.col("j")) % 17 == 0, "nan").otherwise(F.floor(F.col("d") * 5).cast("string")).alias("cell"))
    return W.check_matrix(cells).fillna(-1, ["j"])


_BOTH = "both_ways AS (SELECT i, j, d FROM dist UNION ALL SELECT j, i, d FROM dist)"


def families(spark, sf):
    from kmerlake.session import written
    rows = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("j"), F.concat(F.lit("fam"), "label").alias("family"))
    return written(rows, "families")  # written, so that its size is known and the pairs are not shuffled for it


_AVG = f"{_SELF}, {_BOTH}, fam AS (SELECT i, 'fam' || label AS family, avg(d) AS d FROM both_ways JOIN embeddings ON vec_id = j GROUP BY 1, 2)"


@query("w9_family_average", f"{_AVG} SELECT i, family, round(d, 6) AS d FROM fam")
def w9(spark, sf):
    return r6(W.family_average(W.symmetric(distance(spark, sf)), families(spark, sf)), "d")


@query("w10_best_family", f"{_AVG} SELECT i, arg_min(family, d) AS family, round(min(d), 6) AS d FROM fam GROUP BY 1")
def w10(spark, sf):
    return r6(W.best_family(W.family_average(W.symmetric(distance(spark, sf)), families(spark, sf))), "d")


@query("w11_attach_names", f"""{_SELF}, {_BOTH}, near AS (SELECT i, min(d) AS d FROM both_ways GROUP BY 1)
SELECT row_number() OVER (ORDER BY i) - 1 AS pos, i, round(d, 6) AS d, 'tf' || i AS name FROM near""")
def w11(spark, sf):
    from kmerlake.session import materialise, scratch_path
    from kmerlake.sources.text import number_lines, read_lines
    near = materialise(W.symmetric(distance(spark, sf)).groupBy("i").agg(X.r6(F.min("d")).alias("d")))  # sorted and written twice
    matrix, names = scratch_path(spark, "near"), scratch_path(spark, "names")
    near.orderBy("i").select(F.concat_ws("\t", "i", "d").alias("value")).write.text(matrix)
    near.orderBy("i").select(F.concat(F.lit("tf"), "i").alias("value")).write.text(names)
    rows = number_lines(read_lines(spark, matrix)).select(
        "pos", F.split("value", "\t")[0].cast("long").alias("i"), F.split("value", "\t")[1].cast("double").alias("d"))
    return W.attach_names(rows, number_lines(read_lines(spark, names)).withColumnRenamed("value", "name"))


# Embedding distances start near 0.3; the shipped cutoff of 0.39 marks only a few.
@query("w12_significant_matches", f"{_SELF} SELECT i, j, CASE WHEN d <= 0.39 THEN 1 ELSE 0 END AS significant FROM dist")
def w12(spark, sf):
    return W.significant_matches(distance(spark, sf))


@query("w13_cluster_motifs")
def w13(spark, sf):
    ids = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("motif_id"))
    return L.cluster_motifs(ids, distance(spark, sf), HEIGHT)


_SIZES = "SELECT vec_id AS motif_id, CAST(floor(embedding[1] * 300) AS BIGINT) AS cluster FROM embeddings"


def label_clusters(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("motif_id"), F.floor(F.col("embedding")[0] * F.lit(300.0).cast("float")).alias("cluster"))


@query("w14_split_singletons", f"WITH c AS ({_SIZES}) SELECT motif_id, cluster, n AS size, CASE WHEN n = 1 THEN 'single' ELSE 'merge' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM c)")
def w14(spark, sf):
    single, grouped = W.split_singletons(label_clusters(spark, sf))
    return single.withColumn("part", F.lit("single")).unionByName(grouped.withColumn("part", F.lit("merge")))


# A window reaches a motif's limit only if each part of it leaves the limit within reach of the others: parts of 6, 5 and 5 positions.
PARTS = [(0, 6), (6, 5), (11, 5)]


def _part_sql(n: int, start: int, size: int) -> str:
    """Scores of all words at some positions of each motif, and the most they can be."""
    return f"""{X.universe_sql(size, f'u{n}')},
s{n} AS (SELECT motif_id, word, sum(CASE substr(word, pos - {start} + 1, 1) WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g ELSE t END) AS s
  FROM odds JOIN u{n} ON pos BETWEEN {start} AND {start + size - 1} GROUP BY 1, 2),
m{n} AS (SELECT motif_id, max(s) AS m FROM s{n} GROUP BY 1)"""


_SITES = f"""odds AS (SELECT motif_id, pos::INTEGER AS pos, {', '.join(f"log2({x} / {W.BACKGROUND[x]}::DOUBLE) AS {x}" for x in LETTERS)} FROM probs),
{', '.join(_part_sql(n, *part) for n, part in enumerate(PARTS))},
least_score AS (SELECT motif_id, {FRACTION}::DOUBLE * (m0.m + m1.m + m2.m) - 1e-9::DOUBLE AS least_s, m1.m AS m1, m2.m AS m2
  FROM m0 JOIN m1 USING (motif_id) JOIN m2 USING (motif_id)),
seen AS (SELECT gene, class, word, count(*) AS n FROM wins GROUP BY 1, 2, 3),
both2 AS (SELECT word, word AS text, '+' AS dir FROM (SELECT DISTINCT word FROM seen) UNION ALL SELECT {X.rc_sql('word')}, word, '-' FROM (SELECT DISTINCT word FROM seen)),
p0 AS (SELECT motif_id, word, s, least_s, m2 FROM s0 JOIN least_score USING (motif_id) WHERE s + m1 + m2 >= least_s),
c0 AS (SELECT motif_id, b.word, text, dir, s, least_s, m2 FROM both2 b JOIN p0 ON p0.word = substr(b.word, 1, 6)),
c1 AS (SELECT c.motif_id, c.word, text, dir, c.s + s1.s AS s, least_s FROM c0 c JOIN s1 ON s1.motif_id = c.motif_id AND s1.word = substr(c.word, 7, 5) WHERE c.s + s1.s + m2 >= least_s),
sites AS (SELECT c.motif_id, text AS word, dir, c.s + s2.s AS score FROM c1 c JOIN s2 ON s2.motif_id = c.motif_id AND s2.word = substr(c.word, 12, 5) WHERE c.s + s2.s >= least_s)"""
_SPEC = f"""WITH {X.PROBS}, {X.SEQ}, {X.windows_sql(X.WIDTH)}, {_SITES},
aims AS (SELECT doc_id AS gene, CASE WHEN lang = '{TARGETS}' THEN 1 ELSE 0 END AS aim FROM documents),
aimed AS (SELECT count(*) FILTER (aim = 1) AS n_pos, count(*) FILTER (aim = 0) AS n_neg FROM aims),
hit AS (SELECT DISTINCT motif_id, gene FROM seen JOIN (SELECT DISTINCT motif_id, word FROM sites) USING (word)),
oc AS (SELECT motif_id, count(*) FILTER (aim = 1) AS overlap, count(*) FILTER (aim = 0) AS others FROM hit JOIN aims USING (gene) GROUP BY 1),
spec AS (SELECT motif_id, overlap + others AS hits, overlap, {X.ln_fisher_sql('overlap', 'n_pos', 'others', 'n_neg')} AS ln_p FROM oc, aimed)"""


def targets(spark, sf):
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("gene"), F.when(F.col("lang") == TARGETS, 1).otherwise(0).alias("class"))


def specificity(spark, sf):
    """Whole motifs: genes hit on either strand at ``FRACTION`` of the motif's maximum, against the positives."""
    return W.group_specificity(D.motif_genes(X.sequences(spark, sf), logodds(spark, sf), FRACTION), targets(spark, sf))


@query("w15_group_specificity", f"{_SPEC} SELECT motif_id, hits, overlap, round(exp(ln_p), 6) AS pvalue, {X.log_p_sql()} FROM spec")
def w15(spark, sf):
    rated = specificity(spark, sf)
    return r6(rated, "pvalue").select("motif_id", "hits", "overlap", "pvalue", X.log_p())


@query("w16_top_motif", f"""{_SPEC}, r AS (SELECT c.cluster, s.motif_id, -ln_p / ln(10.0::DOUBLE) AS strength FROM spec s JOIN ({_SIZES}) c USING (motif_id))
SELECT cluster, motif_id, round(strength, 4) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(strength, 9) DESC, motif_id) AS k FROM r) WHERE k = 1 AND strength >= {AT_LEAST}::DOUBLE""")
def w16(spark, sf):
    rated = specificity(spark, sf).join(label_clusters(spark, sf), "motif_id")
    return W.top_motif(rated, AT_LEAST).withColumn("strength", F.round("strength", 4))


@query("w17_consensus_profile")
def w17(spark, sf):
    cells = X.motif_probs(spark, sf)
    clusters = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("motif_id"), F.col("label").cast("long").alias("cluster"))
    return r6(L.consensus_profile(cells, clusters, L.pairs_inside(cells, clusters)), *LETTERS)


@query("w18_merge_motifs")
def w18(spark, sf):
    sites = lambda odds: D.motif_genes(X.sequences(spark, sf), odds, FRACTION)
    return r6(L.merge_motifs(X.motif_probs(spark, sf), targets(spark, sf), sites, HEIGHT, True, BITS), *LETTERS)


@query("w19_missing_clusters", f"""{_SPEC}, c AS ({_SIZES}), done AS (SELECT cluster FROM c JOIN spec USING (motif_id) GROUP BY 1 HAVING max(-ln_p / ln(10.0::DOUBLE)) >= {AT_LEAST}::DOUBLE)
SELECT DISTINCT cluster FROM c WHERE cluster NOT IN (SELECT cluster FROM done)""")
def w19(spark, sf):
    clusters = label_clusters(spark, sf)
    rated = specificity(spark, sf).join(clusters, "motif_id")
    return W.missing_clusters(clusters, W.top_motif(rated, AT_LEAST))


@query("w20_scan_motifs", f"""WITH {X.PROBS}, {X.SEQ}, {X.windows_sql(X.WIDTH)}, {_SITES}
SELECT motif_id, dir, sum(n)::BIGINT AS sites, count(DISTINCT gene) AS genes, round(max(score), 6) AS best FROM seen JOIN sites USING (word) GROUP BY 1, 2""")
def w20(spark, sf):
    found = D.scan_motifs(X.sequences(spark, sf), logodds(spark, sf), FRACTION)
    return found.groupBy("motif_id", "dir").agg(
        F.count("*").alias("sites"), F.countDistinct("gene").alias("genes"), X.r6(F.max("score")).alias("best"))
