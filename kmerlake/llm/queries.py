"""Registered queries of the text operators over the whole given tables, with SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from kmerlake.llm import bpe, fertility, langid, mixing, phrases, pii, quality, simhash, suffix, topk, toxicity, urls, whitening
from kmerlake.llm.common import id_remainder, table, tokenizer_path

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@query("op1_simhash")
def op1(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4, keep=["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_topk", """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT q.r AS qr, q.vec_id AS query_id, x.vec_id AS vec_id, x.r AS xr, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.r <> x.r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, xr)::INTEGER AS rank FROM c)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20""")
def op3(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder(3) == 1)
    langs, prototypes = langid.learn_prototypes(docs.where("not held_out"))
    return langid.identify(docs, langs, prototypes, keep=["doc_id", "held_out"])


@query("op5_quality_rules")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder(5) == 0)
    model = quality.fit_rules(docs.where("not held_out"), table(spark, sf_dir, "labels"), "quality")
    return quality.score(docs, model, keep=["doc_id", "held_out"])


@query("op10_bpe")
def op10(spark, sf_dir):
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: Rules (host, path, verdict) of the URL query.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op6_url_filter", f"""
WITH rules(rh, rp, rv) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
p AS (SELECT row_number() OVER () AS id, page_id, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
fit AS (SELECT id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM p JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (id)""")
def op6(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


MIX_ENTROPY, MIX_REPEATS, MIX_BLOCK = 0.998, 2.0, 250_000


@query("op9_temperature_mixing", f"""
WITH d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM documents),
t AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY 1),
s AS (SELECT source, tokens, whole, tokens::DOUBLE / whole AS share FROM t, (SELECT sum(tokens)::BIGINT AS whole FROM t) WHERE tokens > 0),
g AS (SELECT i, share, w / sum(w) OVER (PARTITION BY i) AS w FROM (SELECT i, share, pow(share, i / {mixing.STEPS}::DOUBLE) AS w FROM s, range(0, {mixing.STEPS} + 1) r(i))),
m AS (SELECT i, CASE WHEN count(*) > 1 THEN sum(-w * ln(w)) / ln(count(*)) ELSE 1 END AS entropy, max(w / share) AS repeat FROM g GROUP BY i),
e AS (SELECT coalesce(max(i), 0) AS i FROM m WHERE entropy >= {MIX_ENTROPY}),
x AS (SELECT coalesce(min(m.i), {mixing.STEPS}) AS i FROM m, e WHERE m.i >= e.i AND repeat <= {MIX_REPEATS}),
plan AS (SELECT source, tokens, round(whole * (p / sum(p) OVER ())) AS budget, ceil(tokens / {MIX_BLOCK}::DOUBLE)::BIGINT AS blocks
  FROM (SELECT *, pow(share, (SELECT i FROM x) / {mixing.STEPS}::DOUBLE) AS p FROM s)),
b AS (SELECT doc_id, d.source, id, n, budget, tokens, coalesce(hash % blocks, hash % 1024) AS block
  FROM (SELECT *, ('0x' || substr(md5(id), 1, 8))::BIGINT AS hash FROM d) d LEFT JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
c AS (SELECT *, round(budget * held / tokens)::BIGINT AS due FROM (SELECT *, sum(n) OVER (PARTITION BY source, block)::BIGINT AS held FROM b)),
f AS (SELECT *, CASE WHEN held > 0 THEN due // held ELSE 1 END AS fu, CASE WHEN held > 0 THEN due % held ELSE 0 END AS rest FROM c),
p AS (SELECT *, unnest(range(1, greatest(1, fu + (rest > 0)::BIGINT) + 1)) AS epoch FROM f),
o AS (SELECT *, row_number() OVER w AS slot, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) - n AS done FROM p
  WINDOW w AS (PARTITION BY source, block, epoch ORDER BY md5(id || ':' || epoch), id))
SELECT doc_id, source, n AS n_tokens, epoch, block, slot FROM o
WHERE epoch <= fu OR (epoch = fu + 1 AND rest > 0 AND 2 * done + n <= 2 * rest)""")
def op9(spark, sf_dir):
    return mixing.mix_sources(
        table(spark, sf_dir, "documents"), MIX_ENTROPY, MIX_REPEATS, block_tokens=MIX_BLOCK, keep=["doc_id", "source"])


@query("op7_tokeniser_fertility")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return fertility.quality_rules(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"])


@query("op8_pii")
def op8(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    listed = lambda kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    words = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(listed([k])).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(words(listed(pii.BASE)).cast("binary"), 256).alias("base_sha256"), words(F.col("pii")).alias("spans"))


@query("op12_phrase_collocations", """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM w, range(1, 6) r(m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
i AS (SELECT lang, a, unnest(range(2, m)) AS k, w, m FROM s),
h AS (SELECT lang, array_to_string(w[j : j + k - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - k + 2)) AS j FROM i) GROUP BY ALL),
c AS (SELECT s.*, unnest(range(1, m)) AS k FROM s LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
x AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 :], ' ')
  JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY rank <= 2000""")
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


@query("op11_whitening")
def op11(spark, sf_dir):
    """``deviation`` is null where 64 bits do not hold it (some 400,000 vectors on); ``deviation_digits`` has it up to 38 digits."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024.0, shift=100_000)
    return found.select(
        "vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error",
        F.col("deviation").alias("deviation_digits"))


@query("op13_toxicity")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_remainder(4) == 2)
    model = toxicity.fit(docs.where("not held_out"), table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])
