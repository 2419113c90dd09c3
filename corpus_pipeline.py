"""From raw documents to token ids: quality, near-duplicates, personal data, source mix, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``. Empty tables pass through; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.llm import bpe, mixing, pii, quality, simhash
from kmerlake.llm.common import id_remainder, stored, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: words in a shingle and bits in which two linked fingerprints may differ.
WIDTH, RADIUS = 4, 4
TARGET_ENTROPY, MAX_REPEATS = 0.9, 2.0


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject; every fifth id is left out of learning."""
    learned = docs.where(id_remainder(5) != 0)
    model = quality.fit_rules(learned, table(spark, sf_dir, "labels"), "quality")
    return quality.score(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates by SimHash, of rows with and without an id.

    Rows are told apart by all their columns, not by their id. Of a group stays the least id that no other row has, else a row
    without an id, else the least of the shared ids: rows go to the operator under the struct that sorts this way.
    """
    keyed = docs.select(*COLUMNS, F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in COLUMNS]))).alias("_key"))
    ids = stored(keyed.select("_key", "doc_id").distinct(), "pipeline-ids")
    shared = stored(ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(2).alias("_rank")), "pipeline-shared")
    ranked = keyed.select("_key", "doc_id", "text").join(shared, "doc_id", "left")
    rank = F.coalesce("_rank", F.when(F.col("doc_id").isNull(), 1).otherwise(0)).alias("rank")
    found = simhash.near_duplicates(ranked.select(F.struct(rank, "doc_id", "_key").alias("doc_id"), "text"), WIDTH, RADIUS, keep=["doc_id"])
    kept = stored(found.where("doc_id = component_id").select("doc_id._key").distinct(), "pipeline-kept")
    return keyed.dropDuplicates(["_key"]).join(kept, "_key", "left_semi").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.find_pii(docs, redacted="text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by source at the tempered weights; some more than once, some not at all."""
    return mixing.mix_sources(docs, TARGET_ENTROPY, MAX_REPEATS).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit) and whether they decode to the text."""
    coded = bpe.encode_decode(docs, tokenizer_path(), keep=["doc_id", "lang", "source"], compare=True)
    return coded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality", keep_good), ("near_dedup", keep_one_of_each), ("pii", redact), ("mixing", mix), ("bpe", encode)]

#: No SQL says the trained and hashed stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
