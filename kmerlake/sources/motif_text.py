"""Motif matrices in log-odds text (one block per motif) and in TRANSFAC text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = ("a", "c", "g", "t")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "Log-odds matrix for Motif").text(path)
    head = r"^\s+(\d+) (\S+)"
    return raw.where(F.col("value").rlike(head)).select(
        F.regexp_extract("value", head, 1).cast("long").alias("motif_id"),
        F.regexp_extract("value", head, 2).alias("name"),
        "value",
    )


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """Log-odds cells (motif_id, name, pos, a, c, g, t) of a motif text file."""
    def row(letter: str):
        text = F.regexp_extract("value", rf"(?m)^#{letter.upper()}\s+(.*)$", 1)
        return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("double"))

    zipped = F.arrays_zip(*[row(x).alias(x) for x in LETTERS])
    cells = _blocks(spark, path).select("motif_id", "name", F.posexplode(zipped).alias("pos", "cell"))
    return cells.select("motif_id", "name", "pos", *[F.col("cell")[x].alias(x) for x in LETTERS])


def read_motif_sites(spark: SparkSession, path: str) -> DataFrame:
    """The aligned sites listed under each motif: (motif_id, site_no, site, score)."""
    line = r"(?m)^([A-Za-z]+) (\d+) (-?[0-9.]+)\s*$"
    part = lambda group: F.regexp_extract_all("value", F.lit(line), group)
    zipped = F.arrays_zip(part(1).alias("site"), part(3).alias("score"))
    sites = _blocks(spark, path).select("motif_id", F.posexplode(zipped).alias("site_no", "s"))
    return sites.select("motif_id", "site_no", F.col("s")["site"].alias("site"), F.col("s")["score"].cast("double").alias("score"))


def _one_text_per_motif(cells: DataFrame, line, head, tail: str) -> DataFrame:
    """One row of text per motif; a group holds no more rows than the motif has positions."""
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return cells.groupBy("motif_id", "name").agg(rows.alias("rows")).select(
        "motif_id",
        F.concat(head, F.lit("\n"), F.concat_ws("\n", F.col("rows")["line"]), F.lit("\n" + tail)).alias("value"),
    )


def write_motifs(cells: DataFrame, path: str, decimals: int = 3) -> None:
    """Write log-odds cells in the text form that ``read_motifs`` takes."""
    per_motif = cells.groupBy("motif_id", "name").agg(
        F.array_sort(F.collect_list(F.struct("pos", *LETTERS))).alias("rows"))

    def row(letter: str):
        numbers = F.transform("rows", lambda r: F.format_string(f"%9.{decimals}f", r[letter]))
        return F.concat(F.lit(f"#{letter.upper()} "), F.concat_ws(" ", numbers))

    matrix = [row(x) for x in ("a", "c", "t", "g")]
    header = F.concat(F.lit("Log-odds matrix for Motif "), F.format_string("%3d", "motif_id"), F.lit(" "),
                      F.col("name"), F.lit(" (1)"))
    index = F.concat(F.lit("#  "), F.concat_ws(" ", F.transform("rows", lambda r: r["pos"].cast("string"))))
    per_motif.select("motif_id", F.concat_ws("\n", header, index, *matrix).alias("value")).orderBy(
        "motif_id").select("value").write.text(path)


def transfac_text(cells: DataFrame) -> DataFrame:
    """(motif_id, value): ``DE`` block of int(2^log-odds · 100) in the order A, C, G, T."""
    line = F.concat(
        F.col("pos").cast("string"), F.lit("\t"),
        *[F.concat(F.floor(F.pow(F.lit(2.0), F.col(x)) * 100).cast("string"), F.lit("\t")) for x in LETTERS])
    head = F.concat(F.lit("DE\t"), F.col("name"), F.lit("\t"), F.col("name"))
    return _one_text_per_motif(cells, line, head, "XX")


def default_names(cells: DataFrame, source: str) -> DataFrame:
    """Motifs without a name get ``<file>_<n>``, n counted from 1."""
    return cells.withColumn("name", F.when(
        F.coalesce(F.col("name"), F.lit("")) == "",
        F.concat(F.lit(source + "_"), (F.col("motif_id") + 1).cast("string"))).otherwise(F.col("name")))


def write_transfac(cells: DataFrame, path: str) -> None:
    transfac_text(cells).orderBy("motif_id").select("value").write.text(path)


def read_transfac(spark: SparkSession, path: str) -> DataFrame:
    """Count cells (name, pos, a, c, g, t) from ``DE`` … ``XX`` blocks."""
    raw = spark.read.option("lineSep", "\nXX").text(path)
    number = r"[ \t]+([0-9.eE+-]+)"
    line = r"(?m)^[ \t]*(\d+)" + number * 4
    part = lambda group: F.regexp_extract_all("value", F.lit(line), group)
    zipped = F.arrays_zip(*[part(i + 2).alias(x) for i, x in enumerate(LETTERS)])
    cells = raw.where(F.col("value").rlike(r"(?m)^DE\s")).select(
        F.regexp_extract("value", r"(?m)^DE\s+(\S+)", 1).alias("name"), F.posexplode(zipped).alias("pos", "cell"))
    return cells.select("name", "pos", *[F.col("cell")[x].cast("double").alias(x) for x in LETTERS])
