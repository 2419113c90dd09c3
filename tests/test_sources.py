"""Text readers on hand-made files."""

import random

from pyspark.sql import functions as F

from kmerlake.operators import motifs as W
from kmerlake.sources import motif_text as T
from kmerlake.sources import text as S


def test_fasta(spark, tmp_path):
    (tmp_path / "pos.fa").write_text(">g1 first > second\nACGT\nAC\r\nGG\n>g2\nTTTT\n>g1 again\nCCCC\n")
    (tmp_path / "neg.fa").write_text(">g2\nAAAA\n>g3\nGG\n")
    pos, neg = (S.read_fasta(spark, str(tmp_path / f), c) for f, c in (("pos.fa", 1), ("neg.fa", 0)))
    rows = sorted((r["gene"].split("#")[0], r["class"], r["seq"]) for r in pos.collect())
    assert rows == [("g1", 1, "ACGTACGG"), ("g1", 1, "CCCC"), ("g2", 1, "TTTT")]
    assert pos.select("gene").distinct().count() == 3  # records that share an id count each
    last = S.read_fasta(spark, str(tmp_path / "pos.fa"), 1, keep="last")
    assert sorted(map(tuple, S.sequence_set(last, neg).collect())) == [("g1", 1, "CCCC"), ("g2", 0, "AAAA"), ("g3", 0, "GG")]


def test_block_map_over_many_splits(spark, tmp_path):
    random.seed(1)
    lines, want = [], []
    for n in range(40):
        kmer = f"K{n}"
        lines.append(f"{n}\t{kmer}\t0.1")
        for m in range(random.randint(0, 60)):
            lines.append(f"AT{m}\t{n}\t{m}\t+\trest")
            want.append((kmer, f"AT{m}:{n}:{m}:+"))
    (tmp_path / "pos_0.9max.out.pvalue").write_text("\n".join(lines) + "\n")
    (tmp_path / "neg_0.9max.out.pvalue").write_text("1\tKX\nAT1\t1\t2\t-\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted(map(tuple, S.read_block_map(spark, str(tmp_path), "pos").collect()))
        numbered = S.number_lines(S.read_lines(spark, str(tmp_path / "pos_0.9max.out.pvalue"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(want)
    assert [r.value for r in sorted(numbered, key=lambda r: r.pos)] == lines


def test_diversity_and_families(spark, tmp_path):
    (tmp_path / "div.txt").write_text(
        "Region\tNtDiversity\nchr1_5_9_AT1G_x|promoter|AAC\tNoDiffSites\nchr2_1_2_g|up|CCG\t0.25\nchr2_1_2_g|up|CCG\tbad\n")
    rows = sorted(((r.gene, r.start, r.kmer, r.nt_div) for r in S.read_diversity(spark, str(tmp_path / "div.txt")).collect()), key=str)
    assert rows == sorted([("AT1G_x", 5, "AAC", 0.0), ("g", 1, "CCG", 0.25), ("g", 1, "CCG", None)], key=str)
    (tmp_path / "fam.txt").write_text("# note\nTF1\ta\tb\tMYB\n\nTF2\ta\tb\tbZIP\n")
    assert sorted(map(tuple, S.read_family_index(spark, str(tmp_path / "fam.txt")).collect())) == [(0, "TF1", "MYB"), (1, "TF2", "bZIP")]


def test_matrix_and_hits(spark, tmp_path):
    (tmp_path / "m.txt").write_text("Gene\tClass\tA.T\tAA CC\ng1\tpos\t1\t0\ng2\tneg\t0\t1\n")
    matrix = S.read_matrix(spark, str(tmp_path / "m.txt"))
    assert sorted(map(tuple, S.matrix_to_long(matrix).collect())) == [("g1", "pos", "A.T", 1.0), ("g2", "neg", "AA CC", 1.0)]
    (tmp_path / "h.txt").write_text('chr1\tg1\tAAC\t3\t5\t.\t+\t.\tid="x";overlap=NA\n')
    assert S.read_hits(spark, str(tmp_path / "h.txt")).select("gene", "end", "details").first() == ("g1", 5, 'id="x";overlap=NA')
    (tmp_path / "x_imp.txt").write_text("AAC\t0.5\n")
    (tmp_path / "other.txt").write_text("zzz\t0.5\n")
    assert [tuple(r)[1:] for r in S.read_importance(spark, str(tmp_path)).collect()] == [("AAC", 0.5)]


def test_distance_table_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("note\nTF1\tTF2\n0.1\t0.2\n0.3\tnan\n")
    got = sorted(map(tuple, S.read_distance_table(spark, str(tmp_path / "a.txt")).collect()))
    assert got == [(0, "TF1", "0.1"), (0, "TF2", "0.2"), (1, "TF1", "0.3"), (1, "TF2", "nan")]
    (tmp_path / "b.txt").write_text("0.1\t0.2\n0.3\t0.4\n")
    names = spark.createDataFrame([(0, "A"), (1, "B")], "pos long, name string")
    table = S.read_distance_table(spark, str(tmp_path / "b.txt"), names)
    assert sorted(map(tuple, table.collect())) == [(0, "A", "0.1"), (0, "B", "0.2"), (1, "A", "0.3"), (1, "B", "0.4")]
    rows = W.attach_names(table.withColumnRenamed("name", "column"), names).where("pos = 1")
    assert {tuple(r) for r in rows.select("name", "column", "cell").collect()} == {("B", "A", "0.3"), ("B", "B", "0.4")}


MOTIFS = """Log-odds matrix for Motif   0 ..tA (1)
#        0         1
#A     0.125     1.250
#C    -0.500    -2.000
#T     0.875     0.750
#G    -1.500    -0.250
Sequence Logo
#  --
Motif   0 ..tA (1)            (Bits:  1.50  MAP:  0.00   D: 0.000  -1) E:  0.000
TA 0 2.125
CG 0 -0.75
**********
MAP Score: 0.000000
Log-odds matrix for Motif   1 A (1)
#        0
#A     1.000
#C    -1.000
#T     0.000
#G     2.000
"""


def test_motif_text(spark, tmp_path):
    (tmp_path / "m.tm").write_text(MOTIFS)
    cells = T.read_motifs(spark, str(tmp_path / "m.tm"))
    assert sorted(map(tuple, cells.collect())) == [
        (0, "..tA", 0, 0.125, -0.5, -1.5, 0.875), (0, "..tA", 1, 1.25, -2.0, -0.25, 0.75), (1, "A", 0, 1.0, -1.0, 2.0, 0.0)]
    assert sorted(map(tuple, T.read_motif_sites(spark, str(tmp_path / "m.tm")).collect())) == [(0, 0, "TA", 2.125), (0, 1, "CG", -0.75)]
    text = T.transfac_text(cells.where("motif_id = 1")).first().value
    assert text == "DE\tA\tA\n0\t200\t50\t400\t100\t\nXX"
    T.write_transfac(cells, str(tmp_path / "tf"))
    back = {(r.name, r.pos): (r.a, r.c, r.g, r.t) for r in T.read_transfac(spark, str(tmp_path / "tf")).collect()}
    assert back["A", 0] == (200.0, 50.0, 400.0, 100.0) and len(back) == 3


def test_transfac_by_hand(spark, tmp_path):
    (tmp_path / "x.tf").write_text("DE\tm1\tm1\n0\t10\t0\t5\t5\t\n1\t1\t2\t3\t4\t\nXX\nDE\tm2\tm2\n0\t7\t7\t7\t7\t\nXX\n")
    cells = T.read_transfac(spark, str(tmp_path / "x.tf"))
    assert sorted(map(tuple, cells.collect())) == [
        ("m1", 0, 10.0, 0.0, 5.0, 5.0), ("m1", 1, 1.0, 2.0, 3.0, 4.0), ("m2", 0, 7.0, 7.0, 7.0, 7.0)]
    assert W.pwm_from_counts(cells).count() == 3


def test_block_map_carries_kmers_over_batches_without_a_sort(spark, tmp_path):
    from kmerlake.sources import text as S

    lines = ["g0\t1\t2\t+", "1\tAA", "g1\t1\t2\t+", "g2\t3\t4\t-\tx", "g3\t5\t6\t-", "2\tCC", "", "g4\t1\t2\t+", "3\tGG", "4\tTT", "g5\t7\t8\t+"]
    for name in ("a", "b"):
        (tmp_path / name).write_text("\n".join(lines[1:] if name == "a" else lines) + "\n")
    want = [("AA", "g1:1:2:+"), ("AA", "g2:3:4:-"), ("AA", "g3:5:6:-"), ("CC", "g4:1:2:+"), ("TT", "g5:7:8:+")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = S.read_block_map(spark, str(tmp_path))
            assert sorted(tuple(r) for r in got.collect()) == sorted(2 * want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # that of the blocks


def test_split_and_packed_tables(spark, tmp_path):
    from kmerlake.sources import sinks as O

    rows = spark.range(100).selectExpr("id", "concat('m', id % 3) AS mark").repartition(2)
    O.write_split(rows, str(tmp_path / "s"), "mark", 3)
    O.write_table(rows, str(tmp_path / "t"), packed=True)
    assert list((tmp_path / "s").glob("mark=m1/*.gz")) and list((tmp_path / "t").glob("*.gz"))
    assert sorted(int(r[0]) for r in spark.read.csv(str(tmp_path / "s/mark=m1")).collect()) == list(range(1, 100, 3))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 100


def test_range_of_a_text_without_a_sort_of_the_rows(spark):
    rows = spark.range(1000).selectExpr("cast(id % 2 AS int) AS class", "if(id % 7 = 0, null, concat('K', id % 5)) AS kmer", "concat('g', id, ':1') AS locus").repartition(3)
    got = S.text_range(rows, ["class", "kmer"], "locus")
    want = rows.groupBy("class", "kmer").agg(F.count("*").alias("n"), F.min("locus").alias("first_locus"), F.max("locus").alias("last_locus"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_wanted_kmers_are_sent_to_the_loci(spark):
    from kmerlake.operators import criteria as C

    pos, neg = (spark.range(50).selectExpr(f"concat('K', id % 4) AS kmer", f"concat('{x}', id) AS locus") for x in "pn")
    kmers = spark.range(200).selectExpr("concat('K', id % 2) AS kmer").groupBy("kmer").agg(F.count("*").alias("n"))
    got = C.map_loci(pos, neg, kmers)
    assert got.count() == 52 and "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
