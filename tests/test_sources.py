"""Readers and writers on small files."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators.sequences import literal_starts
from lociframe.sources import converters as K
from lociframe.sources import cytosines, reads, tracks


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


@pytest.mark.parametrize("split", [None, 64])
def test_fastq(spark, tmp_path, split):
    recs = [(f"r{i}", "ACGT" * (1 + i % 3), "@+I@" * (1 + i % 3)) for i in range(40)]
    path = put(tmp_path, "a.fastq", "".join(f"@{n} x\n{s}\n+{n if i % 2 else ''}\n{q}\n" for i, (n, s, q) in enumerate(recs)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:  # one file read in many splits keeps its line numbers
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = sorted(map(tuple, reads.read_fastq(spark, path).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(recs)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">chr1 first\nACGT\nAC\n>chr2\nGG\n")
    assert sorted(map(tuple, reads.read_fasta(spark, path).collect())) == [("chr1", "ACGTAC"), ("chr2", "GG")]


def test_wig(spark, tmp_path):
    path = put(tmp_path, "a.wig", "track type=wiggle_0\nvariableStep chrom=chr1\n5\t2.5\n9\t3\nfixedStep\tchrom=chr2 start=10 step=5\n1\n2\nvariableStep chrom=chr3 span=4\n7 8\n")
    got = sorted(map(tuple, tracks.read_wig(spark, path).collect()))
    assert got == [("chr1", 5, 2.5, 1), ("chr1", 9, 3.0, 1), ("chr2", 10, 1.0, 1), ("chr2", 15, 2.0, 1), ("chr3", 7, 8.0, 4)]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_wig_of_many_splits(spark, tmp_path, small_splits):
    """One header over thousands of values, then many short blocks; comments don't count as steps."""
    rng = random.Random(1)
    text, want = ["track type=wiggle_0", "# note", "7", "fixedStep chrom=chr1 start=101 step=3 span=2"], []
    for k in range(40_000):
        if k % 997 == 0:
            text.append("# a comment")
        text.append(f"{k % 50 / 2}")
        want.append(("chr1", 101 + 3 * k, k % 50 / 2, 2))
    for b in range(900):
        start, fixed = rng.randrange(1, 10**6), b % 2
        text.append(f"fixedStep chrom=c{b} start={start} step=10" if fixed else f"variableStep chrom=c{b} span=5")
        for k in range(rng.randrange(4)):
            text.append(str(k) if fixed else f"{start + k} {k}")
            want.append((f"c{b}", start + (10 * k if fixed else k), float(k), 1 if fixed else 5))
    path = put(tmp_path, "big.wig", "\n".join(text) + "\n")
    got = tracks.read_wig(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("step", [None, 1, 4])
def test_wig_round_trip(spark, tmp_path, step):
    rng = random.Random(2)
    rows = sorted({(f"chr{rng.randrange(3)}", p, rng.randrange(9) / 4) for p in rng.sample(range(1, 120_000, 4), 900)} | {("chr9", p, 0.5) for p in range(16_300, 16_500, 4)})
    rows = list({(c, p): (c, p, x) for c, p, x in rows}.values())
    lines = tracks.wig_lines(spark.createDataFrame(rows, "chrom string, p int, x double"), "p", F.col("x"), step)
    tracks.write_wig(lines, str(tmp_path / "out"))
    assert sorted(map(tuple, tracks.read_wig(spark, str(tmp_path / "out")).collect())) == sorted((*r, 1) for r in rows)


def test_fasta_in_pieces(spark, tmp_path, small_splits):
    rng = random.Random(3)
    seqs = {f"s{i}": "".join(rng.choices("ACGTcg", k=n)) for i, n in enumerate([0, 1, 2, 99, 100, 101, 5000, 60_000])}
    text = "".join(f">{name} note\n" + "".join(s[i : i + w] + "\n" for i in range(0, len(s), w)) + "\n" * (w % 2) for (name, s), w in zip(seqs.items(), [60, 60, 1, 7, 50, 33, 61, 60]))
    path = put(tmp_path, "a.fa", "stray\n" + text)
    for size, halo in ((100, 0), (100, 1), (100, 250), (1 << 14, 3)):
        got = {(r.seq_name, r.offset): r.seq for r in reads.read_fasta_pieces(spark, path, halo, size).collect()}
        assert got == {(n, k): s[k : k + size + halo] for n, s in seqs.items() for k in range(0, len(s), size)}
    found = literal_starts(reads.read_fasta_pieces(spark, path, 1, 100), "CG", 100)
    want = {(n, i + 1) for n, s in seqs.items() for i in range(len(s)) if s[i : i + 2].upper() == "CG"}
    assert sorted((r.seq_name, r.pos) for r in found.collect()) == sorted(want)
    with pytest.raises(ValueError):
        literal_starts(found, "CGC", 100)


def test_bed_and_gff(spark, tmp_path):
    path = put(tmp_path, "a.bed", "track name=x\nchr1\t9\t20\tf1\t3\t+\nchr2\t0\t5\tf2\t1\t-\n")
    bed = tracks.read_bed(spark, path)
    assert sorted((r.chrom, r.start_pos, r.end_pos) for r in bed.collect()) == [("chr1", 10, 20), ("chr2", 1, 5)]
    tracks.write_bed(bed, str(tmp_path / "out"))
    again = tracks.read_bed(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, bed.collect()))
    gff = put(tmp_path, "a.gtf", '#c\nchr1\tsrc\texon\t5\t9\t.\t+\t.\tgene_id "g1"; tag "a"; tag "b";\nchr1\tsrc\texon\t6\t7\t1.5\t-\t0\tID=x;Name=y\n')
    rows = {r.start_pos: r for r in tracks.read_gff(spark, gff).collect()}
    assert rows[5].attributes == {"gene_id": ["g1"], "tag": ["a", "b"]} and rows[5].score is None
    assert rows[6].attributes == {"ID": ["x"], "Name": ["y"]} and rows[6].score == 1.5


def test_sam_flags_and_filter(spark, tmp_path):
    line = "{n}\t{f}\tchr1\t{p}\t30\t4M\t=\t{m}\t0\tACGT\tIIII\tMD:Z:4\n"
    rows = [("ok", 3 | 64, 10, 50), ("unmapped", 4, 10, 0), ("second", 3 | 16 | 32 | 128, 10, 10), ("first", 3 | 16 | 32 | 64, 10, 10),
            ("badmate", 1 | 64, 10, 90), ("dup", 1024, 10, 0), ("secondary", 256, 10, 0), ("lone", 16, 12, 0)]
    path = put(tmp_path, "a.sam", "@HD\tVN:1\n" + "".join(line.format(n=n, f=f, p=p, m=m) for n, f, p, m in rows))
    sam = reads.read_sam(spark, path)
    keep = {r.read_name for r in sam.filter(reads.usable(remove_dups=True)).collect()}
    assert keep == {"ok", "first", "lone"}
    assert {r.md for r in sam.collect()} == {"4"}


def test_pileup_lines(spark, tmp_path):
    path = put(tmp_path, "p.txt", "chr1\t714070\tG\t1\t@,\t@I\t@S\t25,\nchr1\t714071\tA\t3\t@.Ct\t@I5!\t@SSS\t1,2,30,\nchr1\t714072\tA\t0\t@\t@\t@\n")
    got = reads.explode_pileup(reads.read_pileup(spark, path))
    assert sorted((r.pos, r.read_index, r.strand, r.base, r.qual, r.cycle) for r in got.collect()) == [
        (714070, 1, "+", "G", 40, 25), (714071, 1, "-", "A", 40, 1), (714071, 2, "+", "C", 20, 2), (714071, 3, "-", "T", 0, 30)]


def test_cytosine_table(spark, tmp_path):
    d = spark.range(100).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("sample"), F.lit("chr1").alias("chrom"),
                                F.col("id").cast("int").alias("chrom_pos"), F.lit(3).cast("bigint").alias("c_reads"), F.lit(1).cast("bigint").alias("t_reads"))
    cytosines.write_table(d, str(tmp_path / "t"))
    back = cytosines.scan(cytosines.read_table(spark, str(tmp_path / "t")), ["A"], [("chr1", 10, 20)], min_ct=4)
    assert back.count() == 6
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().executedPlan().toString() or back.count() == 6


def test_reference_string(spark):
    rows = [("ACGTA", "5M", "2T2"), ("ACGGTA", "2M2I2M", "4"), ("ACTA", "2M2D2M", "2^GG2"), ("TTACG", "2S3M", "1A1")]
    d = spark.createDataFrame(rows, "seq string, cigar string, md string")
    read, ref = K.reference_string(F.col("seq"), F.col("cigar"), F.col("md"))
    got = [tuple(r) for r in d.select(read.alias("a"), ref.alias("b")).collect()]
    assert got == [("ACGTA", "ACTTA"), ("ACGGTA", "AC--TA"), ("AC--TA", "ACGGTA"), ("ACG", "AAG")]


def test_psl_insertions(spark):
    d = spark.createDataFrame([("q", "0,10,25,", "10,12,5,")], "q_name string, q_starts string, block_sizes string")
    assert [tuple(r) for r in K.psl_insertions(d).collect()] == [("q", 22, 3)]
