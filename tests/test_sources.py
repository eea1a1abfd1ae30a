import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixforge.operators import reads as R
from helixforge.operators.kmers import minhash
from helixforge.options import Options
from helixforge.plans.correction import sketch
from helixforge.sources import reads as S
from helixforge.sources import sinks
from helixforge.streaming import incremental


def fastq(n, seed=1, length=30):
    rng = random.Random(seed)
    return [(f"r{i} a", "".join(rng.choice("ACGTN") for _ in range(length)), "".join(chr(33 + rng.randrange(41)) for _ in range(length))) for i in range(n)]


@pytest.mark.parametrize("zipped,name", [(False, "a.fq"), (True, "a.fq.gz"), (True, "a.fq")])
def test_fastq_is_read_in_order_from_many_splits(spark, tmp_path, zipped, name):
    rows, path = fastq(500), str(tmp_path / name)
    if zipped:
        with gzip.open(path, "wt") as f:
            f.write("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows))
    else:
        with open(path, "w") as f:
            f.write("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = S.read_files(spark, [path, path]).orderBy("read_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == [(i, *x) for i, x in enumerate(rows + rows)]
    assert S.file_format(spark, path) == "FASTQ" + "GZ" * zipped


def test_fasta_of_several_lines(spark, tmp_path):
    a, b = str(tmp_path / "a.fa"), str(tmp_path / "b.fa")
    open(a, "w").write(">x one\nacg\nTTT\n>y\nA\n")
    open(b, "w").write(">z\nGG\n")
    got = S.read_files(spark, [a, b]).orderBy("read_id").collect()
    assert [tuple(r) for r in got] == [(0, "x one", "ACGTTT", None), (1, "y", "A", None), (2, "z", "GG", None)]
    assert S.file_format(spark, a) == "FASTA"
    assert [r.sequence for r in S.read_genome(spark, a).orderBy("read_id").collect()] == ["ACGTTT", "A"]


def test_mixed_files_are_an_error_and_an_empty_one_has_no_qualities(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    open(a, "w").write("@x\nA\n+\nI\n")
    open(b, "w").write(">x\nA\n")
    open(c, "w").write("")
    with pytest.raises(ValueError):
        S.read_files(spark, [a, b])
    assert not S.has_quality(spark, c)
    open(c, "w").write(">x\nA\n@y\nA\n+\nI\n")
    with pytest.raises(ValueError):
        S.has_quality(spark, c)


@pytest.mark.parametrize("kind", ["FASTA", "FASTQ", "FASTAGZ", "FASTQGZ"])
def test_reads_are_written_and_read_again(spark, tmp_path, kind):
    rows = fastq(100)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "read_id long, header string, sequence string, quality string")
    sinks.write_reads(df, str(tmp_path / "out"), kind, 3)
    paths = sorted(str(p) for p in (tmp_path / "out").glob("part-*"))
    back = S.read_files(spark, paths).orderBy("read_id").collect()
    assert [(r.header, r.sequence) for r in back] == [x[:2] for x in rows]
    assert [r.quality for r in back] == [x[2] if kind.startswith("FASTQ") else None for x in rows]
    with pytest.raises(ValueError):
        sinks.write_reads(df, str(tmp_path / "no"), "NONE")


def test_kmer_dump_pairs_and_concatenation(spark, tmp_path):
    df = spark.createDataFrame([("ACG", 3), ("TTT", 1)], "kmer string, count long")
    sinks.write_kmers(df.coalesce(1), str(tmp_path / "k"))
    assert sorted(tuple(r) for r in S.read_kmer_dump(spark, str(tmp_path / "k")).collect()) == [("ACG", 3), ("TTT", 1)]
    one = spark.createDataFrame([(0, "A"), (1, "C")], "read_id long, sequence string")
    two = spark.createDataFrame([(0, "G"), (1, "T")], "read_id long, sequence string")
    assert [r.sequence for r in S.interleave(one, two).orderBy("read_id").collect()] == ["A", "G", "C", "T"]
    assert [r.sequence for r in S.concat([one, two]).orderBy("read_id").collect()] == ["A", "C", "G", "T"]


def test_features_are_sampled_by_value(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.col("id") * 0.5)
    sinks.write_features(df, str(tmp_path / "a"), 0.1)
    sinks.write_features(df.repartition(7), str(tmp_path / "b"), 0.1)
    a, b = (sorted(r.value for r in spark.read.text(str(tmp_path / n)).collect()) for n in "ab")
    assert a == b and 50 < len(a) < 200


def test_saved_reads_prune_ids(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("read_id"), F.lit("ACGT").alias("sequence"))
    sinks.save_reads(df, str(tmp_path / "r"))
    some = R.id_range(sinks.load_reads(spark, str(tmp_path / "r")), 10, 20)
    plan = some._jdf.queryExecution().toString()
    assert some.count() == 10 and "PushedFilters: [IsNotNull(read_id), GreaterThanOrEqual(read_id,10), LessThan(read_id,20)]" in plan


def test_derived_reads_have_the_stated_errors(spark):
    docs = spark.createDataFrame([(3, "abc" * 100), (4, "é1 a"), (5, None)], "doc_id long, text string")
    perfect = {r.read_id: r.sequence for r in S.perfect(docs).collect()}
    assert sorted(perfect) == [3 * S.SPAN, 3 * S.SPAN + 1, 3 * S.SPAN + 2] and perfect[3 * S.SPAN][:6] == "ACGACG"
    for r in S.original(S.perfect(docs)).collect():
        want = "".join("CGTA"["ACGT".index(c)] if (r.read_id * 31 + i * 17) % 97 == 0 else c for i, c in enumerate(perfect[r.read_id], 1))
        assert r.sequence == want and r.quality == "".join(chr((r.read_id + i) % 41 + 33) for i in range(1, 101))


def test_stream_is_counted_and_corrected(spark, tmp_path):
    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(i, genome[j : j + 60]) for i, j in enumerate(rng.randrange(340) for _ in range(200))]
    index = spark.createDataFrame(rows, "read_id long, sequence string")
    bad = [(1000 + i, s[:30] + ("A" if s[30] != "A" else "C") + s[31:]) for i, s in rows[:20]]
    spark.createDataFrame(bad, "read_id long, sequence string").write.parquet(str(tmp_path / "in"))
    options = Options(kmer_length=12, hash_functions=8, estimated_coverage=30.0)
    stream = spark.readStream.schema("read_id long, sequence string").parquet(str(tmp_path / "in"))
    keys = sketch(index, options)
    q = incremental.correct_stream(stream, index, keys, options, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / str(n))), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = {r.read_id: r.sequence for r in spark.read.parquet(str(tmp_path / "out" / "0")).collect()}
    fixed = sum(out[1000 + i] == s for i, s in rows[:20])
    assert len(out) == 20 and fixed >= 15, fixed
    counts = incremental.kmer_counts(spark.readStream.schema("read_id long, sequence string").parquet(str(tmp_path / "in")), 12)
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == 20 * 49
    assert minhash(index, 12, 1, -1).count() == 200


def test_files(spark, tmp_path):
    from helixforge.sources import files

    a, b, c = (f"file://{tmp_path}/{n}" for n in "abc")
    (tmp_path / "a").write_text("x\ny\nz\n")
    assert files.can_open(spark, a) and files.size(spark, a) == 6 and files.line_count(spark, a) == 3
    files.copy(spark, a, b)
    files.rename(spark, b, c)
    assert not files.can_open(spark, b) and files.size(spark, c) == 6
    assert files.remove(spark, c) and not files.remove(spark, c)
    assert files.temporary(spark) != files.temporary(spark) and not files.can_open(spark, files.temporary(spark))


@pytest.mark.parametrize("k", [5, 20, 32])
def test_reads_dumped_in_ranges_equal_their_counts(spark, tmp_path, monkeypatch, k):
    import random

    from helixforge.functions import sequence
    from helixforge.operators import kmers

    monkeypatch.setattr(kmers, "CHUNK", 700)
    rng = random.Random(k)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randrange(90))),) for _ in range(60)] + [("A" * 400,), ("T" * 1000 + "N" + "G" * 33,), (None,), ("",), ("ACN",)]
    df = spark.createDataFrame(rows, "sequence string")
    assert len(kmers.range_bounds(df, k)[0]) > 3
    path = str(tmp_path / "dump")
    sinks.dump_kmers(df, k, path)
    want = kmers.kmer_counts(df, k).select(sequence.decode(F.col("code"), k).alias("kmer"), F.col("n").alias("count"))
    assert sorted(map(tuple, S.read_kmer_dump(spark, path).collect())) == sorted(map(tuple, want.collect()))


def test_empty_and_odd_kmer_dumps(spark, tmp_path):
    sinks.dump_kmers(spark.createDataFrame([("AC",)], "sequence string"), 5, str(tmp_path / "none"))
    assert S.read_kmer_dump(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "crlf").write_text(">12\r\nacg\r\n>3\r\nTTT\r\n")
    assert sorted(map(tuple, S.read_kmer_dump(spark, str(tmp_path / "crlf")).collect())) == [("ACG", 12), ("TTT", 3)]
