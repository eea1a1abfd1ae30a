"""Queries for sources and sinks: what is written to the shared folder, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixforge.operators import forest, kmers, runs
from helixforge.operators import reads as R
from helixforge.plans import correction
from helixforge.plans.queries import OPTIONS, TREES, _features, _single, original, perfect, plain, query, table
from helixforge.sources import files, sinks
from helixforge.sources import reads as S
from helixforge.storage import materialize

PARTS = 2  #: files of one write


def _named(reads):
    return reads.withColumn("header", F.concat(F.lit("read "), F.col("read_id").cast("string")))


def _written(spark, reads, kind: str) -> list[str]:
    path = files.temporary(spark, "reads")
    sinks.write_reads(reads, path, kind, PARTS)
    return files.parts(spark, path)


@query
def fastq_files(spark, sf_dir):
    """Reads with qualities as FASTQ and back, with dense ids in the order of the input."""
    return S.read_files(spark, _written(spark, _named(original(spark, sf_dir)), "FASTQ"))


@query
def gzip_files(spark, sf_dir):
    """The same as gzip, under names that do not say so."""
    paths = []
    for p in _written(spark, _named(original(spark, sf_dir)), "FASTQGZ"):
        paths.append(p.removesuffix(".txt.gz") + ".reads")
        files.rename(spark, p, paths[-1])
    return S.read_files(spark, paths)


@query
def fasta_files(spark, sf_dir):
    """Reads without qualities as FASTA and back."""
    return S.read_files(spark, _written(spark, _named(perfect(spark, sf_dir)).withColumn("quality", F.lit(None).cast("string")), "FASTA")).drop("quality")


@query
def format_probe(spark, sf_dir):
    """What the probe says of files of each kind, and how many reads they hold."""
    own = materialize(_named(original(spark, sf_dir)), "probe")
    out = None
    for kind in ("FASTA", "FASTQ", "FASTAGZ", "FASTQGZ"):
        paths = _written(spark, own, kind)
        said = ",".join(sorted({S.file_format(spark, p) for p in paths}))
        row = S.read_files(spark, paths).agg(F.lit(kind).alias("kind"), F.lit(said).alias("probed"), F.count("*").alias("n_reads"), F.count("quality").alias("n_qualities"))
        out = row if out is None else out.unionAll(row)
    return out


@query
def pair_files(spark, sf_dir):
    """Mates in two files, interleaved."""
    own = _named(perfect(spark, sf_dir)).withColumn("quality", F.lit(None).cast("string"))
    both = materialize(own.join(own.groupBy("pair_id").agg(F.count("*").alias("n")).where("n = 2"), "pair_id", "left_semi"), "pairs")
    sides = [S.read_files(spark, _written(spark, both.where(F.col("mate") == m), "FASTA")) for m in (0, 1)]
    return S.interleave(*sides).select("read_id", "header", "sequence")


@query
def kmer_dump(spark, sf_dir):
    """Canonical k-mers and their counts as a dump and back."""
    path = files.temporary(spark, "kmers")
    sinks.dump_kmers(plain(spark, sf_dir), OPTIONS.kmer_length, path)
    return S.read_kmer_dump(spark, path)


@query
def genome_file(spark, sf_dir):
    """The genome as a file, and the counts of its k-mers after it is read."""
    own = _named(S.genome(perfect(spark, sf_dir))).withColumn("quality", F.lit(None).cast("string"))
    records = _written(spark, own, "FASTA")
    every = None
    for p in records:
        part = S.read_genome(spark, p)
        every = part if every is None else every.unionAll(part)
    return kmers.kmer_counts(every, OPTIONS.kmer_length)


@query
def saved_reads(spark, sf_dir):
    """A range of ids of saved reads."""
    path = files.temporary(spark, "saved")
    sinks.save_reads(original(spark, sf_dir), path)
    return R.id_range(sinks.load_reads(spark, path), 10 * S.SPAN, 60 * S.SPAN).select("read_id", "sequence", "quality")


@query
def saved_tables(spark, sf_dir):
    """The first two maps of saved tables."""
    path = files.temporary(spark, "tables")
    sinks.save_tables(correction.sketch(plain(spark, sf_dir), OPTIONS), path)
    return sinks.load_tables(spark, path, 2).select("read_id", F.col("map_id").cast("int").alias("map_id"), "key")


@query
def saved_results(spark, sf_dir):
    """Corrections as they are saved for the merge."""
    path = files.temporary(spark, "results")
    sinks.save_results(plain(spark, sf_dir).withColumn("q", (F.col("read_id") % 4).cast("int")), path)
    return sinks.load_results(spark, path).select("read_id", "sequence", "q")


@query
def forest_file(spark, sf_dir):
    """Probabilities of a forest that has been a file; only its first ten trees are loaded."""
    path = files.temporary(spark, "forest")
    files.write_bytes(spark, path, forest.dump(TREES, "components"))
    own, f = _features(spark, sf_dir)
    return own.select("vec_id", F.round(forest.probability(forest.load_file(spark, path, "components", 10), f), 6).alias("probability"))


@query
def printed_features(spark, sf_dir):
    """What print mode writes of the anchors, read back as numbers."""
    from dataclasses import replace

    done = correction.correct(original(spark, sf_dir), replace(OPTIONS, correction_type="print"))
    path = files.temporary(spark, "features")
    names = forest.DESCRIPTOR.split(",")
    sinks.write_features(done.features.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)]), path, 1.0)
    fields = F.split("value", " ")
    return spark.read.text(path).select(*[F.round(F.get(fields, F.lit(i)).cast("double"), 6).alias(c) for i, c in enumerate(names)])


@query
def trained_forest(spark, sf_dir):
    """A forest trained on the components of vectors, as a file and back: the share that it labels right.  (No SQL.)"""
    own = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    samples = own.select(F.transform("embedding", lambda x: x.cast("double")).alias("f"), (F.col("label") % 2).cast("double").alias("y"))
    model, _ = forest.train(samples, "forest", 8, 5)
    path = files.temporary(spark, "trained")
    files.write_bytes(spark, path, forest.dump(forest.export(model), "components"))
    trees = forest.load_file(spark, path, "components")
    says = forest.decide(trees, [F.get("f", F.lit(i)) for i in range(64)], 0.5)
    return samples.agg(F.count("*").alias("n_samples"), F.round(F.avg((says == (F.col("y") == 1)).cast("double")), 6).alias("share_right"))


@query
def file_utilities(spark, sf_dir):
    """Lines of a file that was copied and renamed, and what is left of it."""
    a, b, c = (files.temporary(spark, n) for n in "abc")
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value")).coalesce(1).write.text(a)
    part = files.parts(spark, a)[0]
    files.copy(spark, part, b)
    files.rename(spark, b, c)
    n, same, moved = files.line_count(spark, c), files.size(spark, c) == files.size(spark, part), files.can_open(spark, c) and not files.exists(spark, b)
    gone = files.remove(spark, c) and not files.remove(spark, c)
    return spark.range(1).select(F.lit(n).cast("long").alias("n_lines"), F.lit(same).alias("same_size"), F.lit(moved).alias("moved"), F.lit(gone).alias("removed"))


@query
def log_scan(spark, sf_dir):
    """Evaluation logs, a file for each sample and kind of run, read back."""
    own = materialize(_single(spark, sf_dir), "runs")
    path = files.temporary(spark, "logs")
    name = F.concat(F.lit("out/x_"), F.col("anchor_threshold").cast("string"), F.lit("-"), F.col("candidate_threshold").cast("string"), F.lit(".fq"))
    lines = F.concat_ws("\n", name, *[F.concat(F.lit(k + ": "), F.col(k.lower()).cast("string")) for k in ("TP", "FP", "FN", "TN")])
    for r in own.select("ext", "sample").distinct().collect():  # a few kinds of run
        part = files.temporary(spark, "log")
        own.where((F.col("ext") == r["ext"]) & (F.col("sample") == r["sample"])).select(lines.alias("value")).coalesce(1).write.text(part)
        files.make_folder(spark, path)
        files.rename(spark, files.parts(spark, part)[0], f"{path}/{r['sample']}_{r['ext']}_log.txt")
    return runs.read_logs(spark, path)
