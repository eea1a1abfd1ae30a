"""From input files to output files, by options alone."""

from __future__ import annotations

import posixpath
import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixforge import ship
from helixforge.functions.quality import requantize
from helixforge.operators import correct as rule
from helixforge.operators import forest, kmers
from helixforge.operators.primitives import first_ids
from helixforge.operators.reads import exclude_ambiguous
from helixforge.options import Options
from helixforge.plans import correction
from helixforge.sources import reads as S
from helixforge.sources import sinks
from helixforge.storage import materialize

PREFIX = "corrected_"


def _inputs(spark: SparkSession, options: Options) -> DataFrame:
    """read_id, header, sequence, quality, file (place of the input file).  Two files of pairs are interleaved; one file of pairs
    is so already."""
    paths = list(options.input_files)
    if not paths:
        raise ValueError("no input files")
    if options.paired and len(paths) > 2:
        raise ValueError("pairs come in one file or two")
    parts = [materialize(S.read_files(spark, [p]).withColumn("file", F.lit(i)), "input") for i, p in enumerate(paths)]
    if options.paired and len(parts) == 2:
        return S.interleave(*parts)
    return S.concat(parts)


def _outputs(options: Options) -> list[str]:
    """The paths that are written: one for all reads, or one for each input file."""
    if not options.output_files and not options.input_files:
        raise ValueError("saved reads have no file names: output_files are needed")
    names = options.output_files or tuple(PREFIX + posixpath.basename(p.rstrip("/")).removesuffix(".gz") for p in options.input_files)
    return [posixpath.join(options.output_dir, n) for n in names]


def _trees(spark: SparkSession, options: Options) -> tuple[list | None, list | None]:
    own = others = None
    if options.correction_type == "forest":
        if not options.forest_file:
            raise ValueError("forest_file: a forest is needed")
        own = forest.load_file(spark, options.forest_file, forest.DESCRIPTOR, options.max_trees)
    if options.correct_candidates and options.correction_type_candidates == "forest":
        if not options.forest_file_candidates:
            raise ValueError("forest_file_candidates: a forest for candidates is needed")
        others = forest.load_file(spark, options.forest_file_candidates, forest.CANDIDATE_DESCRIPTOR, options.max_trees_candidates)
    return own, others


def prepared(spark: SparkSession, options: Options) -> tuple[DataFrame, Options]:
    """The reads that the options name, and the options as the reads allow them."""
    if options.load_reads_from:
        reads = sinks.load_reads(spark, options.load_reads_from)
    else:
        reads = materialize(_inputs(spark, options), "inputs")
    reads = first_ids(reads if "file" in reads.columns else reads.withColumn("file", F.lit(0)), options.first_reads)
    if options.save_reads_to:
        sinks.save_reads(reads, options.save_reads_to)
    if options.use_quality and not reads.where("quality is null").isEmpty():
        warnings.warn("qualities are not used: some reads have none", stacklevel=2)
        options = replace(options, use_quality=False)
    if options.use_quality and options.quality_bits < 8:
        reads = reads.withColumn("read_quality", F.col("quality")).withColumn("quality", requantize(F.col("quality"), options.quality_bits))
    if options.autodetect_kmer_length:
        options = replace(options, kmer_length=kmers.autodetect_k(reads))
    return reads, options


def correct_files(spark: SparkSession, options: Options) -> list[str]:
    """Reads the input files (or saved reads), corrects, and writes folders of FASTA or FASTQ parts in the order of the input
    -> their paths.  Saved tables are used instead of new sketches; reads and tables are saved where the options say.  In print
    mode a sample of the features is written beside."""
    ship(spark)
    reads, options = prepared(spark, options)
    trees, others = _trees(spark, options)
    keys = sinks.load_tables(spark, options.load_tables_from, options.hash_functions) if options.load_tables_from else None
    if options.save_tables_to:
        if keys is None:
            keys = materialize(correction.sketch(exclude_ambiguous(reads) if options.exclude_ambiguous else reads, options), "tables")
        sinks.save_tables(keys, options.save_tables_to)
    own = reads.select("read_id", "sequence", "quality") if options.use_quality else reads.select("read_id", "sequence")
    done = correction.correct(own, options, trees=trees, keys=keys, trees_candidates=others)
    printed = (
        (done.features, forest.DESCRIPTOR, options.features_file, options.sample_rate_anchor),
        (done.features_candidates, forest.CANDIDATE_DESCRIPTOR, options.features_file_candidates, options.sample_rate_candidates),
    )
    for features, descriptor, name, rate in printed:
        if features is not None:
            columns = [F.get("f", F.lit(i)).alias(c) for i, c in enumerate(descriptor.split(","))]
            sinks.write_features(features.select(*columns), posixpath.join(options.output_dir, name), rate)
    results = materialize(done.results, "results")
    if "read_quality" in reads.columns:
        reads = reads.drop("quality").withColumnRenamed("read_quality", "quality")
    merged = rule.merge(reads, results, options).join(reads.select("read_id", "file"), "read_id")
    paths = _outputs(options)
    for i, path in enumerate(paths):
        part = merged if len(paths) == 1 else merged.where(F.col("file") == i)
        has_quality = not part.where("quality is not null").isEmpty()
        sinks.write_reads(part.drop("file"), path, ("FASTQ" if has_quality else "FASTA") + ("GZ" if options.gz_output else ""))
    return paths

