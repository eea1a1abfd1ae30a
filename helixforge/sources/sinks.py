"""Writers: FASTA and FASTQ, plain or gzip, k-mer FASTA, saved reads and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixforge.operators import kmers as kmers_of
from helixforge.storage import materialize, release, shuffles_dropped


def records(kind: str) -> Column:
    """One record as text.  Headers are written as they were read."""
    if kind == "FASTQ":
        return F.concat(F.lit("@"), F.coalesce("header", F.lit("")), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.coalesce("quality", F.lit("")))
    if kind == "FASTA":
        return F.concat(F.lit(">"), F.coalesce("header", F.lit("")), F.lit("\n"), F.col("sequence"))
    raise ValueError(f"no such format: {kind}")


def write_reads(reads: DataFrame, path: str, kind: str, partitions: int | None = None) -> None:
    """read_id, header, sequence, quality -> a folder of text files whose parts follow the order of read_id.  kind: FASTA,
    FASTQ, FASTAGZ or FASTQGZ.  A range sort, so no task holds more than its range."""
    plain = kind.removesuffix("GZ")
    lines = records(plain)
    n = partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = reads.repartitionByRange(n, "read_id").sortWithinPartitions("read_id").select(lines.alias("value"))
    (out.write.option("compression", "gzip") if kind.endswith("GZ") else out.write).text(path)


def write_kmers(kmers: DataFrame, path: str) -> None:
    """kmer, count -> ">count" and the k-mer."""
    kmers.select(F.concat(F.lit(">"), F.col("count").cast("string"), F.lit("\n"), F.col("kmer")).alias("value")).write.text(path)


PASSES = 4  #: of dump_kmers; a part of the counts is shuffled at a time


def dump_kmers(reads: DataFrame, k: int, path: str) -> None:
    """The canonical k-mers of reads and their counts as write_kmers has them, as gzip and in ranges that are sorted, so a record
    takes about 5 bytes instead of 24.  Each pass counts the k-mers of its ranges of codes in all reads."""
    own = materialize(reads.select("sequence"), "dumped")
    bounds, _ = kmers_of.range_bounds(own, k)
    parts = len(bounds) + 1
    cuts = sorted({i * parts // PASSES for i in range(PASSES + 1)})
    for first, end in zip(cuts[:-1], cuts[1:]):
        out = kmers_of.dump_ranges(own, k, bounds, first, end).write.mode("append")
        with shuffles_dropped(own.sparkSession):
            out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    release(own)


def write_features(features: DataFrame, path: str, rate: float, seed: int = 42) -> None:
    """Feature rows as text, a sample of them.  Which rows are drawn depends on their values only."""
    columns = [F.col(c).cast("string") for c in features.columns]
    drawn = F.pmod(F.xxhash64(F.lit(seed), *features.columns), F.lit(1_000_000)) < int(rate * 1_000_000)
    features.where(drawn).select(F.concat_ws(" ", *columns).alias("value")).write.text(path)


def save_reads(reads: DataFrame, path: str) -> None:
    reads.write.parquet(path)


def load_reads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_results(results: DataFrame, path: str) -> None:
    """Corrections (read_id, sequence, q) in ranges of read_id, so that the merge with the reads can skip files."""
    n = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    results.repartitionByRange(n, "read_id").sortWithinPartitions("read_id").write.parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_tables(keys: DataFrame, path: str) -> None:
    """map_id, key, read_id in a folder for each map."""
    keys.write.partitionBy("map_id").parquet(path)


def load_tables(spark: SparkSession, path: str, maps: int | None = None) -> DataFrame:
    """At most the first `maps` maps; the others' folders are not read."""
    tables = spark.read.parquet(path)
    return tables.where(F.col("map_id") < maps) if maps is not None else tables
