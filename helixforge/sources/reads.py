"""Reads: from FASTA and FASTQ files, plain or gzip, and derived from a table of texts.

A read is read_id long (dense in input order), header, sequence, quality (null in FASTA).  Mates of a pair are neighbours:
pair_id = read_id div 2, mate = read_id % 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from helixforge.functions.sequence import has_ambiguous
from helixforge.sources import files
from helixforge.storage import materialize

READ, SPAN = 100, 1 << 20  #: length of derived reads; ids that a document has at most
GENOME_EVERY = 4


# --- files ---


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file (place in paths), line (from 0), value.  Lines are numbered without a sort or a single task: each split counts
    its lines, and the counts of a file's splits give where a split begins.  The lines are written down first, so that their
    numbers are those that were counted."""
    every = None
    for i, path in enumerate(paths):
        rows = _text(spark, path).select(F.lit(i).alias("file"), "part", "split", "value")
        every = rows if every is None else every.unionAll(rows)
    every = materialize(every.withColumn("m", F.monotonically_increasing_id()), "lines")
    counts = every.groupBy("file", "part", "split").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = Wd.partitionBy("file").orderBy("part", "split").rowsBetween(Wd.unboundedPreceding, -1)  # a row for each split
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return every.join(starts, ["file", "part", "split"]).select("file", (F.col("start") + F.col("m") - F.col("first")).alias("line"), "value")


def is_gzip(spark: SparkSession, path: str) -> bool:
    """By the first two bytes, not by the name."""
    p, fs = files.locate(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return False
    stream = fs.open(p)
    try:
        return [stream.read(), stream.read()] == [0x1F, 0x8B]
    finally:
        stream.close()


def _text(spark: SparkSession, path: str) -> DataFrame:
    """part, split, value.  A gzip file whose name does not say so is copied under a name that does, so that its codec streams
    it; no task holds a whole file."""
    if not path.endswith(".gz") and files.exists(spark, path) and is_gzip(spark, path):
        named = files.temporary(spark, "gzip") + ".gz"
        files.copy(spark, path, named)
        path = named
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("split"), "value")


def has_quality(spark: SparkSession, path: str) -> bool:
    """Whether the first five records have qualities; mixed records are an error, an empty file has none."""
    first = [r["value"] for r in _text(spark, path).limit(20).collect() if r["value"]]
    kinds = {line[0] for line in first[:1]}
    if not kinds:
        return False
    if kinds == {"@"}:
        if any(line[0] != "@" for line in first[::4]):
            raise ValueError(f"{path}: records with and without qualities")
        return True
    if any(line[0] == "@" for line in first):
        raise ValueError(f"{path}: records with and without qualities")
    return False


def file_format(spark: SparkSession, path: str) -> str:
    return ("FASTQ" if has_quality(spark, path) else "FASTA") + ("GZ" if is_gzip(spark, path) else "")


def read_files(spark: SparkSession, paths: list[str], partitions: int | None = None) -> DataFrame:
    """read_id, header, sequence, quality of several files one after another.  FASTQ records are four lines; FASTA records
    run to the next '>'.  Files of both kinds together are an error.  gzip is not splittable, so it is dealt out anew."""
    kinds = {has_quality(spark, p) for p in paths}
    if len(kinds) > 1:
        raise ValueError("files with and without qualities together")
    lines = numbered_lines(spark, paths)
    if kinds == {True}:
        field = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
        records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(F.substring(field(0), 2, 2**31 - 1).alias("header"), field(1).alias("sequence"), field(3).alias("quality"))
    else:
        from helixforge.operators.primitives import running_total

        heads = running_total(lines.where("value <> ''").withColumn("is_head", F.col("value").startswith(">").cast("long")), ["file", "line"], "is_head", "record", inclusive=True)
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_head") == 0, F.struct("line", "value")))), lambda x: x["value"]), "")
        head = F.max(F.when(F.col("is_head") == 1, F.substring("value", 2, 2**31 - 1)))
        # the running total goes through all files, so it is the record's place already
        records = heads.groupBy("file", "record").agg(head.alias("header"), body.alias("sequence"), F.lit(None).cast("string").alias("quality"))
    records = records.withColumn("sequence", F.upper("sequence"))
    sizes = records.groupBy("file").agg(F.count("*").alias("n"), F.min("record").alias("least")).collect()
    at, table = 0, []
    for r in sorted(sizes, key=lambda r: r["file"]):
        table.append((r["file"], at - r["least"]))
        at += r["n"]
    shifts = spark.createDataFrame(table, "file int, shift long")
    out = records.join(F.broadcast(shifts), "file").select((F.col("record") + F.col("shift")).alias("read_id"), "header", "sequence", "quality")
    return out.repartition(partitions, "read_id") if partitions else out


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Split pairs: read n of the first file and read n of the second are mates."""
    return first.withColumn("read_id", F.col("read_id") * 2).unionByName(second.withColumn("read_id", F.col("read_id") * 2 + 1))


def concat(parts: list[DataFrame]) -> DataFrame:
    """Several inputs one after another, with new ids."""
    at, out = 0, None
    for p in parts:
        own = p.withColumn("read_id", F.col("read_id") + at)
        out = own if out is None else out.unionByName(own)
        at += p.count()
    return out


def read_kmer_dump(spark: SparkSession, path: str) -> DataFrame:
    """Records of two lines, ">count" and the k-mer -> kmer, count.  A record ends where the next '>' stands, so none is put
    together from lines that lie in two splits, and nothing is numbered or shuffled."""
    named = path
    if not path.endswith(".gz") and files.exists(spark, path) and is_gzip(spark, path):
        named = files.temporary(spark, "gzip") + ".gz"
        files.copy(spark, path, named)
    records = spark.read.option("lineSep", ">").text(named).where("value <> ''")
    lines = F.rtrim("value", F.lit("\r\n"))  # the cast takes the other carriage return
    return records.select(F.upper(F.substring_index(lines, "\n", -1)).alias("kmer"), F.substring_index("value", "\n", 1).cast("long").alias("count"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of a FASTA file, upper-case, without headers and line ends.  (So a k-mer across a line end of
    the file is found, which a search in the raw file would miss.)"""
    return read_files(spark, [path]).select("read_id", "header", "sequence")


# --- derived reads ---


def letters(text: Column) -> Column:
    """A text as DNA: its letters a to z, cyclically A, C, G, T."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def perfect(documents: DataFrame) -> DataFrame:
    """read_id, pair_id, mate, sequence: every text cut into reads of READ letters one after another; the last one ends with
    the text, and so overlaps the one before.  A text of fewer letters is no read.  read_id = doc_id * SPAN + place."""
    dna = documents.select("doc_id", letters(F.col("text")).alias("s"))
    # all pieces in one pass: a substr for each would walk the text from its start
    full = F.regexp_extract_all("s", F.lit(f".{{{READ}}}"), F.lit(0))
    last = F.when((F.length("s") > READ) & (F.length("s") % READ != 0), F.array(F.right("s", F.lit(READ)))).otherwise(F.array().cast("array<string>"))
    each = dna.select("doc_id", F.posexplode(F.concat(full, last)).alias("w", "sequence"))
    read_id = F.col("doc_id") * SPAN + F.col("w")
    return each.select(
        read_id.alias("read_id"),
        F.floor(read_id / 2).alias("pair_id"),
        (F.col("w") % 2).alias("mate"),
        "sequence",
    )


def _swap(s: Column, place: Column, to: str = "CGTA") -> Column:
    """The letter at a place (from 1) becomes the next one of A, C, G, T."""
    inside = (place >= 1) & (place <= F.length(s))
    return F.when(inside, F.overlay(s, F.translate(F.substr(s, place, F.lit(1)), "ACGT", to), place, F.lit(1))).otherwise(s)


def _first_place() -> Column:
    return F.pmod(F.pmod(-F.col("read_id") * 31, F.lit(97)) * 40, F.lit(97)).cast("int")


def error_free(reads: DataFrame, name: str = "perfect") -> DataFrame:
    """Adds what the sequences were before original() replaced letters: the places follow from the ids, and the letters turn
    back.  So both are had from one stored table."""
    p = _first_place()
    return reads.withColumn(name, _swap(_swap(F.col("sequence"), p + 97, "TACG"), p, "TACG"))


def qualities() -> Column:
    """The derived reads' qualities, from their ids."""
    cycle = "".join(chr(33 + i) for i in range(41)) * (READ // 41 + 2)
    return F.substr(F.lit(cycle), F.pmod(F.col("read_id") + 1, F.lit(41)).cast("int") + 1, F.lit(READ))


def original(reads: DataFrame, *keep: str) -> DataFrame:
    """read_id, sequence, quality, and columns that are kept: reads with replaced letters where (31 * read_id + 17 * place) % 97 = 0, and with qualities
    that run through the 41 characters from '!'.  17 * 40 = 1 modulo 97, so the places are known without a search."""
    with_place = reads.select("read_id", "sequence", _first_place().alias("p"), *keep)
    once = with_place.select("read_id", _swap(F.col("sequence"), F.col("p")).alias("sequence"), "p", *keep)
    return once.select(
        "read_id",
        _swap(F.col("sequence"), F.col("p") + 97).alias("sequence"),
        qualities().alias("quality"),
        *keep,
    )


def genome(reads: DataFrame) -> DataFrame:
    """The part of the perfect reads that counts as the genome: each GENOME_EVERY-th of a document."""
    return reads.where(F.pmod("read_id", F.lit(SPAN)) % GENOME_EVERY == 0)


def ambiguous(reads: DataFrame) -> DataFrame:
    """Reads with an N where read_id % 7 = 0, at place read_id % READ."""
    place = (F.pmod("read_id", F.lit(READ)) + 1).cast("int")
    return reads.withColumn("sequence", F.when(F.col("read_id") % 7 == 0, F.overlay("sequence", F.lit("N"), place, F.lit(1))).otherwise(F.col("sequence"))).withColumn(
        "has_n", has_ambiguous(F.col("sequence"))
    )
