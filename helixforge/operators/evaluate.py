"""Corrections against error-free reads, base by base."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from helixforge.operators.letters import letters

NAMES = ["name", "read_id", "tp", "fp", "fn", "tn"]
SCHEMA = "name string, read_id long, tp long, fp long, fn long, tn long"


def aligned(original: DataFrame, perfect: DataFrame, corrected: dict[str, DataFrame]) -> DataFrame:
    """name, read_id, o, p, c: the reads that all inputs have, letters upper-cased.  Lengths must be equal."""
    out = None
    both = original.select("read_id", F.upper("sequence").alias("o")).join(perfect.select("read_id", F.upper("sequence").alias("p")), "read_id")
    for name, reads in corrected.items():
        own = both.join(reads.select("read_id", F.upper("sequence").alias("c")), "read_id").select(F.lit(name).alias("name"), "read_id", "o", "p", "c")
        out = own if out is None else out.unionAll(own)
    same = (F.length("o") == F.length("p")) & (F.length("p") == F.length("c"))
    return out.withColumn("o", F.when(same, F.col("o")).otherwise(F.raise_error(F.concat(F.lit("lengths differ: read "), F.col("read_id").cast("string")))))


def beside(rows: DataFrame, corrected: dict[str, str]) -> DataFrame:
    """Output of per_read from one table: read_id, original, perfect, and a column of letters for each name.  No row is made
    twice; a name may have the original letters."""
    more = [c for c in dict.fromkeys(corrected.values()) if c not in ("original", "perfect")]
    columns = ["original", "perfect", *more]
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.length("original") == F.length(c))
    error = F.raise_error(F.concat(F.lit("lengths differ: read "), F.col("read_id").cast("string")))
    own = rows.select("read_id", F.when(same, F.upper("original")).otherwise(error).alias("original"), *[F.upper(c).alias(c) for c in columns[1:]])

    def run(batches):
        for batch in batches:
            named = {c: letters(batch.column(i + 1)) for i, c in enumerate(columns)}
            o, p = named["original"][0], named["perfect"][0]
            for name, c in corrected.items():
                sums = _sums(o, p, named[c][0], named["original"][1])
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), batch.column(0), *map(pa.array, sums)], names=NAMES)

    return own.mapInArrow(run, SCHEMA)


def _sums(o: np.ndarray, p: np.ndarray, c: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """tp, fp, fn, tn of strings one after another; only letters that are or were wrong are looked at singly."""
    was, now = o == p, c == p
    first = np.cumsum(size) - size
    count = lambda hit: np.bincount(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1, minlength=len(size)).astype(np.int64)
    tp, fp, fn = count(~was & now), count(was & ~now), count(~was & ~now)
    return [tp, fp, fn, size - tp - fp - fn]


def per_read(rows: DataFrame) -> DataFrame:
    """name, read_id, tp, fp, fn, tn.  Letters are compared as bytes of whole Arrow batches; no letter becomes a row."""

    def run(batches):
        for batch in batches:
            (o, _), (p, _), (c, size) = (letters(batch.column(i)) for i in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, _sums(o, p, c, size))], names=NAMES)

    return rows.select("name", "read_id", "o", "p", "c").mapInArrow(run, SCHEMA)


def confusion(counts: DataFrame) -> DataFrame:
    return counts.groupBy("name").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def metrics(summed: DataFrame) -> DataFrame:
    """gain, sensitivity and specificity; nothing by nothing is 0."""
    c = F.col
    return summed.select(
        "name",
        F.round(ratio(c("tp") - c("fp"), c("tp") + c("fn")), 6).alias("gain"),
        F.round(ratio(c("tp"), c("tp") + c("fn")), 6).alias("sensitivity"),
        F.round(ratio(c("tn"), c("tn") + c("fp")), 6).alias("specificity"),
    )


def histogram(counts: DataFrame) -> DataFrame:
    """name, n_errors (that remain in a read), n_reads, cumulative; the window runs over the histogram."""
    by = counts.groupBy("name", (F.col("fp") + F.col("fn")).alias("n_errors")).agg(F.count("*").alias("n_reads"))
    return by.withColumn("cumulative", F.sum("n_reads").over(Wd.partitionBy("name").orderBy("n_errors")))


def over(hist: DataFrame, most: int = 10) -> DataFrame:
    """Reads with more than `most` errors left."""
    return hist.groupBy("name").agg(F.sum(F.when(F.col("n_errors") > most, F.col("n_reads")).otherwise(0)).alias("n_over"))
