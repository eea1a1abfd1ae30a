"""Statistics of reads and choices among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixforge.functions.sequence import has_ambiguous

NO_MINIMUM = 2**31 - 1  #: the least length of an empty input


def statistics(reads: DataFrame) -> DataFrame:
    """min_length, max_length, n_reads of one input, in one pass."""
    n = F.length("sequence")
    return reads.agg(F.coalesce(F.min(n), F.lit(NO_MINIMUM)).alias("min_length"), F.coalesce(F.max(n), F.lit(0)).alias("max_length"), F.count("*").alias("n_reads"))


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("sequence").alias("len")).agg(F.count("*").alias("n_reads"))


def exclude_ambiguous(reads: DataFrame) -> DataFrame:
    return reads.where(~has_ambiguous(F.col("sequence")))


def id_range(reads: DataFrame, first: int, end: int) -> DataFrame:
    """Ids from first to before end; the filter reaches the scan of saved reads."""
    return reads.where((F.col("read_id") >= first) & (F.col("read_id") < end))


def gather(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """The reads of a list of ids, once for each time an id is listed."""
    return ids.join(reads, "read_id")
