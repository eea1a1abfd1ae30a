"""Where own code can be put in: per batch of reads, per range of ids, and as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def map_reads(reads: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """f on each batch of reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return reads.mapInPandas(run, schema)


def map_range(spark: SparkSession, first: int, end: int, f: Callable[[pd.Series], pd.DataFrame], schema: str | StructType, partitions: int | None = None) -> DataFrame:
    """f on successive parts of the ids first..end, wherever they run."""
    ids = spark.range(first, end, numPartitions=partitions)
    return map_reads(ids, lambda batch: f(batch["id"]), schema)


@F.udtf(returnType="pos int, kmer string")
class KmerRows:
    """SELECT * FROM kmer_rows(sequence, k): a row for each k-mer; for use in SQL after register_functions."""

    def eval(self, sequence: str, k: int):
        for i in range(len(sequence or "") - k + 1):
            yield i + 1, sequence[i : i + k]


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("kmer_rows", KmerRows)
