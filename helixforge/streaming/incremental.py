"""Reads that arrive over time.  The engine that this one follows works on batches only; this is an addition.

A stream of reads is counted as it comes, or corrected batch by batch against an index of reads that is already there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixforge.operators import align, candidates, correct, kmers, msa
from helixforge.options import Options
from helixforge.plans.correction import sketch


def kmer_counts(stream: DataFrame, k: int) -> DataFrame:
    """code, n so far; a stream in update or complete mode.  Its state is one row for each distinct k-mer."""
    return kmers.canonical_kmers(stream, k).groupBy("code").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, k: int, time: str, width: str, late: str) -> DataFrame:
    """k-mers in each window of time; rows later than `late` are left out, and windows older than that are done with."""
    kept = stream.withWatermark(time, late)
    return kmers.canonical_kmers(kept, k, (time,)).groupBy(F.window(time, width)).agg(F.count("*").alias("n_kmers"))


def correct_batch(batch: DataFrame, indexed: DataFrame, keys: DataFrame, options: Options) -> DataFrame:
    """read_id, sequence, q of a batch, by the candidates that the index has for it (ids of batch and index must differ)."""
    own = sketch(batch, options)
    known = candidates.pruned(keys, options.bucket_limit)
    pairs = own.withColumnRenamed("read_id", "anchor_id").join(known.withColumnRenamed("read_id", "cand_id"), ["map_id", "key"]).select("anchor_id", "cand_id").distinct()
    every = batch.select("read_id", "sequence").unionByName(indexed.select("read_id", "sequence"))
    found = align.good(align.align(pairs, every, options), every, options)
    built = msa.rows(align.oriented(found, every), every)
    cols = msa.columns(built)
    return correct.combine(correct.anchors(cols, msa.properties(cols, options), options), None, batch.select("read_id", "sequence"))


def correct_stream(stream: DataFrame, indexed: DataFrame, keys: DataFrame, options: Options, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that corrects each batch and hands it to sink(batch, id); a sink that writes by id is exactly once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            sink(correct_batch(batch, indexed, keys, options), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
