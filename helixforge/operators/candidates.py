"""Candidate reads: buckets of equal sketch keys, and the pairs in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixforge.storage import materialize, release


def bucket_sizes(keys: DataFrame) -> DataFrame:
    """map_id, key, n."""
    return keys.groupBy("map_id", "key").agg(F.count("*").alias("n"))


def pruned(keys: DataFrame, limit: int) -> DataFrame:
    """The rows of buckets with 2 to `limit` reads: a read alone has no candidate, and a large bucket is a repeat.  Sizes are
    counted with partial sums first, so a hot bucket is never gathered."""
    some = bucket_sizes(keys).where((F.col("n") >= 2) & (F.col("n") <= limit)).select("map_id", "key")
    return keys.join(some, ["map_id", "key"], "left_semi")


def buckets(keys: DataFrame, limit: int) -> DataFrame:
    """map_id, key, read_ids (sorted); after pruning a list has `limit` ids at most."""
    return pruned(keys, limit).groupBy("map_id", "key").agg(F.array_sort(F.collect_list("read_id")).alias("read_ids"))


def pairs(keys: DataFrame, limit: int) -> DataFrame:
    """anchor_id, cand_id: every two reads that share a bucket, in both directions, once.  A bucket has at most limit^2 of
    them; `limit` is the bound on the output."""
    return _pairs_of(buckets(keys, limit))


def _pairs_of(lists: DataFrame) -> DataFrame:
    each = lists.select(F.explode("read_ids").alias("anchor_id"), "read_ids")
    return each.select("anchor_id", F.explode("read_ids").alias("cand_id")).where("anchor_id <> cand_id").distinct()


ROUNDS = 2  #: of pairs_in_rounds; a part of the maps is shuffled at a time


def pairs_in_rounds(keys: DataFrame, limit: int) -> DataFrame:
    """Output of pairs.  Maps are bucketed round after round, and only the reads of kept buckets are written down before the
    next, so that a round's share of the keys is on disk as shuffle files, and not all of them."""
    own = [materialize(buckets(keys.where(F.pmod("map_id", F.lit(ROUNDS)) == i), limit).select("read_ids"), "buckets") for i in range(ROUNDS)]
    lists = reduce(DataFrame.unionAll, own)
    found = materialize(_pairs_of(lists), "pairs")
    for part in own:
        release(part)
    return found


def hits(found: DataFrame) -> DataFrame:
    """anchor_id, n_candidates."""
    return found.groupBy("anchor_id").agg(F.count("*").alias("n_candidates"))


def paired(found: DataFrame) -> DataFrame:
    """anchor_id, cand_id, is_paired: whether the anchor's mate has the candidate's mate as a candidate too."""
    mate = lambda c: F.col(c) + 1 - 2 * (F.col(c) % 2)
    other = found.select(mate("anchor_id").alias("anchor_id"), mate("cand_id").alias("cand_id"), F.lit(True).alias("m"))
    return found.join(other, ["anchor_id", "cand_id"], "left").select("anchor_id", "cand_id", F.coalesce("m", F.lit(False)).alias("is_paired"))


def keys_in_rounds(sketch, maps: int, each: int) -> DataFrame:
    """Tables in rounds of `each` maps, each written down before the next, for inputs whose tables do not fit at once.
    sketch(first, n) gives the keys of n maps."""
    out = None
    for first in range(0, maps, each):
        part = materialize(sketch(first, min(each, maps - first)), "tables")
        out = part if out is None else out.unionByName(part)
    return out
