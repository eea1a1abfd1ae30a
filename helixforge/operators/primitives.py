"""Running totals, segment ids, neighbours that repeat, and flagged rows, over an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from helixforge.storage import materialize


def running_total(df: DataFrame, order: list[str], value: str, out: str, inclusive: bool = False) -> DataFrame:
    """Adds the sum of value over all rows before this one (inclusive: and its own).  Ranges of the order are summed apart;
    the sums of the ranges, a row each, give where each begins: no task sees more than its range.  Rows must differ in
    `order`."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    # written down: a range must not be drawn anew between its sum and its rows
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__r", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__r").agg(F.sum(value).alias("__s"))
    before = sums.select("__r", F.coalesce(F.sum("__s").over(Wd.orderBy("__r").rowsBetween(Wd.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = Wd.partitionBy("__r").orderBy(*order).rowsBetween(Wd.unboundedPreceding, 0 if inclusive else -1)
    summed = ranged.withColumn("__t", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return summed.join(F.broadcast(before), "__r").select(*names, (F.col("__t") + F.col("__b")).alias(out))


def running_least(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the least value of all rows before this one (null for the first).  As running_total: ranges apart, then a row for
    each range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__r", F.spark_partition_id()), "ranges")
    least = ranged.groupBy("__r").agg(F.min(value).alias("__s"))
    before = least.select("__r", F.min("__s").over(Wd.orderBy("__r").rowsBetween(Wd.unboundedPreceding, -1)).alias("__b"))
    own = Wd.partitionBy("__r").orderBy(*order).rowsBetween(Wd.unboundedPreceding, -1)
    inside = ranged.withColumn("__t", F.min(value).over(own))
    return inside.join(F.broadcast(before), "__r").select(*names, F.least("__t", "__b").alias(out))


def segment_ids(sizes: DataFrame, segment: str, size: str) -> DataFrame:
    """A row for each element of each segment: segment, place (from 0).  Empty segments have none."""
    return sizes.where(F.col(size) > 0).select(segment, F.explode(F.sequence(F.lit(0), F.col(size).cast("int") - 1)).alias("place"))


def adjacent_unique(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before, in each group."""
    w = Wd.partitionBy(group).orderBy(*order)
    return df.withColumn("__l", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ~F.col("__l").eqNullSafe(F.col(value))).drop("__l", "__n")


def flagged(df: DataFrame, group: str, order: list[str], flag) -> DataFrame:
    """Rows with the flag, with their place among all rows of the group and among the flagged ones (from 0)."""
    w = Wd.partitionBy(group).orderBy(*order)
    marked = df.withColumn("place", F.row_number().over(w) - 1).where(flag)
    return marked.withColumn("rank", F.row_number().over(w) - 1)


def first_ids(df: DataFrame, n: int, key: str = "read_id") -> DataFrame:
    """Rows with an id below n (0: all): the same rows on every run."""
    return df.where(F.col(key) < n) if n else df


def scatter(rows: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value of updates where there is one (keys of updates differ)."""
    new = updates.select(key, F.col(value).alias("__new"))
    return rows.join(new, key, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def members(rows: DataFrame, ids: DataFrame, key: str, out: str = "member") -> DataFrame:
    """rows with whether their key is in a set of ids, as a bit array would tell."""
    some = ids.select(key).distinct().withColumn(out, F.lit(True))
    return rows.join(some, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def strided(rows: DataFrame, key: str, factor: int, skip: int = 0) -> DataFrame:
    """Rows from the id `skip` on, with the group that `factor` successive ids share."""
    return rows.where(F.col(key) >= skip).withColumn("part", F.floor((F.col(key) - skip) / factor))


def hash_sample(rows: DataFrame, rate: float, *columns: str, seed: int = 42) -> DataFrame:
    """The rows whose hash of some columns is in the first `rate` of all hashes: the same on every run and layout."""
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_000)) < round(rate * 1_000_000))
