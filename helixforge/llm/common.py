"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixforge import ship
from helixforge import storage

#: bytes of a batch that goes to Python, whatever the length of the texts in it (a longer text is a batch by itself)
BATCH_BYTES = 2 << 20
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ready(spark: SparkSession) -> None:
    """Ships the code, and makes batches of whole texts small, unless the session says otherwise.  Before a plan with Python
    functions is made: what a function imports is noted when its plan is."""
    ship(spark)
    if spark.conf.get(_BATCH, _SPARKS_OWN) == _SPARKS_OWN:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives a lost executor."""
    ready(df.sparkSession)
    return storage.materialize(df, tag, lean=False)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_buckets(rows: int, each: int) -> int:
    """Buckets of about `each` rows: their number follows the data, not the cluster."""
    return max(1, -(-rows // each))


#: Rows that a task reads, at least, where it writes a file or sends rows to Python.
TASK_ROWS = 1 << 15


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """df in no more tasks, and so files, than the `rows` rows it is made of need, whatever number of partitions the session asks
    for: partitions are put together without a shuffle, and a key's rows stay together.  Many rows stay as they are.  (Each file
    in a local folder costs an executor several commands that are started beside it.)"""
    return df.coalesce(n_buckets(rows, each))


#: A bitmap that goes to all tasks has at most so many bits (8 MB).
MOST_BITS = 1 << 26


def bitmap(keys: DataFrame, key: Column) -> tuple[int, DataFrame]:
    """A bitmap of the hashes `key` of some rows: its size, which is bounded, and its words.  Two passes over keys.  With more
    keys than MOST_BITS it would spare nothing, and there is none (size 0)."""
    many = keys.count()
    if many > MOST_BITS:
        return 0, keys
    size = max(1 << 12, min(MOST_BITS, 1 << (8 * max(1, many)).bit_length()))
    place = F.pmod(key, F.lit(size))
    words = keys.select(F.floor(place / 64).alias("__w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("__b"))
    return size, words.groupBy("__w").agg(F.bit_or("__b").alias("__b"))


def marked(rows: DataFrame, key: Column, bits: tuple[int, DataFrame]) -> DataFrame:
    """rows with hit: false where no key of the bitmap has the row's hash `key`; true for all that have, and for some more."""
    size, words = bits
    if not size:
        return rows.withColumn("hit", F.lit(True))
    place = F.pmod(key, F.lit(size))
    own = rows.withColumn("__p", place).withColumn("__w", F.floor(F.col("__p") / 64))
    both = own.join(F.broadcast(words), "__w", "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__p") % 64).cast("int"))
    return both.withColumn("hit", F.coalesce(F.col("__b").bitwiseAND(bit) != 0, F.lit(False))).drop("__w", "__p", "__b")


#: A key with over one in HOT of all rows, and over FEW, is common: there are at most HOT such keys, and each is dealt out to
#: SALTS tasks.
HOT, FEW, SALTS = 4096, 1024, 256


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """The inner join of rows with counted, which has each key once and in n how many rows have it; total is the sum of n.
    The few common keys go to all tasks, which give their rows a salt, by the rows' other columns; so no key's rows meet in one
    task.  (Rows that are equal in all columns have one salt.)"""
    common = F.col(n) > max(FEW, total // HOT)
    hot = F.broadcast(counted.where(common).select(*on, F.lit(True).alias("__hot")))
    own = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]), F.lit(SALTS))
    none = F.lit(0).cast("long")
    salted = rows.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot"), own).otherwise(none)).drop("__hot")
    every = F.when(common, F.sequence(none, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(none))
    return salted.join(counted.withColumn("__salt", F.explode(every)), [*on, "__salt"]).drop("__salt")
