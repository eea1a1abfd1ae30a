"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"  #: a bucket is one file here, so its order holds, and no join sorts it
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all runs on this machine (tests), and an error on a
    cluster, whose machines would not see each other's folders."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="helixforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, tag: str, lean: bool = True, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives a lost executor.  What this function
    has returned is not written twice.  lean: for less disk and some CPU, denser files, and no shuffle file is left.
    by: a column that is joined on more than once; the table is dealt by it into as many buckets as shuffles have partitions,
    and joins on it read it where it lies and shuffle the other side only."""
    if vars(df).get("_path"):
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = (df.repartition(n, by).sortWithinPartitions(by) if by else df).write  # the writer's own sort then finds all in order
    writer = writer.option("compression", "zstd") if lean else writer
    with shuffles_dropped(spark) if lean else contextlib.nullcontext():
        if by:  # buckets need a name in the catalog; the files lie with all others
            writer.option("path", path).bucketBy(n, by).sortBy(by).saveAsTable(_name(path))
        else:
            writer.parquet(path)
    _made.append((spark, path))
    out = spark.table(_name(path)) if by else spark.read.schema(df.schema).parquet(path)
    out._path, out._by = path, by
    return out


def materialize_rounds(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """One table of several parts, each written before the next: the shuffle files of one part are on disk at a time."""
    path = out = None
    for df in parts:
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        with shuffles_dropped(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
        if out is None:
            _made.append((spark, path))
            out = df
    out = out.sparkSession.read.schema(out.schema).parquet(path)
    out._path = path
    return out


def _name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def _delete(spark: SparkSession, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{_name(path)}`")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Writes made inside delete their shuffle files as they end, not when the driver happens to collect garbage, and rely on
    the order of buckets."""
    was = {k: spark.conf.get(k, None) for k in (CLEANUP, ORDERED)}
    for k in was:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(df: DataFrame) -> None:
    """Deletes a table that materialize has written; nothing may read it any more."""
    spark, path = df.sparkSession, df._path
    _delete(spark, path)
    _made.remove((spark, path))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores (a small table, or one row group) is dealt out to them; a larger one
    stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return
