"""Files of any store that Spark reads: by Hadoop's file system, not by local paths."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from helixforge.storage import shared_dir


def locate(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = locate(spark, path)
    return bool(fs.exists(p))


def can_open(spark: SparkSession, path: str) -> bool:
    p, fs = locate(spark, path)
    return bool(fs.exists(p)) and not fs.getFileStatus(p).isDirectory()


def size(spark: SparkSession, path: str) -> int:
    p, fs = locate(spark, path)
    return int(fs.getContentSummary(p).getLength())


def parts(spark: SparkSession, path: str) -> list[str]:
    """The files that a write has made in a folder, in order."""
    p, fs = locate(spark, path)
    names = [s.getPath().toString() for s in fs.listStatus(p) if s.isFile()]
    return sorted(n for n in names if n.rsplit("/", 1)[1].startswith("part-"))


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, such as a forest's, from the driver."""
    p, fs = locate(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = locate(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, path: str, to: str) -> None:
    p, fs = locate(spark, path)
    if not fs.rename(p, locate(spark, to)[0]):
        raise OSError(f"{path} can't be renamed to {to}")


def copy(spark: SparkSession, path: str, to: str) -> None:
    p, fs = locate(spark, path)
    q, other = locate(spark, to)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> bool:
    """Whether there was something to remove."""
    p, fs = locate(spark, path)
    return bool(fs.delete(p, True))


def temporary(spark: SparkSession, tag: str = "tmp") -> str:
    """A path of its own in the shared folder; nothing is made there."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
