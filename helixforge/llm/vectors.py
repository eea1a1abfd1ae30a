"""Vectors of a table as rows of bytes, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready


def clean(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float | None = None, zero: bool = True) -> DataFrame:
    """vec_id long, v binary (float64), n2 double (squared length).  scale: each component x becomes floor(scale * x).
    zero: whether zero vectors take part.  Rows without vec_id, and vectors that are null or hold null or non-finite
    components, take no part; of rows that share a vec_id one takes part (that of the smallest bytes)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lists = lists.cast(pa.list_(pa.float64()))
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].astype(np.float64)
            flat = np.floor(flat * scale) if scale else flat
            first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = (bad[first[1:]] == bad[first[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            square = np.concatenate([[0], np.cumsum(np.where(np.isfinite(flat), flat, 0) != 0)])
            if not zero:
                good &= square[first[1:]] > square[first[:-1]]
            at = np.flatnonzero(good)
            parts = [flat[first[i] : first[i + 1]] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([float(p @ p) for p in parts], pa.float64())],
                names=["vec_id", "v", "n2"],
            )

    ready(rows.sparkSession)
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    found = own.mapInArrow(run, "vec_id long, v binary, n2 double")
    return found.groupBy("vec_id").agg(F.min(F.struct("v", "n2")).alias("x")).select("vec_id", "x.v", "x.n2")


def matrix(column, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of bytes as a matrix of doubles; shorter vectors are as if zeros followed.  kind: what the bytes hold."""
    parts = [np.frombuffer(x, kind).astype(np.float64) for x in column]
    if all(len(p) == width for p in parts):
        return np.concatenate(parts).reshape(-1, width) if parts else np.zeros((0, width))
    out = np.zeros((len(parts), width))
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest scores, ties to smaller ids; ids has one row for all, or a row for each."""
    n = scores.shape[1]
    if n > 4 * k:  # what may be among them: all that reach the k-th score
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        most = int((scores >= least[:, None]).sum(1).max())
        if most < n // 2:
            some = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            own = np.take_along_axis(np.broadcast_to(ids, scores.shape), some, 1)
            order = np.lexsort((own, -np.take_along_axis(scores, some, 1)), axis=1)[:, :k]
            return np.take_along_axis(some, order, 1)
    return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]


def top(found: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score -> query_id, rank, vec_id, score: the k best of each query; a limit in each task comes before
    the shuffle."""
    from pyspark.sql import Window as Wd

    rank = F.row_number().over(Wd.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
