"""Exact top-k search by a Voronoi join.

Scores are integer inner products of vectors that have been made integer.  With M the longest vector, a data vector x of
length n gets one more component sqrt(M^2 - n^2) and a query gets zero there: the distance of the two is then the smaller
the larger their product is.  Pivots cut the space into cells.  Each data cell is summed up by its size and the k + 1
smallest distances to its pivot, from which every query has a bound on the distance of its k-th neighbour; with that
bound, the distance of a query to a pivot tells which cells it needs (the plane between two pivots) and which ring of
them (the triangle inequality).  Queries are grouped by their pivot, a group meets the rings that one of its queries
needs and nothing else, and each pair of a group and a piece of a cell is solved by one matrix product; the products
alone decide, the distances only spare work, and by a margin for rounding.

Cells are cut into pieces of about PIECE vectors and groups into parts of about PART queries, so a cell with a third of all
vectors is many tasks.  A piece is shuffled once, in order of the distance to its pivot; copied are the groups, which are the
smaller side, to those pieces that hold something of the ring they need.  Cells follow the table (a quarter of the root of
its size, LEAST_PIVOTS to MOST_PIVOTS); pivots and the sums of their cells are all that the driver holds.

Defined results: rows without vec_id and vectors that are null or hold null or non-finite components take no part; of
rows that share a vec_id one takes part; a query's own row is no candidate; ties go to the smaller vec_id; shorter
vectors are as if zeros followed; an empty table gives no rows; further columns are ignored.  Scores are exact while
squared lengths stay under 2^53; beyond that the search raises an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import materialize, n_buckets

PIECE, PART = 4096, 512
LEAST_PIVOTS, MOST_PIVOTS = 8, 1024


def _pivots(own: DataFrame, n: int, width: int) -> np.ndarray:
    """The vectors with the smallest hashes, at most n."""
    rows = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("v").collect()
    return np.unique(vectors.matrix([r["v"] for r in rows], width), axis=0)


class Space:
    """Distances to the pivots, for data vectors (in the longer space) and for queries."""

    def __init__(self, pivots: np.ndarray, m2: float) -> None:
        self.pivots, self.m2 = pivots, m2
        self.extra = np.sqrt(np.maximum(m2 - (pivots * pivots).sum(1), 0))
        apart = 2 * m2 - 2 * (pivots @ pivots.T + np.outer(self.extra, self.extra))
        self.apart = np.sqrt(np.maximum(apart, 0))

    def data(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.m2 - 2 * (x @ self.pivots.T + np.outer(extra, self.extra)), 0))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.m2 - 2 * q @ self.pivots.T, 0))


def rings(space: Space, q: np.ndarray, near: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the least and largest distance to its pivot that one of the queries needs (least > largest: none).
    near: for each cell the k + 1 smallest distances to its pivot."""
    d, slack = space.queries(q), 1e-6 * np.sqrt(space.m2) + 1e-9
    cell = d.argmin(1)
    upper = np.concatenate([d[:, [j]] + near[j] for j in range(len(near))], axis=1)
    # k + 1, as the query's own row may be one of them
    bound = np.partition(upper, k, axis=1)[:, k] + slack if upper.shape[1] > k else np.full(len(q), np.inf)
    apart = space.apart[cell]
    own = d[np.arange(len(q)), cell][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart > 0, (d * d - own * own) / (2 * apart), 0)
    need = plane - slack <= bound[:, None]
    low = np.where(need, d - bound[:, None], np.inf).min(0)
    high = np.where(need, d + bound[:, None], -np.inf).max(0)
    return low - slack, high + slack


def search(rows: DataFrame, is_query: Column, k: int, scale: float = 256.0) -> DataFrame:
    """rows: vec_id, embedding; is_query: a condition on vec_id -> query_id, rank, vec_id, score (long)."""
    own = materialize(vectors.clean(rows, scale=scale), "knn-vectors")
    n, m2, width = own.agg(F.count("*"), F.max("n2"), F.max(F.length("v"))).first()
    width, m2 = max(1, (width or 8) // 8), m2 or 0.0
    if m2 >= 2.0**53:
        raise OverflowError("squared lengths of 2^53 and more: scores would not be exact")
    pivots = _pivots(own, max(LEAST_PIVOTS, min(MOST_PIVOTS, int(n**0.5) // 4)), width)
    if not len(pivots):
        pivots = np.zeros((1, width))
    space = Space(pivots, m2)
    kind = np.int16 if m2 <= 32767.0**2 else np.float64  # what is shuffled; products are taken in doubles
    size = np.dtype(kind).itemsize

    def assign(batches):
        for batch in batches:
            x = vectors.matrix(batch.column(1).to_pylist(), width)
            d = space.data(x)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "v", "cell", "d"])

    placed = materialize(own.select("vec_id", "v").mapInArrow(assign, "vec_id long, v binary, cell int, d double"), "knn-cells")
    # sums of the cells: sizes, and the k + 1 smallest distances, of shares of a cell first
    share = placed.groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(n_buckets(n, 16 * PIECE))).alias("s"))
    lists = share.agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked"), F.slice(F.array_sort(F.collect_list("d")), 1, k + 1).alias("near"))
    summed = lists.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()
    near = [np.zeros(0)] * len(pivots)
    pieces, parts = [1] * len(pivots), [1] * len(pivots)
    for r in summed:
        near[r["cell"]], pieces[r["cell"]], parts[r["cell"]] = np.array(r["near"]), n_buckets(r["n"], PIECE), n_buckets(r["asked"], PART)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        sort = np.lexsort((part["vec_id"], part["d"]))
        d = part["d"].to_numpy()[sort]
        x = vectors.matrix(part["v"], width, kind)[sort].astype(kind)
        ids = part["vec_id"].to_numpy(np.int64)[sort]
        return pd.DataFrame([{"cell": part["cell"].iloc[0], "piece": part["piece"].iloc[0], "least": d[0], "most": d[-1], "d": d.tobytes(), "ids": ids.tobytes(), "x": x.tobytes()}])

    def group(part: pd.DataFrame) -> pd.DataFrame:
        q, ids = vectors.matrix(part["v"], width, kind), part["vec_id"].to_numpy(np.int64)
        low, high = rings(space, q, near, k)
        need = np.flatnonzero(low <= high)
        return pd.DataFrame({"g": part["g"].iloc[0], "cell": need.astype(np.int32), "low": low[need], "high": high[need], "q_ids": ids.tobytes(), "q": q.astype(kind).tobytes()})

    of_cell = lambda table: F.get(F.array(*[F.lit(int(p)) for p in table]), F.col("cell"))
    by_piece = F.pmod(F.xxhash64("vec_id"), of_cell(pieces)).cast("int")
    packed = placed.withColumn("piece", by_piece).groupBy("cell", "piece").applyInPandas(pack, "cell int, piece int, least double, most double, d binary, ids binary, x binary")
    packed = materialize(packed, "knn-pieces")
    g = F.concat_ws(":", "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), of_cell(parts)))
    needs = placed.where(is_query).withColumn("g", g).select("g", "vec_id", "v").groupBy("g").applyInPandas(group, "g string, cell int, low double, high double, q_ids binary, q binary")
    needs = materialize(needs, "knn-groups")
    # a group goes to the pieces that hold something of the ring it needs, each of which is in one task, its vectors first
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    asks = needs.join(packed.select("cell", "piece", "least", "most"), "cell").where("least <= high and most >= low")
    asks = asks.select("cell", "piece", "g", "low", "high", "q_ids", "q", *none("binary", "d", "ids", "x"))
    held = packed.select("cell", "piece", *none("string", "g"), *none("double", "low", "high"), *none("binary", "q_ids", "q"), "d", "ids", "x")
    met = held.unionAll(asks).repartition(2 * sum(pieces), "cell", "piece").sortWithinPartitions("cell", "piece", F.col("g").asc_nulls_first())

    def solve(batches):
        own = at = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("cell", "piece", "low", "high", "q_ids", "q", "d", "ids", "x")}
                if row["x"] is not None:
                    own = np.frombuffer(row["d"]), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], kind).reshape(-1, width)
                    at = row["cell"], row["piece"]
                    continue
                if at != (row["cell"], row["piece"]):
                    continue
                a, b = np.searchsorted(own[0], row["low"]), np.searchsorted(own[0], row["high"], side="right")
                if a >= b:
                    continue
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), own[1][a:b]
                s = np.frombuffer(row["q"], kind).astype(np.float64).reshape(-1, width) @ own[2][a:b].astype(np.float64).T
                s[q_ids[:, None] == ids] = -np.inf
                take = vectors.best(s, ids, k)
                score = np.take_along_axis(s, take, 1)
                some = score > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, some.sum(1))), pa.array(ids[take][some]), pa.array(score[some].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return vectors.top(met.mapInArrow(solve, "query_id long, vec_id long, score long"), k)
