"""Approximate nearest neighbours by vantage-point trees, one for each shard.

The nearest are those of the largest inner product.  With M the longest vector of a shard, a data vector x of length n
gets one more component sqrt(M^2 - n^2) and a query gets zero there: the distance of the two is then the smaller the
larger their inner product is, and it is a metric, so triangle inequalities hold.  A tree splits its vectors by their
distance to a vantage point at the median, and a child is passed over if no vector of it can be nearer than the k-th so
far: if factor * (the least distance that the triangle inequality leaves) is over the k-th distance.  Factor one is
exact, ties included; a larger factor passes over more.

A tree holds distinct vectors.  Each stands for the k + 1 smallest vec_ids that have it (no other id can be among the k
nearest of any query, its own row left out), so a vector that a third of all rows share is one entry, and equal vectors are
found or missed together.  Matrix products choose what may be near, with all that lie within their rounding of the k-th;
the score of a pair is then summed component by component in order, and so depends on the pair alone.

Shards are hashes of the vector; their number follows the table, so a tree is bounded (about SHARD vectors).  Every row is
indexed.  A tree stays in one task; the stated queries are sent to all shards and stream past it in batches.

Defined results: rows without vec_id and vectors that are null, zero or hold null or non-finite components take no part;
of rows that share a vec_id one takes part; a query's own row is no candidate; ties go to the smaller vec_id; shorter
vectors are as if zeros followed; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from . import vectors
from .common import materialize, n_buckets, ready

SHARD, LEAF = 8192, 96
#: relaxation of the triangle inequality; see the README for the recall that it gives
FACTOR = 1.25
#: places beside the k best for what lies within rounding of the k-th; more than these are looked up one by one
SPARE = 16


def build(x: np.ndarray, m2: float, leaf: int = LEAF, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows of x in the tree, and its nodes: (first, end, middle, left, right) and (least and largest
    distance to the vantage point, left and right).  A node's rows are first..end; the vantage point comes first, then the
    near half up to middle, then the far half.  left and right are nodes, or -1."""
    rng = np.random.default_rng(seed)
    extra = np.sqrt(np.maximum(m2 - np.einsum("ij,ij->i", x, x), 0))
    order, nodes, bounds = np.arange(len(x)), [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        nodes.append([a, b, b, -1, -1])
        bounds.append([0.0] * 4)
        if b - a <= leaf:
            continue
        p = int(rng.integers(a, b))
        order[[a, p]] = order[[p, a]]
        rest, v = order[a + 1 : b], order[a]
        d = np.sqrt(np.maximum(2 * m2 - 2 * (x[rest] @ x[v] + extra[rest] * extra[v]), 0))
        by = np.argsort(d, kind="stable")
        order[a + 1 : b] = rest[by]
        d, mid = d[by], (len(rest) + 1) // 2
        nodes[me][2] = a + 1 + mid
        bounds[me] = [d[0], d[mid - 1], d[mid], d[-1]]
        todo += [(a + 1 + mid, b, me, 1), (a + 1, a + 1 + mid, me, 0)]
    return order, np.array(nodes, np.int64).reshape(-1, 5), np.array(bounds).reshape(-1, 4)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component in order."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def search(q: np.ndarray, x: np.ndarray, nodes: np.ndarray, bounds: np.ndarray, m2: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x, in tree order) that hold the k best of x for every row of q, ties included.  All queries walk
    the tree together."""
    n, slots = len(q), k + SPARE
    far2 = np.einsum("ij,ij->i", q, q) + m2
    error = 4e-16 * (q.shape[1] + 4) * (far2 + m2)  # of a product, and of a squared distance
    slack = 4 * np.sqrt(error)  # of a distance, which is a root
    best_s, best_i = np.full((n, slots), -np.inf), np.full((n, slots), -1)
    seen = np.zeros((n, len(nodes)), bool)

    def add(active: np.ndarray, a: int, b: int) -> None:
        s = q[active] @ x[a:b].T
        some = np.flatnonzero(s.max(1) > best_s[active, -1])
        if len(some):
            at = active[some]
            both = np.hstack([best_s[at], s[some]])
            who = np.hstack([best_i[at], np.broadcast_to(np.arange(a, b), (len(some), b - a))])
            take = np.argpartition(-both, slots - 1, axis=1)[:, :slots]
            both = np.take_along_axis(both, take, 1)
            sort = np.argsort(-both, axis=1)
            best_s[at], best_i[at] = np.take_along_axis(both, sort, 1), np.take_along_axis(np.take_along_axis(who, take, 1), sort, 1)

    def distance(s: np.ndarray, active: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(far2[active] - 2 * s, 0))

    # first every query's own leaf, for a first bound
    todo = [(0, np.arange(n))] if len(nodes) else []
    while todo:
        me, active = todo.pop()
        a, b, _, left, right = nodes[me]
        if left < 0:
            seen[active, me] = True
            add(active, a, b)
            continue
        near = distance(q[active] @ x[a], active) <= (bounds[me, 1] + bounds[me, 2]) / 2
        todo += [(c, active[m]) for c, m in ((left, near), (right, ~near)) if m.any()]
    todo = [(0, np.arange(n), np.zeros(n))] if len(nodes) else []
    while todo:
        me, active, gap = todo.pop()
        stay = factor * gap <= distance(best_s[active, k - 1], active) + slack[active]
        active = active[stay]
        a, b, _, left, right = nodes[me]
        if left < 0:
            active = active[~seen[active, me]]
            if len(active):
                add(active, a, b)
            continue
        if not len(active):
            continue
        d = distance(q[active] @ x[a], active)
        add(active, a, a + 1)
        lo, hi, lo2, hi2 = bounds[me]
        g = gap[stay]
        s = slack[active]
        inner, outer = np.maximum(g, np.maximum(d - hi, lo - d) - s), np.maximum(g, np.maximum(d - hi2, lo2 - d) - s)
        todo += [(right, active, outer), (left, active, inner)]
    least = best_s[:, k - 1] - 2 * error
    keep = (best_i >= 0) & (best_s >= least[:, None])
    # where the last place is within rounding too, there may be more than the places hold: all of the tree is looked up
    more = np.flatnonzero((best_s[:, -1] >= least) & (best_i[:, -1] >= 0))
    keep[more] = False
    of, slot = np.nonzero(keep)
    rows, found = [of], [best_i[of, slot]]
    for i in more.tolist():
        near = np.flatnonzero(x @ q[i] >= least[i] - error[i])
        rows.append(np.full(len(near), i)), found.append(near)
    return np.concatenate(rows), np.concatenate(found)


def _k_best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of rows (query, score, id) the places of each query's k best, ties to smaller ids."""
    sort = np.lexsort((ids, -score, query))
    q = query[sort]
    head = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))
    return sort[np.arange(len(q)) - first < k]


def nearest(rows: DataFrame, is_query: Column, k: int, factor: float = FACTOR) -> DataFrame:
    """rows: vec_id, embedding; is_query: a condition on vec_id -> query_id, rank, vec_id, score."""
    ready(rows.sparkSession)
    own = materialize(vectors.clean(rows, zero=False), "vp-vectors")
    width = (own.agg(F.max(F.length("v"))).first()[0] or 8) // 8
    rank = F.row_number().over(Wd.partitionBy("v").orderBy("vec_id"))
    few = own.withColumn("r", rank).where(F.col("r") <= k + 1)  # a limit in each task comes before the shuffle
    distinct = materialize(few.groupBy("v", "n2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vp-distinct")
    shards = n_buckets(distinct.count(), SHARD)

    def plant(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("v", kind="stable")
        x, ids, m2 = vectors.matrix(part["v"], width), part["ids"].to_numpy(), float(part["n2"].max())
        order, nodes, bounds = build(x, m2)
        each = [np.asarray(ids[i], np.int64) for i in order.tolist()]
        ends = np.cumsum([len(e) for e in each])
        return pd.DataFrame([{"shard": part["shard"].iloc[0], "x": x[order].tobytes(), "ids": np.concatenate(each).tobytes(), "ends": ends.tobytes(), "nodes": nodes.tobytes(), "bounds": bounds.tobytes(), "m2": m2}])

    shard = F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard")
    trees = distinct.select("v", "n2", "ids", shard).groupBy("shard").applyInPandas(plant, "shard long, x binary, ids binary, ends binary, nodes binary, bounds binary, m2 double")
    trees = materialize(trees, "vp-trees")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    none = [F.lit(None).cast("binary").alias(c) for c in ("x", "ids", "ends", "nodes", "bounds")]
    asks = own.where(is_query).select(every, F.col("vec_id").alias("query_id"), F.col("v").alias("q"), *none, F.lit(None).cast("double").alias("m2"))
    held = trees.select("shard", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("binary").alias("q"), "x", "ids", "ends", "nodes", "bounds", "m2")
    # a shard's tree comes first, then its queries
    met = held.unionAll(asks).repartition(2 * shards, "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())

    def solve(batches):
        tree, at = None, None
        for batch in batches:
            shard_of, is_tree = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (shard_of[1:] != shard_of[:-1]) | (is_tree[1:] != is_tree[:-1])])) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                if is_tree[a]:
                    x, ids, ends, nodes, bounds = (np.frombuffer(batch.column(c)[int(a)].as_py(), kind) for c, kind in zip(range(3, 8), (np.float64, np.int64, np.int64, np.int64, np.float64)))
                    tree, at = (x.reshape(-1, width), ids, ends, nodes.reshape(-1, 5), bounds.reshape(-1, 4), batch.column(8)[int(a)].as_py()), shard_of[a]
                    continue
                if tree is None or at != shard_of[a]:
                    continue
                x, ids, ends, nodes, bounds, m2 = tree
                q_ids, q = batch.column(1).slice(a, b - a).to_numpy(), vectors.matrix(batch.column(2).slice(a, b - a).to_pylist(), width)
                of, found = search(q, x, nodes, bounds, m2, k + 1, factor)
                score = exact(q[of], x[found])
                size = np.diff(ends, prepend=0)[found]
                first = (ends - np.diff(ends, prepend=0))[found]
                row = np.repeat(np.arange(len(of)), size)
                who = ids[first[row] + np.arange(len(row)) - (np.cumsum(size) - size)[row]]
                query, score = q_ids[of[row]], score[row]
                other = np.flatnonzero(who != query)
                take = other[_k_best(query[other], score[other], who[other], k)]
                yield pa.RecordBatch.from_arrays([pa.array(query[take]), pa.array(who[take]), pa.array(score[take])], names=["query_id", "vec_id", "score"])

    return vectors.top(met.mapInArrow(solve, "query_id long, vec_id long, score double"), k)
