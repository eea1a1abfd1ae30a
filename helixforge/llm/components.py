"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, join_counted, materialize


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return join_counted(both, least, ["a"], 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_counted(down, least, ["a"], total).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges: a, b (long; either order, repeats and loops allowed) -> node, component (the smallest node it reaches), for
    every node with an edge to another.  Each round is two equi-joins on nodes and is written down; the rounds grow with
    the logarithm of the longest path.  The neighbours of a node that has very many stay in their tasks; nothing but two
    numbers a round reaches the driver.  No edges give no rows.  most: at least the number of edges, if the caller knows."""
    edges = edges.select("a", "b").where("a <> b").distinct()
    now = materialize(edges if most is None else few(edges, most), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        large = materialize(few(_large_star(now, state[0]).where("a <> b").distinct(), 2 * state[0]), "stars")
        rows = large.count()
        now = materialize(few(_small_star(large, rows).where("a <> b").distinct(), 2 * rows), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
