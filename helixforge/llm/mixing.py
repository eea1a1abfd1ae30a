"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken target / source_size times.  The whole part of that rate is taken of every
document; what is left is one fractional probability per document, and pivotal rounding makes it 0 or 1: two documents
meet, mass moves between them at random, words kept in sum and expectations kept apart, until one of the two is
integral; the other one meets the next.  So each group leaves one fractional document per source at most, and those
meet again in a reduction tree of a fixed fan-in until one per source is left, which its own probability decides.  Words
taken therefore differ from a source's target by less than one unit: the rows that share a doc_id and a source.

Random numbers are hashes of the seed, the document and the level, and groups are hashes of the document whose number
follows the row count, so reruns agree on any cluster.

Defined results: a null text has size 0; sources come in code-point order, null last, and their weights repeat; rows that
share doc_id and source are one unit, with the sum of their sizes, and get the same number of copies; a source without
words has target 0 and takes nothing; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixforge.operators.primitives import running_total

from .common import join_counted, materialize, n_buckets, ready, whole_text

GROUP, FAN_IN, SEED = 20_000, 64, 42


def words_in(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text: each begins where a word byte follows a blank one."""
    blanks = " \t\n\x0b\x0c\r"
    flat = F.translate(text, blanks, " " * len(blanks))
    parts = F.split(F.trim(flat), " +", -1)
    return F.when(F.trim(flat) == "", F.lit(0)).otherwise(F.size(parts)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """source, size -> source, source_size, target, n_units.  Water filling in closed form: sources in the order of most * size /
    weight reach their limit one after another, and the first that does not ends the filling.  The order is one of ranges
    that are summed apart, so no task holds all sources; four numbers reach the driver."""
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_units"))
    by = running_total(by.select("*", F.col("source").isNull().alias("last"), F.lit(1).alias("one")), ["last", "source"], "one", "place")
    table = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.get(table, (F.col("place") % len(weights)).cast("int")))
    by = by.withColumn("turn", F.col("source_size") / F.col("weight"))
    by = running_total(by, ["turn", "place"], "source_size", "filled")
    by = running_total(by, ["turn", "place"], "weight", "gone")
    words, weight = by.agg(F.sum("source_size"), F.sum("weight")).first()
    # the share per weight if all sources before this one are at their limit
    by = by.withColumn("level", (F.lit(words or 0) - most * F.col("filled")) / (F.lit(weight or 0.0) - F.col("gone")))
    free = F.col("level") * F.col("weight") <= most * F.col("source_size")
    first = by.where(free).agg(F.min(F.struct("turn", "place", "level")).alias("x")).first()["x"]
    full = most * F.col("source_size")
    target = F.least(full, F.lit(first["level"]) * F.col("weight")) if first else full
    return by.select("source", "source_size", target.alias("target"), "n_units")


def _pivot(f: np.ndarray, size: np.ndarray, rnd: np.ndarray) -> np.ndarray:
    """One source's fractions, made integral but for one.  Words are kept: what one gains, times its size, the other loses."""
    f, s, u = f.tolist(), size.tolist(), rnd.tolist()
    i = 0
    for j in range(1, len(f)):
        a, b, sa, sb = f[i], f[j], s[i], s[j]
        up = min((1 - a) * sa, b * sb)  # words that may go to i
        down = min(a * sa, (1 - b) * sb)  # words that may go to j
        if u[j] * (up + down) < down:
            x, whole_i, whole_j = up, (1 - a) * sa <= b * sb, b * sb <= (1 - a) * sa
            f[i], f[j] = 1.0 if whole_i else a + x / sa, 0.0 if whole_j else b - x / sb
        else:
            x, whole_i, whole_j = down, a * sa <= (1 - b) * sb, (1 - b) * sb <= a * sa
            f[i], f[j] = 0.0 if whole_i else a - x / sa, 1.0 if whole_j else b + x / sb
        if f[i] in (0.0, 1.0):
            i = j
    return np.array(f)


def _level(seed: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.uint64(((seed * 1_000_003 + level + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
        mixed = rows["h"].to_numpy(np.int64).astype(np.uint64) ^ rng
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        rows["u"] = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11)) / float(1 << 53)
        # long documents first: the one that stays fractional then tends to be short
        rows = rows.sort_values(["place", "size", "u", "h"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
        f = rows["f"].to_numpy().copy()
        for at in rows.groupby("place", sort=False).indices.values():
            f[at] = _pivot(f[at], rows["size"].to_numpy()[at], rows["u"].to_numpy()[at])
        return rows.drop(columns="u").assign(f=f)

    return run


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every row: the only pass over the texts."""
    return materialize(docs.select("doc_id", "source", words_in(whole_text()).alias("size")), "mix-sizes")


def mix(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """Output of sized -> one row per unit: doc_id, source, rows, source_size, target, copies."""
    ready(sizes.sparkSession)
    units = materialize(sizes.groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "mix-units")
    total = units.count()
    aims = targets(units, weights, most).withColumn("place", F.coalesce(F.xxhash64("source"), F.lit(0)))
    # a null source is joined as one, and a source with most of all rows does not meet in one task
    key = lambda df: df.withColumns({"__source": F.coalesce("source", F.lit("")), "__none": F.col("source").isNull()})
    joined = join_counted(key(units), key(aims).drop("source"), ["__source", "__none"], total, "n_units")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    first = joined.select("doc_id", "source", "size", "rows", "source_size", "target", "place", rate.alias("rate"))
    first = first.select("*", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("f"), F.xxhash64(F.lit(seed), "doc_id", "source").alias("h"))
    buckets = n_buckets(total, GROUP)
    keep = ["doc_id", "source", "size", "rows", "source_size", "target", "place", "base", "f", "h", "bucket"]
    left = first.withColumn("bucket", F.pmod("h", F.lit(buckets))).select(*keep)
    whole = (F.col("f") == 0) | (F.col("f") == 1) | (F.col("size") == 0)
    done = [left.where(whole)]
    left, level = left.where(~whole), 0
    while True:
        rounded = materialize(left.groupBy("bucket").applyInPandas(_level(seed, level), left.schema), f"mix-{level}")
        done.append(rounded.where(whole))
        left = rounded.where(~whole)
        if buckets == 1:
            break
        buckets, level = n_buckets(buckets, FAN_IN), level + 1
        left = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    done.append(left.withColumn("f", (chance < F.col("f")).cast("double")))
    every = done[0]
    for d in done[1:]:
        every = every.unionAll(d)
    copies = F.when(F.col("size") == 0, F.col("base")).otherwise(F.col("base") + F.round("f")).cast("int")
    return every.select("doc_id", "source", "size", "rows", "source_size", "target", copies.alias("copies"))


def report(sizes: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    one = mixed.where("rows = 1").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    shared = mixed.where("rows > 1").select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), "source_size", "target", "copies")
    several = sizes.join(shared, sizes["doc_id"].eqNullSafe(shared["m_id"]) & sizes["source"].eqNullSafe(shared["m_source"]))
    return one.unionAll(several.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")))


def apply(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, each as often as its unit is taken; columns as in docs."""
    some = mixed.where("copies > 0").select(F.col("doc_id").alias("__m_id"), F.col("source").alias("__m_source"), F.col("copies").alias("__m_copies"))
    joined = docs.join(some, docs["doc_id"].eqNullSafe(some["__m_id"]) & docs["source"].eqNullSafe(some["__m_source"]))
    return joined.withColumn("__m_copy", F.explode(F.sequence(F.lit(1), "__m_copies"))).select(*[docs[c] for c in docs.columns])
