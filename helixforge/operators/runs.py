"""Runs of the engine compared: ext, anchor_threshold, candidate_threshold, sample, tp, fp, fn, tn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from helixforge.operators.primitives import running_least

CONFIG = ["ext", "anchor_threshold", "candidate_threshold"]


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation logs named sample_..._ext_...: lines TP:, FP:, FN:, TN: after a line of the output file, whose name ends in
    at-ct before its last part."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("i"), "value")
    at = F.when(F.col("value").startswith("out/"), F.regexp_extract("value", r"(\d+-\d+)\.[^.]*$", 1))
    run = F.last(at, ignorenulls=True).over(Wd.partitionBy("file").orderBy("i"))
    marked = lines.withColumn("run", run)
    number = lambda k: F.max(F.when(F.col("value").startswith(k), F.regexp_extract("value", r"(\d+)\s*$", 1).cast("long")))
    by = marked.where("run is not null").groupBy("file", "run").agg(*[number(k).alias(k.lower()) for k in ("TP", "FP", "FN", "TN")])
    name = F.split("file", "_")
    return by.select(
        F.element_at(name, -2).alias("ext"), F.split("run", "-")[0].cast("int").alias("anchor_threshold"), F.split("run", "-")[1].cast("int").alias("candidate_threshold"), name[0].alias("sample"), "tp", "fp", "fn", "tn"
    )


def last_wins(runs: DataFrame, order: str) -> DataFrame:
    """One row for each run and sample: the last in `order`; n_seen says how many there were."""
    key = [*CONFIG, "sample"]
    return runs.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in ("tp", "fp", "fn", "tn")], F.count("*").alias("n_seen"))


def common_samples(runs: DataFrame) -> DataFrame:
    """Rows of the samples that every run has."""
    n = runs.select(*CONFIG).distinct().agg(F.count("*").alias("n_runs"))
    by = runs.select(*CONFIG, "sample").distinct().groupBy("sample").agg(F.count("*").alias("n"))
    shared = by.join(F.broadcast(n), F.col("n") == F.col("n_runs")).select("sample")
    return runs.join(shared, "sample", "left_semi")


def require(runs: DataFrame, samples: list[str]) -> DataFrame:
    """Rows of the listed samples, of the runs that have them all."""
    own = runs.where(F.col("sample").isin(samples))
    full = own.groupBy(*CONFIG).agg(F.count_distinct("sample").alias("n")).where(F.col("n") == len(set(samples))).select(*CONFIG)
    return own.join(full, CONFIG, "left_semi")


def totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*CONFIG).agg(F.sum("tp").cast("long").alias("tp"), F.sum("fp").cast("long").alias("fp"))


def frontier(summed: DataFrame, by: str | None = "ext", keep=None) -> DataFrame:
    """Runs that no other run beats: none has as many tp or more with fewer fp, or more tp with as few fp.  Equal points are
    all kept.  by: within each value of a column (None: over all).  keep: a condition on runs that always stay."""
    # one row for each tp first, so a window holds distinct values; over all runs, ranges of tp are taken apart
    best = summed.groupBy(*([by] if by else []), "tp").agg(F.min("fp").alias("best"))
    if by:
        more = Wd.partitionBy(by).orderBy(F.col("tp").desc()).rowsBetween(Wd.unboundedPreceding, -1)
        best = best.withColumn("beaten", F.min("best").over(more))
    else:
        best = running_least(best.withColumn("down", -F.col("tp")), ["down"], "best", "beaten")
    line = best.where(F.col("beaten").isNull() | (F.col("best") < F.col("beaten")))
    on = [*([by] if by else []), "tp"]
    kept = summed.join(line.select(*on, "best"), on, "left").where((F.col("fp") == F.col("best")) | (keep if keep is not None else F.lit(False)))
    return kept.select(*CONFIG, "tp", "fp")
