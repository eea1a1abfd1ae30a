"""Weighted multiple alignments as grouped columns.

Rows of an alignment are the anchor (shift 0, weight 1) and its oriented candidates; column 0 is the anchor's first
letter.  Weights are whole millionths, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from helixforge.functions import quality as Q
from helixforge.functions.sequence import at_least
from helixforge.options import Options
from helixforge.storage import materialize

BASES = ("A", "C", "G", "T")
UNIT = 1_000_000
SHARE = 0.3  #: of a column's rows, that a significant base has


def rows(found: DataFrame, reads: DataFrame) -> DataFrame:
    """anchor_id, cand_id (null for the anchor itself), shift, weight, sequence, quality (if there), for every anchor with a
    candidate.  found: output of align.oriented."""
    extra = ["quality"] if "quality" in found.columns and "quality" in reads.columns else []
    own = found.select("anchor_id").distinct().join(reads.select(F.col("read_id").alias("anchor_id"), "sequence", *extra), "anchor_id")
    anchors = own.select("anchor_id", F.lit(None).cast("long").alias("cand_id"), F.lit(0).alias("shift"), F.lit(UNIT).cast("long").alias("weight"), "sequence", *extra)
    return found.select("anchor_id", "cand_id", F.col("shift").cast("int").alias("shift"), "weight", "sequence", *extra).unionAll(anchors)


def letters(built: DataFrame, use_quality: bool = False) -> DataFrame:
    """anchor_id, cand_id, col, base, w: a row for each letter; with qualities its weight is the row's times the quality's."""
    each = built.select("*", F.explode(F.sequence(F.lit(1), F.length("sequence"))).alias("i"))
    w = F.col("weight")
    if use_quality and "quality" in built.columns:
        w = F.floor(w * Q.weight(F.substr("quality", F.col("i"), F.lit(1))) + 0.5).cast("long")
    base = F.substr("sequence", F.col("i"), F.lit(1))
    return each.select("anchor_id", "cand_id", (F.col("shift") + F.col("i") - 1).alias("col"), base.alias("base"), w.alias("w"))


def columns(built: DataFrame, use_quality: bool = False) -> DataFrame:
    """anchor_id, col, n_a..n_t, w_a..w_t, coverage, consensus, support, anchor_base, orig_weight, orig_coverage.  The heaviest
    base is the consensus, the first of A, C, G, T on a tie; support is its share of the weight.  Anchor columns are null
    outside the anchor."""
    each = letters(built, use_quality)
    is_anchor = F.col("cand_id").isNull()
    sums = each.groupBy("anchor_id", "col").agg(
        *[F.count_if(F.col("base") == b).cast("int").alias(f"n_{b.lower()}") for b in BASES],
        *[F.sum(F.when(F.col("base") == b, F.col("w")).otherwise(0)).alias(f"w_{b.lower()}") for b in BASES],
        F.count("*").cast("int").alias("coverage"),
        F.max(F.when(is_anchor, F.ascii("base"))).alias("anchor_code"),  # a number, so that rows are hashed and not sorted
    )
    sums = sums.withColumn("anchor_base", F.chr("anchor_code")).drop("anchor_code")
    w = {b: F.col(f"w_{b.lower()}") for b in BASES}
    top = F.greatest(*w.values())
    consensus = F.coalesce(*[F.when(w[b] == top, F.lit(b)) for b in BASES])
    total = sum((w[b] for b in BASES[1:]), w["A"])
    of = lambda prefix: F.coalesce(*[F.when(F.col("anchor_base") == b, F.col(f"{prefix}_{b.lower()}")) for b in BASES])
    return sums.withColumns({
        "consensus": consensus,
        "support": F.when(total > 0, top / total).otherwise(0.0),
        "orig_weight": of("w"),
        "orig_coverage": of("n"),
    })


def properties(cols: DataFrame, options: Options, first: Column | None = None, end: Column | None = None) -> DataFrame:
    """avg_support, min_support, min_coverage, max_coverage and the quality of the consensus over a range of columns (the
    anchor's, if none is given)."""
    inside = F.col("anchor_base").isNotNull() if first is None else (F.col("col") >= first) & (F.col("col") < end)
    t = options.high_quality
    summed = cols.where(inside).groupBy("anchor_id").agg(
        F.round(F.avg("support"), 6).alias("avg_support"),
        F.round(F.min("support"), 6).alias("min_support"),
        F.min("coverage").alias("min_coverage"),
        F.max("coverage").alias("max_coverage"),
    )
    low_avg, low_min, low_cov = (~at_least(F.col(c), F.lit(t[k])) for c, k in (("avg_support", "avg"), ("min_support", "min"), ("min_coverage", "coverage")))
    hq = ~low_avg & ~low_min & ~low_cov & at_least(F.col("avg_support"), F.lit(t["hq_avg"])) & at_least(F.col("min_support"), F.lit(t["hq_min"]))
    return summed.withColumns({"failed_avg": low_avg, "failed_min": low_min, "failed_coverage": low_cov, "is_hq": hq})


def significant(cols: DataFrame, options: Options, share: float = SHARE) -> DataFrame:
    """anchor_id, col, letter, ratio: columns of the anchor where two bases or more have at least two rows and `share` of the
    coverage each, a row for each such base."""
    each = cols.where("anchor_base is not null").select(
        "anchor_id", "col", F.explode(F.array(*[F.struct(F.lit(b).alias("letter"), F.col(f"n_{b.lower()}").alias("n"), (F.col(f"n_{b.lower()}") / F.col("coverage")).alias("ratio")) for b in BASES])).alias("x")
    )
    some = each.where((F.col("x.n") >= 2) & (F.col("x.ratio") >= share)).select("anchor_id", "col", "x.letter", "x.ratio")
    many = F.count("*").over(Wd.partitionBy("anchor_id", "col"))
    return some.withColumn("__n", many).where("__n >= 2").drop("__n")


def region_selection(built: DataFrame, cols: DataFrame, options: Options) -> DataFrame:
    """anchor_id, cand_id, col, dropped: for anchors with a significant column, the candidates that cover the first one, and
    whether their letter there is another than the anchor's."""
    first = significant(cols, options).groupBy("anchor_id").agg(F.min("col").alias("col"))
    at = built.join(first, "anchor_id").withColumn("letter", F.substr("sequence", F.col("col") - F.col("shift") + 1, F.lit(1)))
    inside = (F.col("col") >= F.col("shift")) & (F.col("col") < F.col("shift") + F.length("sequence"))
    own = at.where("cand_id is null").select("anchor_id", F.col("letter").alias("anchor_letter"))
    return at.where("cand_id is not null").where(inside).join(own, "anchor_id").select("anchor_id", "cand_id", "col", (F.col("letter") != F.col("anchor_letter")).alias("dropped"))


def refined(built: DataFrame, options: Options, use_quality: bool = False) -> tuple[DataFrame, DataFrame]:
    """Drops candidates of another region until no anchor has a significant column that parts them, at most refine_passes
    times -> the rows that are left, and their columns.  An anchor that loses none in a pass is settled: later passes see the
    others only, and its columns are those of that pass.  Each pass is written down, so the plan does not grow."""
    settled: list[tuple[DataFrame, DataFrame]] = []
    cols = materialize(columns(built, use_quality), "columns")
    for _ in range(options.refine_passes):
        out = region_selection(built, cols, options).where("dropped").select("anchor_id", "cand_id")
        out = materialize(out, "region")
        if out.isEmpty():
            break
        changed = out.select("anchor_id").distinct()
        settled.append(tuple(df.join(changed, "anchor_id", "left_anti") for df in (built, cols)))
        built = materialize(built.join(changed, "anchor_id", "left_semi").join(out, ["anchor_id", "cand_id"], "left_anti"), "refined")
        cols = materialize(columns(built, use_quality), "columns")
    for rows, own in settled:
        built, cols = rows.unionByName(built), own.unionByName(cols)
    return (materialize(built, "settled"), materialize(cols, "settled")) if settled else (built, cols)


def refine(built: DataFrame, options: Options) -> DataFrame:
    """The rows that refined leaves."""
    return refined(built, options)[0]


def clusters(built: DataFrame, cols: DataFrame, options: Options) -> DataFrame:
    """anchor_id, signature, cand_ids: candidates by their letters at the significant columns ('-' where they have none)."""
    at = significant(cols, options).select("anchor_id", "col").distinct().groupBy("anchor_id").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    letter = lambda c: F.when((c >= F.col("shift")) & (c < F.col("shift") + F.length("sequence")), F.substr("sequence", c - F.col("shift") + 1, F.lit(1))).otherwise("-")
    signed = built.where("cand_id is not null").join(at, "anchor_id").select("anchor_id", "cand_id", F.array_join(F.transform("cols", letter), "").alias("signature"))
    return signed.groupBy("anchor_id", "signature").agg(F.array_sort(F.collect_list("cand_id")).alias("cand_ids"))


def shown(built: DataFrame) -> DataFrame:
    """anchor_id, line: the rows of each alignment as text, the anchor first."""
    least = F.min("shift").over(Wd.partitionBy("anchor_id"))
    return built.select("anchor_id", "cand_id", F.concat(F.repeat(F.lit(" "), F.col("shift") - least), "sequence").alias("line")).orderBy("anchor_id", F.col("cand_id").asc_nulls_first())


