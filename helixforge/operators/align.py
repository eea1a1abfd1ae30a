"""Shifted Hamming alignment of candidates to anchors, on both strands.

A shift s puts the candidate's first letter at the anchor's place s (from 0).  Of the shifts whose overlap is at least
the minimum, the one with the least cost is taken: mismatches plus letters of both reads outside the overlap; ties go to
the smaller |s|, then to the smaller s.  It is valid if its mismatches are at most max_error_rate of the overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixforge.functions.sequence import reverse_complement
from helixforge.operators.letters import letters
from helixforge.options import Options

FORWARD, REVERSE, NONE = 1, 2, 3
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[ord(c) for c in "ACGT"]] = [ord(c) for c in "TGCA"]
SCHEMA = "f_shift int, f_overlap int, f_ops int, f_valid boolean, r_shift int, r_overlap int, r_ops int, r_valid boolean"


def _matrix(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters by row, with zeros after a shorter sequence, and the lengths."""
    flat, length = letters(strings)
    width = int(length.max(initial=1)) or 1
    out = np.zeros((len(length), width), np.uint8)
    out[np.arange(width) < length[:, None]] = flat
    return out, length.astype(np.int32)


def best_shifts(a: np.ndarray, la: np.ndarray, c: np.ndarray, lc: np.ndarray, min_overlap: np.ndarray, max_error_rate: float):
    """Shift, overlap, mismatches and validity for each row of a and c.  All rows are tried with one shift after another."""
    n = len(a)
    none = np.int64(2**62)
    best = np.full(n, none)
    shift, overlap, ops = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    low, high = -int((lc - min_overlap).max(initial=0)), int((la - min_overlap).max(initial=0))
    # a letter of all rows side by side; what fills up shorter sequences differs, so it never counts as the same
    at, ct = a.T.copy(), c.T.copy()
    ct[ct == 0] = 1
    for s in sorted(range(low, high + 1), key=lambda s: (abs(s), s)):
        first, end = max(0, s), np.minimum(la, lc + s)
        own = end - first
        outside = (la - own) + (lc - own)
        may = (own >= min_overlap) & (outside < best)  # else no number of mismatches makes it better
        if not may.any():
            continue
        width = min(len(at) - first, len(ct) - max(0, -s))
        x, y = at[first : first + width], ct[max(0, -s) : max(0, -s) + width]
        same = (x == y).view(np.uint8).sum(0, dtype=np.uint8 if width < 256 else np.int32).astype(np.int32)
        cost = np.where(may, (own - same + outside).astype(np.int64), none)
        better = cost < best
        best[better], shift[better], overlap[better], ops[better] = cost[better], s, own[better], (own - same)[better]
    valid = (overlap > 0) & (ops <= np.float64(max_error_rate) * overlap)
    return shift, overlap, ops, valid


def align(pairs: DataFrame, reads: DataFrame, options: Options) -> DataFrame:
    """anchor_id, cand_id -> the best forward and reverse alignment of each pair.  Sequences are joined to the final pairs
    only; letters become byte matrices in Arrow batches."""
    a = reads.select(F.col("read_id").alias("anchor_id"), F.col("sequence").alias("anchor"))
    c = reads.select(F.col("read_id").alias("cand_id"), F.col("sequence").alias("cand"))
    both = pairs.select("anchor_id", "cand_id").join(c, "cand_id").join(a, "anchor_id").select("anchor_id", "cand_id", "anchor", "cand")
    ratio, least, rate = options.min_overlap_ratio, options.min_overlap, options.max_error_rate

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, la = _matrix(batch.column(2))
            c, lc = _matrix(batch.column(3))
            need = np.maximum((la.astype(np.float32) * np.float32(ratio)).astype(np.int32), least)
            back = np.zeros_like(c)
            place = lc[:, None] - 1 - np.arange(c.shape[1])
            inside = place >= 0
            back[inside] = _COMPLEMENT[np.take_along_axis(c, np.maximum(place, 0), 1)[inside]]
            columns = [*best_shifts(a, la, c, lc, need, rate), *best_shifts(a, la, back, lc, need, rate)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in columns)], names=["anchor_id", "cand_id", *names])

    return both.mapInArrow(run, f"anchor_id long, cand_id long, {SCHEMA}")


def orientation(anchor_length: Column, options: Options, max_error_rate: float | None = None) -> Column:
    """FORWARD, REVERSE or NONE from the columns of align: the smaller rate of mismatches wins, then the longer overlap, and
    with both equal the reverse strand; the rate must be under the limit."""
    limit = F.lit(options.max_error_rate if max_error_rate is None else max_error_rate)
    least = F.greatest((anchor_length * options.min_overlap_ratio).cast("int"), F.lit(options.min_overlap))
    rate = lambda s: F.when(F.col(f"{s}_valid") & (F.col(f"{s}_overlap") >= least), F.col(f"{s}_ops") / F.col(f"{s}_overlap"))
    f, r = rate("f"), rate("r")
    forward = r.isNull() | (f < r) | ((f == r) & (F.col("f_overlap") > F.col("r_overlap")))
    return F.when(f.isNotNull() & forward, F.when(f < limit, FORWARD).otherwise(NONE)).otherwise(F.when(r.isNotNull() & (r < limit), REVERSE).otherwise(NONE))


def estimated_limit(options: Options) -> float:
    """The limit when it is taken from the estimated error rate."""
    return options.estimated_error_rate * 4


def overlap_weight(ops: Column, overlap: Column, max_mismatch_ratio: float) -> Column:
    return 1 - F.sqrt(ops / (overlap * max_mismatch_ratio))


def overlap_weight_by_length(anchor_length: Column, ops: Column, overlap: Column) -> Column:
    r = overlap / anchor_length
    return r * (r + (overlap - ops) * 0.2) / (1 + overlap * 0.2)


def micro(w: Column) -> Column:
    """A weight in millionths, as sums of whole numbers do not depend on the order of rows."""
    return F.floor(w * 1_000_000 + 0.5).cast("long")


def good(aligned: DataFrame, reads: DataFrame, options: Options) -> DataFrame:
    """Candidates with an orientation: anchor_id, cand_id, orientation, shift, overlap, n_ops, weight (millionths)."""
    n = reads.select(F.col("read_id").alias("anchor_id"), F.length("sequence").alias("n"))
    which = aligned.join(n, "anchor_id").withColumn("orientation", orientation(F.col("n"), options)).where(F.col("orientation") != NONE)
    chosen = lambda c: F.when(F.col("orientation") == FORWARD, F.col(f"f_{c}")).otherwise(F.col(f"r_{c}"))
    out = which.select("anchor_id", "cand_id", "orientation", chosen("shift").alias("shift"), chosen("overlap").alias("overlap"), chosen("ops").alias("n_ops"))
    return out.withColumn("weight", micro(overlap_weight(F.col("n_ops"), F.col("overlap"), options.max_error_rate)))


def by_rate(found: DataFrame, options: Options) -> DataFrame:
    """Keeps, for each anchor, the candidates under the least of 2, 3 and 4 times the estimated error rate that enough of
    them (m_coverage * coverage) are under, or those under 4 times it."""
    e, enough = options.estimated_error_rate, options.m_coverage * options.estimated_coverage
    rate = F.col("n_ops") / F.col("overlap")
    counts = found.groupBy("anchor_id").agg(*[F.count_if(rate < k * e).alias(f"c{k}") for k in (2, 3)])
    limit = F.when(F.col("c2") >= enough, 2 * e).when(F.col("c3") >= enough, 3 * e).otherwise(4 * e)
    return found.join(counts.select("anchor_id", limit.alias("limit")), "anchor_id").where(rate < F.col("limit")).drop("limit")


def oriented(found: DataFrame, reads: DataFrame) -> DataFrame:
    """The candidates' letters on the anchor's strand: adds sequence, and quality if the reads have it."""
    some = reads.select(F.col("read_id").alias("cand_id"), *[c for c in ("sequence", "quality") if c in reads.columns])
    joined = found.join(some, "cand_id")
    back = F.col("orientation") == REVERSE
    out = joined.withColumn("sequence", F.when(back, reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))
    return out.withColumn("quality", F.when(back, F.reverse("quality")).otherwise(F.col("quality"))) if "quality" in reads.columns else out
