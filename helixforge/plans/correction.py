"""The whole correction as one plan: reads -> sketches -> candidates -> alignments -> columns -> corrections -> reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixforge.operators import align, candidates, forest, kmers, msa, whole
from helixforge.operators import correct as rule
from helixforge.operators.reads import exclude_ambiguous
from helixforge.operators.primitives import first_ids
from helixforge.options import Options
from helixforge.storage import materialize, materialize_rounds, release, shuffles_dropped


@dataclass
class Steps:
    """The tables between the steps; those that several steps read are written down."""

    reads: DataFrame
    found: DataFrame
    oriented: DataFrame
    built: DataFrame
    columns: DataFrame
    properties: DataFrame


def sketch(reads: DataFrame, options: Options) -> DataFrame:
    return kmers.minhash(reads, options.kmer_length, options.hash_functions, options.kmer_mask)


ROUND = 1 << 19  #: pairs that are worth a round of their own


def _parts(pairs: DataFrame, reads: DataFrame) -> list[DataFrame]:
    """pairs by anchor, in so many parts that each has half as many pairs as there are reads, or a ROUND: a candidate's
    letters are shuffled for each pair, and those of one part are on disk at a time.  Each part reads all reads again, so this
    is for reads in buckets, which are not shuffled for it."""
    if not vars(reads).get("_by"):
        return [pairs]
    with shuffles_dropped(reads.sparkSession):
        n, n_reads = pairs.count(), reads.count()
    parts = max(1, min(-(-2 * n // max(1, n_reads)), -(-n // ROUND)))
    if parts == 1:
        return [pairs]
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(parts))
    return [pairs.where(part == i) for i in range(parts)]


def _found(reads: DataFrame, options: Options, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reads, those that are indexed, and the candidates.  What only the next step reads is deleted after it."""
    reads = materialize(first_ids(reads, options.first_reads), "reads", by="read_id")
    indexed = exclude_ambiguous(reads) if options.exclude_ambiguous else reads
    given = keys is not None
    keys = keys if given else materialize(sketch(indexed, options), "keys")
    pairs = candidates.pairs_in_rounds(keys, options.bucket_limit)
    if not given:
        release(keys)
    parts = _parts(pairs, reads)
    found = materialize_rounds((align.good(align.align(some, indexed, options), indexed, options) for some in parts), "good")
    release(pairs)
    if options.paired:
        # of unpaired candidates only those with few mismatches
        mates = candidates.paired(found.select("anchor_id", "cand_id"))
        both = found.join(mates, ["anchor_id", "cand_id"])
        found = both.where(f"is_paired or n_ops / overlap <= {options.paired_filter_threshold}").drop("is_paired")
    if options.bin_by_rate:
        found = align.by_rate(found, options)
    return reads, indexed, found


def steps(reads: DataFrame, options: Options, refine: bool = True, keys: DataFrame | None = None) -> Steps:
    """reads: read_id, sequence and, if they are used, quality; they are written down once, by all that reads them again.
    keys: saved tables instead of new ones."""
    reads, indexed, found = _found(reads, options, keys)
    oriented = align.oriented(found, indexed if options.use_quality else indexed.drop("quality"))
    built = msa.rows(oriented, indexed if options.use_quality else indexed.drop("quality"))
    if refine:
        built, columns = msa.refined(materialize(built, "built"), options, options.use_quality)
        oriented = oriented.join(built.where("cand_id is not null").select("anchor_id", "cand_id"), ["anchor_id", "cand_id"], "left_semi")
    else:
        columns = materialize(msa.columns(built, options.use_quality), "columns")
    return Steps(reads, found, oriented, built, columns, msa.properties(columns, options))


@dataclass
class Whole:
    """The reads, the candidates, the rows of each anchor together, and what whole.corrections makes of them, written down."""

    reads: DataFrame
    found: DataFrame
    rows: DataFrame
    corrections: DataFrame

    @property
    def primary(self) -> DataFrame:
        return self.corrections.where("anchor_id is null").drop("anchor_id")

    @property
    def secondary(self) -> DataFrame:
        return self.corrections.where("anchor_id is not null").select("read_id", "anchor_id", "sequence")


def at_once(reads: DataFrame, options: Options, refine: bool = True, keys: DataFrame | None = None) -> Whole:
    """The corrections by the rule, without a table of columns.  Weights of qualities are left to steps."""
    reads, indexed, found = _found(reads, options, keys)
    own = indexed.select("read_id", "sequence")
    gathered = lambda some: whole.gathered(some, align.oriented(some, own), own)
    rounds = (whole.corrections(gathered(some), options, refine) for some in _parts(found, reads))
    return Whole(reads, found, gathered(found), materialize_rounds(rounds, "corrections"))


@dataclass
class Corrected:
    """results: read_id, sequence, q for every read; decided: the same of those reads at least whose correction stands (all
    others stay as they were, at 0).  features and features_candidates: what print mode asks for, else
    nothing."""

    results: DataFrame
    decided: DataFrame
    features: DataFrame | None = None
    features_candidates: DataFrame | None = None


def correct(reads: DataFrame, options: Options, refine: bool = True, trees: list | None = None, keys: DataFrame | None = None, trees_candidates: list | None = None) -> Corrected:
    """The whole correction.  classic: the rule.  forest: letters change where the forest of anchors (and that of candidates) says
    so.  print: the rule, and the features that a forest would be asked about, for training."""
    if not options.use_quality and options.correction_type != "forest" and (not options.correct_candidates or options.correction_type_candidates == "classic"):
        w = at_once(reads, options, refine, keys)
        stands = materialize(rule.decided(w.primary, w.secondary if options.correct_candidates else None), "decided")
        results = w.reads.select("read_id", F.col("sequence").alias("was")).join(stands, "read_id", "left")
        results = results.select("read_id", F.coalesce("sequence", "was").alias("sequence"), F.coalesce("q", F.lit(0)).alias("q"))
        if options.correction_type == "print":
            return Corrected(results, stands, whole.asked(w.corrections))
        release(w.corrections)
        return Corrected(results, stands)
    s = steps(reads, options, refine, keys)
    asked = asked_candidates = secondary = None
    if options.correction_type == "forest":
        if not trees:
            raise ValueError("a forest is needed")
        primary = forest.correct(s.columns, s.properties, trees, options)
    else:
        primary = rule.anchors(s.columns, s.properties, options)
        if options.correction_type == "print":
            asked = forest.anchor_features(s.columns, s.properties, options)
    if options.correct_candidates:
        if options.correction_type_candidates == "forest":
            if not trees_candidates:
                raise ValueError("a forest for candidates is needed")
            secondary = forest.correct_candidates(forest.candidate_features(s.oriented, s.columns, s.properties, options), trees_candidates, options)
        else:
            secondary = rule.candidates(s.oriented, s.columns, s.properties, options)
            if options.correction_type_candidates == "print":
                asked_candidates = forest.candidate_features(s.oriented, s.columns, s.properties, options).where("f is not null")
    results = rule.combine(materialize(primary, "primary"), secondary, s.reads)
    return Corrected(results, results, asked, asked_candidates)


def corrected(reads: DataFrame, options: Options, refine: bool = True, trees: list | None = None, keys: DataFrame | None = None, trees_candidates: list | None = None) -> DataFrame:
    """read_id, sequence, q for every read."""
    return correct(reads, options, refine, trees, keys, trees_candidates).results
