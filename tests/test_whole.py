"""Corrections of whole anchors against those from columns, and what stays on disk."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixforge import storage
from helixforge.operators import align, candidates, correct, evaluate, forest, whole
from helixforge.options import Options
from helixforge.plans import correction

BASE = Options(kmer_length=10, hash_functions=6, estimated_coverage=12.0, correct_candidates=True)


@pytest.fixture(scope="module")
def reads(spark):
    """Reads of many lengths, on both strands, from two near-equal genomes, with wrong letters and an N here and there."""
    rng = random.Random(5)
    one = "".join(rng.choice("ACGT") for _ in range(500))
    two = "".join(b if i % 40 else "ACGT"[("ACGT".index(b) + 1) % 4] for i, b in enumerate(one))
    rows = []
    for i in range(240):
        at, size = rng.randrange(420), rng.randrange(50, 80)
        s = list((one if i % 3 else two)[at : at + size])
        for j in range(len(s)):
            if rng.random() < 0.01:
                s[j] = rng.choice("ACGTN")
        s = "".join(s)
        rows.append((i, s if i % 2 else s[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return spark.createDataFrame(rows, "read_id long, sequence string")


def listed(df):
    return sorted(df.collect(), key=repr)


@pytest.mark.parametrize("refine", [True, False])
def test_whole_anchors_equal_those_from_columns(spark, reads, refine):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # anchors lie in several batches
    try:
        s, w = correction.steps(reads, BASE, refine), correction.at_once(reads, BASE, refine)
        primary, secondary = correct.anchors(s.columns, s.properties, BASE), correct.candidates(s.oriented, s.columns, s.properties, BASE)
        found = listed(w.primary.select("read_id", "is_hq", "sequence"))
        assert found == listed(primary.select("read_id", "is_hq", "sequence")) and {r.is_hq for r in found} == ({True, False} if refine else {False})
        assert listed(w.secondary) == listed(secondary) and secondary.isEmpty() != refine
        assert listed(correction.correct(reads, BASE, refine).results) == listed(correct.combine(primary, secondary, reads))
        rounded = lambda df: listed(df.withColumn("f", F.transform("f", lambda x: F.round(x, 9))))
        assert rounded(whole.features(w.rows, BASE, refine)) == rounded(forest.anchor_features(s.columns, s.properties, BASE))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reads_are_looked_up_for_no_vote(spark, reads):
    options = replace(BASE, correct_candidates=False)
    s = correction.steps(reads, options)
    assert listed(correction.correct(reads, options).results) == listed(correct.combine(correct.anchors(s.columns, s.properties, options), None, reads))


def shuffled(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()


def test_a_correction_leaves_no_columns_keys_or_shuffles(spark, reads):
    spark.sparkContext._jvm.System.gc()
    before, blocks = len(storage._made), shuffled(spark)
    correction.correct(reads, BASE)
    left = sorted(p.rsplit("/", 1)[1].split("-")[0] for _, p in storage._made[before:])
    assert left == ["decided", "good", "reads"]
    assert shuffled(spark) <= blocks


def test_what_is_written_is_not_written_again(spark):
    own = storage.materialize(spark.range(5), "once")
    assert storage.materialize(own, "twice") is own and own.count() == 5
    storage.release(own)
    assert own._path not in {p for _, p in storage._made}


def test_shifts_of_one_pair_and_of_unequal_lengths():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [(x := text(60), x[20:] + text(300)), (text(300), text(40)), (text(35), text(35))]
    for some in (pairs[:1], pairs):
        (a, la), (c, lc) = (align._matrix(pa.array([p[i] for p in some])) for i in (0, 1))
        got = align.best_shifts(a, la, c, lc, np.full(len(some), 30), 0.2)
        for i, (p, q) in enumerate(some):
            tries = []
            for s in range(-len(q), len(p)):
                own = min(len(p), len(q) + s) - max(0, s)
                ops = sum(p[j] != q[j - s] for j in range(max(0, s), max(0, s) + own))
                tries += [(ops + len(p) + len(q) - 2 * own, abs(s), s, own, ops)] if own >= 30 else []
            _, _, s, own, ops = min(tries)
            assert tuple(x[i] for x in got[:3]) == (s, own, ops)


def test_letters_beside_are_judged_as_joined_ones(spark):
    rows = [(0, "ACGT", "ACGA", "ACGA"), (1, "", "", ""), (2, "AAAA", "aaaa", "ACAA"), (3, "TTTT", "TATA", "TTTA"), (4, "A", "C", "G")]
    df = spark.createDataFrame(rows, "read_id long, original string, perfect string, now string")
    of = lambda c: df.select("read_id", F.col(c).alias("sequence"))
    joined = evaluate.per_read(evaluate.aligned(of("original"), of("perfect"), {"x": of("now"), "y": of("original")}))
    found = listed(evaluate.beside(df, {"x": "now", "y": "original"}))
    assert found == listed(joined) and tuple(found[3]) == ("x", 3, 1, 0, 1, 2) and tuple(found[4]) == ("x", 4, 0, 0, 1, 0)
    with pytest.raises(Exception, match="lengths differ: read 2"):
        evaluate.beside(df.withColumn("now", F.when(F.col("read_id") == 2, "A").otherwise(F.col("now"))), {"x": "now"}).collect()


def test_merging_what_stands_equals_merging_all_results(spark, reads):
    own = reads.withColumn("header", F.lit("x")).withColumn("quality", F.col("sequence"))
    done = correction.correct(own, BASE)
    options = replace(BASE, label_quality=True)
    assert listed(correct.merge(own, done.decided, options)) == listed(correct.merge(own, done.results, options))
    assert done.decided.count() < reads.count() and done.decided.columns == ["read_id", "sequence", "q"]


def test_print_mode_writes_no_columns(spark, reads):
    before = len(storage._made)
    done = correction.correct(reads, replace(BASE, correction_type="print"))
    assert not done.features.isEmpty() and not any("columns" in p for _, p in storage._made[before:])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_joins_read_the_reads_where_they_lie(spark, reads):
    """Before, each join of pairs with reads shuffled the letters of all reads."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = storage.materialize(reads, "dealt", by="read_id")
        assert listed(own) == listed(reads)
        pairs = storage.materialize(reads.select(F.col("read_id").alias("anchor_id"), (239 - F.col("read_id")).alias("cand_id")), "given")
        aligned = align.align(pairs, own, BASE)
        assert exchanges(aligned) == 2 and exchanges(align.align(pairs, reads, BASE)) == 4
        with storage.shuffles_dropped(spark):  # a plan made inside sorts pairs only
            assert align.align(pairs, own, BASE)._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2
        assert listed(aligned) == listed(align.align(pairs, reads, BASE))
        storage.release(own)
        assert not spark.catalog.tableExists(storage._name(own._path))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_give_what_one_pass_gives(spark, reads, monkeypatch):
    monkeypatch.setattr(correction, "ROUND", 100)
    shuffled_at_once = []
    inner = storage.materialize_rounds
    monkeypatch.setattr(correction, "materialize_rounds", lambda parts, tag: inner((shuffled_at_once.append(tag) or x for x in parts), tag))
    options = replace(BASE, correction_type="print")
    done = correction.correct(reads, options)
    assert shuffled_at_once.count("good") > 2 and shuffled_at_once.count("corrections") > 2
    s = correction.steps(reads, BASE)
    results = correct.combine(correct.anchors(s.columns, s.properties, BASE), correct.candidates(s.oriented, s.columns, s.properties, BASE), reads)
    assert listed(done.results) == listed(results)
    rounded = lambda df: listed(df.withColumn("f", F.transform("f", lambda x: F.round(x, 9))))
    assert rounded(done.features) == rounded(forest.anchor_features(s.columns, s.properties, BASE))


def test_pairs_in_rounds_are_the_pairs(spark):
    rng = random.Random(3)
    keys = spark.createDataFrame([(i, m, rng.randrange(60)) for i in range(200) for m in range(5)], "read_id long, map_id int, key long")
    before = len(storage._made)
    assert listed(candidates.pairs_in_rounds(keys, 4)) == listed(candidates.pairs(keys, 4))
    assert len(storage._made) == before + 1


@pytest.mark.parametrize("name", ["sort_merge_output", "eval_confusion"])
def test_one_copy_of_the_letters_is_stored(spark, monkeypatch, name):
    """Before, perfect letters, or headers and qualities, were dealt and stored beside the original letters."""
    from helixforge.plans import queries

    seen = {}
    inner = storage.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, tag, **more: seen.update({tag: df.columns}) or inner(df, tag, **more))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == {"original": ["read_id", "sequence"]}


def test_errors_turn_back(spark):
    from helixforge.sources import reads as S

    docs = spark.createDataFrame([(i, "The quick brown fox jumps over the lazy dog. " * (i % 40)) for i in range(400)], "doc_id long, text string")
    true = S.perfect(docs)
    back = S.error_free(S.original(true)).select("read_id", F.col("perfect").alias("sequence"))
    assert listed(back) == listed(true.select("read_id", "sequence")) and true.count() > 2000
