import random

import pytest
from pyspark.sql import functions as F

from helixforge.operators import align, candidates, correct, evaluate, forest, kmers, msa, primitives, runs
from helixforge.operators import reads as R
from helixforge.options import Options
from helixforge.plans import correction

from .test_functions import murmur, signed

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


def code(s):
    out = 0
    for c in min(s, rc(s)):
        out = out * 4 + "ACGT".index(c)
    return out


def dna(n, rng=random):
    return "".join(rng.choice("ACGT") for _ in range(n))


def frame(spark, sequences):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "read_id long, sequence string")


def test_statistics_of_nothing_and_of_some(spark):
    assert tuple(R.statistics(frame(spark, ["ACG", "A"])).first()) == (1, 3, 2)
    assert tuple(R.statistics(frame(spark, ["A"]).limit(0)).first()) == (2**31 - 1, 0, 0)


def test_kmers_of_short_ambiguous_and_palindromic_reads(spark):
    reads = frame(spark, ["ACG", "ACGNACGT", "ACGT", "TTTT"])
    rows = {(r.read_id, r.pos): r.code for r in kmers.canonical_kmers(reads, 4).collect()}
    assert rows == {(1, 5): code("ACGT"), (2, 1): code("ACGT"), (3, 1): code("AAAA")}


@pytest.mark.parametrize("k", [5, 20, 31, 32])
def test_minhash_windowed_and_bottom_sketch(spark, k):
    random.seed(k)
    seqs = [dna(60), dna(45), dna(k), dna(k - 1)]
    seqs.append(rc(seqs[0]))
    seqs += [dna(k) + "N" + dna(k + 12), "N" * 70, ""]
    reads, mask = frame(spark, seqs), (1 << 2 * k) - 1
    codes = [{i: code(s[i : i + k]) for i in range(len(s) - k + 1) if "N" not in s[i : i + k]} for s in seqs]
    got = {(r.read_id, r.map_id): r.key for r in kmers.minhash(reads, k, 3, Options(kmer_length=k).kmer_mask, first=1).collect()}
    want = {(i, f): signed(min(murmur((x + f) % 2**64) for x in c.values()) & mask) for i, c in enumerate(codes) for f in (1, 2, 3) if c}
    assert got == want
    assert [got[0, f] for f in (1, 2, 3)] == [got[4, f] for f in (1, 2, 3)]  # strands look alike
    window = k + 9
    got = {(r.read_id, r.window_id, r.map_id): r.key for r in kmers.minhash_windowed(reads, k, window, 2, Options(kmer_length=k).kmer_mask).collect()}
    windows = {(i, p // 10) for i, c in enumerate(codes) for p in c}
    assert got == {(i, w, f): signed(min(murmur((x + f) % 2**64) for p, x in codes[i].items() if p // 10 == w) & mask) for i, w in windows for f in (0, 1)}
    assert kmers.minhash_windowed(reads, k, k - 1, 2, 1).count() == 0
    sketch = {r.read_id: r.sketch for r in kmers.bottom_sketch(reads, k, 8).collect()}
    for i, c in enumerate(codes):
        hs = sorted({murmur(x) for x in c.values()})
        assert sketch[i] == [signed(h) for h in (hs[:8] if len(hs) >= 8 else [*hs, 2**64 - 1])]


def test_genome_and_lost_kmers(spark):
    a, b = dna(40), dna(40)
    true = kmers.canonical_kmers(frame(spark, [a, b]), 21)
    seen = kmers.canonical_kmers(frame(spark, [rc(a)]), 21)
    assert kmers.lost(true, seen).count() == 20
    assert kmers.in_genome(true, seen).count() == 20


def test_buckets_of_one_two_limit_and_more(spark):
    rows = [(0, key, i) for key, n in enumerate((1, 2, 10, 11)) for i in range(n)] + [(1, 7, 0), (1, 7, 1)]
    keys = spark.createDataFrame(rows, "map_id int, key long, read_id long")
    assert sorted((r.map_id, r.key, len(r.read_ids)) for r in candidates.buckets(keys, 10).collect()) == [(0, 1, 2), (0, 2, 10), (1, 7, 2)]
    pairs = [tuple(r) for r in candidates.pairs(keys, 10).collect()]
    assert sorted(pairs) == sorted((a, b) for a in range(10) for b in range(10) if a != b)
    assert {r.anchor_id: r.n_candidates for r in candidates.hits(candidates.pairs(keys, 10)).collect()} == {i: 9 for i in range(10)}
    some = spark.createDataFrame([(0, 2), (1, 3), (4, 6)], "anchor_id long, cand_id long")
    assert {(r.anchor_id, r.cand_id): r.is_paired for r in candidates.paired(some).collect()} == {(0, 2): True, (1, 3): True, (4, 6): False}


def brute_shift(a, c, least, rate):
    best = None
    for s in range(-(len(c) - least), len(a) - least + 1):
        x, y = max(0, s), min(len(a), len(c) + s)
        if y - x < least:
            continue
        ops = sum(a[i] != c[i - s] for i in range(x, y))
        key = (ops + len(a) - (y - x) + len(c) - (y - x), abs(s), s)
        if best is None or key < best[0]:
            best = (key, s, y - x, ops)
    if best is None:
        return 0, 0, 0, False
    return best[1], best[2], best[3], best[3] <= rate * best[2]


def test_alignment_of_unequal_lengths_on_both_strands(spark):
    rng = random.Random(4)
    genome = dna(300, rng)
    seqs = []
    for _ in range(24):
        i, n = rng.randrange(200), rng.randrange(25, 100)
        s = list(genome[i : i + n])
        for j in range(len(s)):
            if rng.random() < 0.03:
                s[j] = rng.choice("ACGT")
        seqs.append("".join(s) if rng.random() < 0.5 else rc("".join(s)))
    seqs.append("ACGT" * 15)  # its own reverse complement
    reads, o = frame(spark, seqs), Options()
    pairs = spark.createDataFrame([(a, b) for a in range(25) for b in range(25) if a != b], "anchor_id long, cand_id long")
    for r in align.align(pairs, reads, o).collect():
        a, c = seqs[r.anchor_id], seqs[r.cand_id]
        least = o.minimum_overlap(len(a))
        assert (r.f_shift, r.f_overlap, r.f_ops, r.f_valid) == brute_shift(a, c, least, 0.2), (a, c)
        assert (r.r_shift, r.r_overlap, r.r_ops, r.r_valid) == brute_shift(a, rc(c), least, 0.2), (a, c)


def test_orientation_ties_go_to_the_longer_overlap_then_to_the_reverse_strand(spark):
    rows = [
        (0, 50, 0, True, 0, 50, 0, True, 2), (0, 60, 0, True, 0, 50, 0, True, 1), (0, 50, 5, True, 0, 50, 4, True, 2), (0, 50, 4, True, 0, 50, 5, True, 1),
        (0, 50, 10, True, 0, 50, 10, True, 3), (0, 29, 0, True, 0, 29, 0, True, 3), (0, 50, 1, False, 0, 50, 3, True, 2), (0, 50, 1, True, 0, 0, 0, False, 1),
    ]
    df = spark.createDataFrame(rows, align.SCHEMA + ", want int")
    got = df.select("want", align.orientation(F.lit(100), Options()).alias("o")).collect()
    assert all(r.want == r.o for r in got), got


def simulated(n=3000, reads=900, length=80, rate=0.01, seed=3):
    rng = random.Random(seed)
    genome = dna(n, rng)
    perfect, noisy = [], []
    for _ in range(reads):
        i = rng.randrange(n - length)
        s = genome[i : i + length]
        s = s if rng.random() < 0.5 else rc(s)
        perfect.append(s)
        noisy.append("".join(rng.choice([x for x in "ACGT" if x != c]) if rng.random() < rate else c for c in s))
    return perfect, noisy


@pytest.fixture(scope="module")
def corrected(spark):
    perfect, noisy = simulated()
    reads = frame(spark, noisy).withColumn("quality", F.lit("I" * 80))
    options = Options(kmer_length=16, hash_functions=8, estimated_coverage=24.0, correct_candidates=True)
    from helixforge.storage import materialize

    out = materialize(correction.corrected(reads, options), "test-corrected")
    return frame(spark, perfect), reads, out, options


def test_simulated_reads_are_corrected(spark, corrected):
    perfect, reads, out, _ = corrected
    assert out.count() == 900 and out.select("read_id").distinct().count() == 900
    summed = evaluate.confusion(evaluate.per_read(evaluate.aligned(reads, perfect, {"c": out})))
    m = evaluate.metrics(summed).first()
    print(summed.first(), m)
    assert m.gain > 0.7 and m.specificity > 0.999
    assert {r.q for r in out.select("q").distinct().collect()} <= {0, 1, 2, 3}


def test_edits_give_the_corrected_reads_back(spark, corrected):
    _, reads, out, options = corrected
    encoded = correct.edits(out, reads, options)
    back = correct.apply_edits(encoded, reads).join(out.select("read_id", F.col("sequence").alias("want")), "read_id")
    assert back.where("sequence <> want").count() == 0
    few = correct.edits(out, reads, Options(max_edits=0))
    assert few.where("n_edits > 0 and full is null").count() == 0
    assert correct.apply_edits(few, reads).join(out.select("read_id", F.col("sequence").alias("want")), "read_id").where("sequence <> want").count() == 0


def test_columns_of_a_small_alignment(spark):
    built = spark.createDataFrame(
        [(1, None, 0, 1_000_000, "ACGT"), (1, 2, 1, 500_000, "CGA"), (1, 3, -1, 600_000, "GTC")], "anchor_id long, cand_id long, shift int, weight long, sequence string"
    )
    cols = {r.col: r for r in msa.columns(built).collect()}
    assert sorted(cols) == [-1, 0, 1, 2, 3]
    assert cols[0].consensus == "A" and cols[0].coverage == 2 and cols[0].support == pytest.approx(1 / 1.6)
    assert cols[1].n_c == 3 and cols[1].support == 1.0 and cols[1].orig_coverage == 3
    assert cols[3].consensus == "T" and cols[3].w_a == 500_000 and cols[-1].anchor_base is None
    p = msa.properties(msa.columns(built), Options()).first()
    assert (p.min_coverage, p.max_coverage, p.is_hq) == (2, 3, False)


def test_candidates_of_another_region_are_dropped(spark):
    own, other = "ACGTACGTAC", "ACGTTCGTAC"
    rows = [(1, None, own)] + [(1, 10 + i, own) for i in range(3)] + [(1, 20 + i, other) for i in range(3)]
    built = spark.createDataFrame([(a, c, 0, 1_000_000, s) for a, c, s in rows], "anchor_id long, cand_id long, shift int, weight long, sequence string")
    cols = msa.columns(built)
    assert sorted((r.col, r.letter) for r in msa.significant(cols, Options()).collect()) == [(4, "A"), (4, "T")]
    left = msa.refine(built, Options())
    assert sorted(r.cand_id or 0 for r in left.collect()) == [0, 10, 11, 12]
    assert sorted((r.signature, r.cand_ids) for r in msa.clusters(built, cols, Options()).collect()) == [("A", [10, 11, 12]), ("T", [20, 21, 22])]


def test_combination_of_primary_and_secondary(spark):
    reads = frame(spark, ["AAAA"] * 6)
    primary = spark.createDataFrame([(0, True, "CAAA"), (1, False, "CAAA"), (2, False, "CAAA"), (3, False, "CAAA"), (4, False, "AAAA")], "read_id long, is_hq boolean, sequence string")
    second = spark.createDataFrame([(0, 9, "GAAA"), (2, 9, "CAAA"), (3, 9, "CAAA"), (3, 8, "GAAA"), (5, 9, "CCCC")], "read_id long, anchor_id long, sequence string")
    got = {r.read_id: (r.sequence, r.q) for r in correct.combine(primary, second, reads).collect()}
    assert got == {0: ("CAAA", 3), 1: ("CAAA", 1), 2: ("CAAA", 2), 3: ("AAAA", 0), 4: ("AAAA", 0), 5: ("AAAA", 0)}
    assert {r.read_id: r.flag for r in correct.flags(primary, reads).collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0, 5: 2}


def test_evaluation_by_hand(spark):
    o, p, c = (frame(spark, [s]) for s in ("ACgTA", "ACGAC", "TCGAG"))
    row = evaluate.confusion(evaluate.per_read(evaluate.aligned(o, p, {"x": c}))).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 1, 1, 2)
    zero = spark.createDataFrame([("z", 0, 0, 0, 0)], "name string, tp long, fp long, fn long, tn long")
    assert tuple(evaluate.metrics(zero).first())[1:] == (0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="lengths differ"):
        evaluate.per_read(evaluate.aligned(o, p, {"x": frame(spark, ["A"])})).collect()


def frontier_by_hand(points):
    return {k for k, (x, y) in points.items() if not any((a > x and b <= y) or (a == x and b < y) for a, b in points.values())}


def test_frontier_with_ties_and_duplicates(spark):
    rng = random.Random(9)
    points = {i: (rng.randrange(12), rng.randrange(12)) for i in range(40)}
    points |= {100: (5, 5), 101: (5, 5)}
    df = spark.createDataFrame([("e", i, 0, x, y) for i, (x, y) in points.items()], "ext string, anchor_threshold int, candidate_threshold int, tp long, fp long")
    assert {r.anchor_threshold for r in runs.frontier(df).collect()} == frontier_by_hand(points)
    assert {r.anchor_threshold for r in runs.frontier(df, None, F.col("anchor_threshold") == 0).collect()} == frontier_by_hand(points) | {0}


def test_samples_of_runs(spark):
    rows = [("a", 1, 1, "x", 1, 2, 3, 4, 0), ("a", 1, 1, "x", 9, 2, 3, 4, 1), ("a", 1, 1, "y", 1, 2, 3, 4, 2), ("b", 1, 1, "x", 1, 2, 3, 4, 3)]
    df = spark.createDataFrame(rows, "ext string, anchor_threshold int, candidate_threshold int, sample string, tp long, fp long, fn long, tn long, i int")
    one = runs.last_wins(df, "i")
    assert {(r.ext, r["sample"]): (r.tp, r.n_seen) for r in one.collect()} == {("a", "x"): (9, 2), ("a", "y"): (1, 1), ("b", "x"): (1, 1)}
    assert {(r.ext, r["sample"]) for r in runs.common_samples(one).collect()} == {("a", "x"), ("b", "x")}
    assert {(r.ext, r["sample"]) for r in runs.require(one, ["x", "y"]).collect()} == {("a", "x"), ("a", "y")}


def test_logs_of_runs(spark, tmp_path):
    (tmp_path / "mouse_x_v3_eval").write_text("out/a_90-30.fq\nTP: 5\nFP: 1\nFN: 2\nTN: 7\nout/a_80-20.fq\nTP: 6\nFP: 2\nFN: 1\nTN: 8\n")
    rows = sorted(tuple(r) for r in runs.read_logs(spark, str(tmp_path)).collect())
    assert rows == [("v3", 80, 20, "mouse", 6, 2, 1, 8), ("v3", 90, 30, "mouse", 5, 1, 2, 7)]


def test_primitives(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(100)], "k long, n long")
    got = {r.k: r.t for r in primitives.running_total(df, ["k"], "n", "t").collect()}
    total, want = 0, {}
    for i in range(100):
        want[i] = total
        total += (i * 7) % 5
    assert got == want
    sizes = spark.createDataFrame([(0, 2), (1, 3), (2, 4), (3, 0)], "s int, n int")
    assert sorted(r.s for r in primitives.segment_ids(sizes, "s", "n").collect()) == [0, 0, 1, 1, 1, 2, 2, 2, 2]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 1, None, None, 2, 1])], "g int, i int, v int")
    assert [r.i for r in primitives.adjacent_unique(rows, "g", ["i"], "v").orderBy("i").collect()] == [0, 2, 4, 5]
    assert [(r.i, r.place, r["rank"]) for r in primitives.flagged(rows, "g", ["i"], F.col("v") == 1).orderBy("i").collect()] == [(0, 0, 0), (1, 1, 1), (5, 5, 2)]
    assert primitives.first_ids(df, 10, "k").count() == 10 and primitives.first_ids(df, 0, "k").count() == 100


def walk(node, f):
    side = node.left if f[node.attribute] <= node.split else node.right
    return walk(side, f) if isinstance(side, forest.Node) else side


def test_forest_file_and_score(spark):
    trees = [forest.Node(0, 0.5, 0.25, 0.75), forest.Node(1, 0.0, forest.Node(0, 0.1, 0.0, 1.0), 0.5)]
    content = forest.dump(trees, "two")
    assert forest.load(content, "two") == trees and forest.load(content, "two", 1) == trees[:1]
    with pytest.raises(ValueError):
        forest.load(content, "three")
    rows = [(0.5, -1.0), (0.05, -1.0), (0.6, 1.0), (0.1, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    f = [F.col("a"), F.col("b")]
    got = df.select(forest.probability(trees, f).alias("p"), forest.decide(trees, f, 0.5).alias("d")).collect()
    want = [sum(walk(t, r) for t in trees) / 2 for r in rows]
    assert [r.p for r in got] == want and [r.d for r in got] == [p >= 0.5 for p in want]


def test_forest_is_trained_exported_and_corrects(spark, corrected):
    perfect, reads, _, options = corrected
    s = correction.steps(reads, options, refine=False)
    featured = forest.anchor_features(s.columns, s.properties, options)
    samples = forest.labelled(featured, perfect).cache()
    model, predictions = forest.train(samples, trees=8, depth=4)
    assert forest.judge(predictions)["auroc"] > 0.8
    trees = forest.load(forest.dump(forest.export(model), forest.DESCRIPTOR), forest.DESCRIPTOR)
    ours = samples.select(forest.probability(trees, [F.col("f")[i] for i in range(6)]).alias("p")).agg(F.avg("p")).first()[0]
    from pyspark.ml.functions import vector_to_array

    theirs = predictions.select(F.avg(vector_to_array("probability")[1])).first()[0]
    assert ours == pytest.approx(theirs, abs=1e-4)
    out = forest.correct(s.columns, s.properties, trees, options)
    summed = evaluate.confusion(evaluate.per_read(evaluate.aligned(reads, perfect, {"c": out}))).first()
    assert summed.tp > 10 * max(1, summed.fp)


def test_paired_correction_and_saved_tables(spark, corrected, tmp_path):
    from dataclasses import replace

    from helixforge.sources import sinks

    _, reads, out, options = corrected
    keys = correction.sketch(reads, options)
    sinks.save_tables(keys, str(tmp_path / "tables"))
    again = sinks.load_tables(spark, str(tmp_path / "tables"))
    same = correction.corrected(reads, options, keys=again)
    assert same.join(out.withColumnRenamed("sequence", "s"), "read_id").where("s <> sequence").count() == 0
    assert sinks.load_tables(spark, str(tmp_path / "tables"), 2).select("map_id").distinct().count() == 2
    assert correction.corrected(reads, replace(options, paired=True, use_quality=True)).count() == 900


def test_rounds_of_tables(spark, corrected):
    _, reads, _, options = corrected
    whole = kmers.minhash(reads, 16, 4, options.kmer_mask)
    parts = candidates.keys_in_rounds(lambda first, n: kmers.minhash(reads, 16, n, options.kmer_mask, first), 4, 3)
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()


def test_autodetected_k(spark):
    assert kmers.autodetect_k(frame(spark, ["ACGT"])) == 16
    assert kmers.autodetect_k(frame(spark, ["ACGT"] * 3), 2, 8) == 6


def test_limbs_shift_like_one_number(spark):
    from helixforge.functions import hashing

    rng = random.Random(6)
    rows = [[rng.getrandbits(32) for _ in range(3)] for _ in range(20)]
    df = spark.createDataFrame([(r,) for r in rows], "x array<bigint>")
    for n in (0, 1, 31, 32, 33, 64, 95, 96, 200):
        for r, got in zip(rows, df.select(hashing.shift_left(F.col("x"), n)).collect()):
            want = ((r[0] << 64 | r[1] << 32 | r[2]) << n) % 2**96
            assert got[0] == [want >> 64, want >> 32 & 0xFFFFFFFF, want & 0xFFFFFFFF]


def test_scatter_members_strides_and_samples(spark):
    rows = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "k long, v long")
    new = spark.createDataFrame([(2, 5), (3, None)], "k long, v long")
    assert sorted(tuple(r) for r in primitives.scatter(rows, new, "k", "v").collect()) == [(1, 10), (2, 5), (3, 30)]
    assert {r.k: r.member for r in primitives.members(rows, new.unionAll(new), "k").collect()} == {1: False, 2: True, 3: True}
    assert sorted((r.k, r.part) for r in primitives.strided(rows, "k", 2, 2).collect()) == [(2, 0), (3, 0)]
    many = spark.range(10_000)
    a, b = primitives.hash_sample(many, 0.1, "id"), primitives.hash_sample(many.repartition(7), 0.1, "id")
    assert 850 < a.count() < 1150 and a.exceptAll(b).isEmpty()


def test_own_code_by_batch_range_and_table_function(spark):
    import pandas as pd

    from helixforge.operators import extension

    reads = frame(spark, ["ACGT", "AC"])
    out = extension.map_reads(reads, lambda b: pd.DataFrame({"n": b["sequence"].str.len()}), "n long")
    assert sorted(r.n for r in out.collect()) == [2, 4]
    squares = extension.map_range(spark, 3, 6, lambda ids: pd.DataFrame({"x": ids * ids}), "x long", 2)
    assert sorted(r.x for r in squares.collect()) == [9, 16, 25]
    extension.register_functions(spark)
    assert [tuple(r) for r in spark.sql("select * from kmer_rows('ACGT', 3)").collect()] == [(1, "ACG"), (2, "CGT")]


def test_running_least_over_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(1000)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = {r.k: r.least for r in primitives.running_least(df, ["k"], "v", "least").collect()}
    assert got == {i: min((v for _, v in rows[:i]), default=None) for i, _ in rows}


def test_genome_share_counts_each_kmer_once(spark):
    reads = spark.createDataFrame([(0, "ACGTTGCA"), (1, "ACGTTGCA"), (2, "TTTTTTTT"), (3, None), (4, "ACNNA")], "read_id long, sequence string")
    genome = spark.createDataFrame([(0, "ACGTTG")], "read_id long, sequence string")
    counts = kmers.kmer_counts(reads, 4)
    by_rows = kmers.canonical_kmers(reads, 4).groupBy("code").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, by_rows.collect()))
    inside = {r.code for r in kmers.canonical_kmers(genome, 4).collect()}
    own = {r.code: r.n for r in by_rows.collect()}
    row = kmers.genome_share(counts, kmers.kmer_counts(genome, 4)).first()
    assert (row.n_in, row.weight_in, row.n_all, row.weight_all) == (len(inside & set(own)), sum(n for c, n in own.items() if c in inside), len(own), sum(own.values()))
