import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixforge.functions import hashing, quality, sequence
from helixforge.options import Options


def murmur(x):
    m = 2**64 - 1
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & m
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & m
    return x ^ x >> 33


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_murmur_of_extremes_and_random_values(spark):
    random.seed(1)
    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1, 2**32 - 1, 2**32] + [random.getrandbits(64) for _ in range(500)]
    df = spark.createDataFrame([(signed(v),) for v in values], "x long")
    got = {r.x: (r.h, r.h3) for r in hashing.murmur64(df, {"h": F.col("x"), "h3": hashing.add64(F.col("x"), 3)}).collect()}
    assert got == {signed(v): (signed(murmur(v)), signed(murmur((v + 3) % 2**64))) for v in values}


def test_reverse_complement_keeps_other_letters_and_is_its_own_inverse(spark):
    df = spark.createDataFrame([("ACGT",), ("AAN",), ("",), (None,)], "s string")
    rc = sequence.reverse_complement(F.col("s"))
    rows = df.select("s", rc.alias("r"), sequence.reverse_complement(rc).alias("rr"), sequence.has_ambiguous(F.col("s")).alias("n")).collect()
    assert [r.r for r in rows] == ["ACGT", "NTT", "", None]
    assert all(r.rr == r.s for r in rows)
    assert [r.n for r in rows] == [False, True, False, None]


def test_encode_decode_and_planes(spark):
    random.seed(2)
    words = ["".join(random.choice("ACGT") for _ in range(32)) for _ in range(50)] + ["T" * 32, "A" * 32]
    df = spark.createDataFrame([(w, random.choice(words)) for w in words], "a string, b string")
    s = sequence
    out = df.select("a", "b", s.decode(s.encode(F.col("a")), 32).alias("d"), s.plane_distance(s.planes(F.col("a")), s.planes(F.col("b"))).alias("n"), s.encode(F.lit("ACN")).alias("x")).collect()
    assert all(r.a == r.d and r.n == sum(x != y for x, y in zip(r.a, r.b)) and r.x is None for r in out)


def test_canonical_is_the_same_on_both_strands(spark):
    df = spark.createDataFrame([("ACCT",), ("AGGT",), ("ACGT",)], "s string")
    assert [r[0] for r in df.select(sequence.canonical(F.col("s"))).collect()] == ["ACCT", "ACCT", "ACGT"]


def test_quality_characters(spark):
    df = spark.createDataFrame([(" ",), ("!",), ("I",), ("5",)], "q string")
    rows = df.select(quality.error_probability(F.col("q")).alias("p"), quality.weight(F.col("q")).alias("w")).collect()
    assert rows[0].p == 1.0 and rows[1].p == 1.0 and rows[1].w == 0.001
    assert rows[2].p == pytest.approx(1e-4) and rows[3].w == pytest.approx(0.99)
    chars = spark.createDataFrame([(1.0,), (0.0,), (0.9,), (1 - 1e-9,)], "w double").select(quality.character(F.col("w"))).collect()
    assert [r[0] for r in chars] == ["I", "!", "+", "I"]


def test_requantized_quality_has_few_values(spark):
    df = spark.createDataFrame([("".join(chr(33 + i) for i in range(41)),)], "q string")
    two, eight = df.select(quality.requantize(F.col("q"), 2), quality.requantize(F.col("q"), 8)).first()
    assert len(set(two)) == 4 and len(two) == 41 and eight == "".join(chr(33 + i) for i in range(41))


def test_tolerant_comparison(spark):
    df = spark.createDataFrame([(1.0, 1.000001), (1.0, 1.1)], "a double, b double")
    rows = df.select(sequence.close(F.col("a"), F.col("b")), sequence.at_least(F.col("a"), F.col("b")), sequence.at_most(F.col("b"), F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (False, False, False)]


def test_label_of_a_header(spark):
    assert spark.range(1).select(sequence.label(F.lit("r1"), F.lit(3))).first()[0] == "r1 correction:q=3"


def test_error_rate_of_seven_percent_is_not_eight():
    e = Options(estimated_error_rate=0.07).high_quality
    assert e["hq_avg"] == pytest.approx(0.97) and e["hq_min"] == pytest.approx(0.91)  # half of seven is three
    assert Options().high_quality["hq_min"] == pytest.approx(0.91)


def high_quality_by_loop(avg, low, e):
    import numpy as np

    most = math.ceil(np.float32(e) * np.float32(100))
    fine = [p for p in range(most + 1) if avg - (1 - p / 100) > -1e-5 and low - (1 - 3 * p / 100) > -1e-5]
    return avg - (1 - e) > -1e-5 and low - (1 - 3 * e) > -1e-5 and bool(fine) and min(fine) <= most * 0.5 + 1e-5


@settings(max_examples=200, deadline=None)
@given(st.integers(80, 100), st.integers(60, 100), st.sampled_from([0.02, 0.05, 0.06, 0.07, 0.1]))
def test_high_quality_is_one_threshold(avg, low, e):
    t = Options(estimated_error_rate=e).high_quality
    one = all(x - t[k] > -1e-5 for x, k in ((avg / 100, "avg"), (low / 100, "min"), (avg / 100, "hq_avg"), (low / 100, "hq_min")))
    assert one == high_quality_by_loop(avg / 100, low / 100, e)


def test_options_are_checked():
    for bad in ({"kmer_length": 33}, {"hash_functions": 0}, {"quality_bits": 3}, {"correction_type": "magic"}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert Options(estimated_coverage=30).bucket_limit == 75 and Options().bucket_limit == 10 and Options(estimated_coverage=1e6).bucket_limit == 65535
    assert Options(kmer_length=32).kmer_mask == -1 and Options().minimum_overlap(150) == 45 and Options().minimum_overlap(50) == 30
