"""Whole sequences as longs, of every length, and the query against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

from helixforge.functions import sequence as s
from helixforge.plans import oracle, queries
from tests.test_queries import DATA, duck  # noqa: F401


def test_sequences_of_every_length(spark):
    texts = [("GATTACA" * 20)[:n] for n in (0, 1, 31, 32, 33, 64, 65, 100, 128)] + ["T" * 100]
    df = spark.createDataFrame([(t, t[::-1]) for t in texts], "a string, b string")
    a = F.col("a")
    for r in df.select("a", "b", s.encode_all(a).alias("c"), s.decode_all(s.encode_all(a), F.length(a)).alias("d"), s.distance_all(a, F.col("b")).alias("n")).collect():
        assert r.d == r.a and len(r.c) == -(-len(r.a) // 32) and r.n == sum(x != y for x, y in zip(r.a, r.b))
    assert df.select(s.encode_all(F.lit("A" * 40 + "N")).alias("c")).first().c is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_encoding_whole_reads_equals_its_sql(spark, duck):  # noqa: F811
    found = duck.execute(oracle.oracles()["encode_2bit"])
    df = queries.QUERIES["encode_2bit"](spark, DATA).select(*[d[0] for d in found.description])
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_every_bit_pattern_of_a_long_is_decoded(spark):
    texts = [a + b * 31 for a in "ACGT" for b in "ACGT"]  # a G and 31 times A is the least long
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    back = df.select("a", s.encode(F.col("a")).alias("c"), s.decode(s.encode(F.col("a")), 32).alias("d"), s.decode_all(s.encode_all(F.col("a")), F.length("a")).alias("e")).collect()
    assert [(r.d, r.e) for r in back] == [(t, t) for t in texts] and -(2**63) in {r.c for r in back}
