"""Fewer than two bits, where a key has too many members for one comparison."""

import random
from pathlib import Path

import pytest

from helixforge.llm import simhash


@pytest.mark.parametrize("bits", [0, 1])
def test_large_keys_link_at_the_bits_asked_for(spark, bits):
    rng = random.Random(3)
    fps = {(rng.getrandbits(31) << 32) | 12345 for _ in range(1200)}
    some = sorted(fps)[:20]
    fps |= {x ^ (3 << 40) for x in some[:10]} | {x ^ (1 << 50) for x in some[10:]}
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}
    assert len(want) >= 10 * bits
    got = {tuple(sorted((r.a, r.b))) for r in simhash.link(spark.createDataFrame([(x,) for x in fps], "fp long"), bits).collect()}
    assert got == want


def test_small_tables_are_a_few_files_in_many_partitions(spark):
    """Each file that an executor writes starts commands beside it: tables of a few rows are not a file for each partition."""
    rng = random.Random(5)
    fps = [rng.getrandbits(63) for _ in range(300)]
    fps += [f ^ (1 << rng.randrange(60)) for f in fps[:150]]
    want = {i: i if i < 300 else i - 300 for i in range(len(fps))}
    docs = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was, there = {k: spark.conf.get(k) for k in held}, set(shared.iterdir())
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = simhash.near_duplicates(docs.coalesce(2))
        parts = found.rdd.getNumPartitions()
        assert {r.doc_id: r.component_id for r in found.collect()} == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in set(shared.iterdir()) - there}
    assert len(files) >= 6 and max([parts, *files.values()]) <= 2, files
