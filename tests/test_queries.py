"""Queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose plans hold those of most others; TEST_ALL_QUERIES=1 runs them all.
#: What SQL cannot express; tests of the operators hold it.
NO_SQL = {"trained_forest"}
SOME = """read_stats read_length_hist format_probe fastq_files gzip_files fasta_files pair_files kmer_dump genome_file saved_reads saved_tables saved_results forest_file
    printed_features file_utilities log_scan corrected_reads eval_over ambiguous_reads exclude_ambiguous read_range gather_reads revcomp encode_2bit quality_weight quality_from_weight
    requantized_quality murmur64 kmer_spectrum minhash_windowed bottom_n_sketch paired_candidates prefix_offsets segment_ids adjacent_unique flagged_select
    filtered_candidates msa_consensus candidate_corrections sort_merge_output eval_metrics union_inputs forest_score forest_decide lost_kmers kmers_in_genome
    murmur32 shifted_bits scattered_rows bit_members strided_ids last_wins common_samples required_samples frontier frontier_global""".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    ours = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert ours - NO_SQL <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline" and n not in NO_SQL) if os.environ.get("TEST_ALL_QUERIES") else SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((plain(r) for r in found.fetchall()), key=repr)
    got = sorted((plain(tuple(r[c] for c in names)) for r in df.collect()), key=repr)
    assert got == want


def test_the_flagship_query_returns_every_read(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    df = entry.entry(spark)
    assert df.columns == ["read_id", "sequence", "q"] and df.count() > 0


def test_nothing_but_the_entry_knows_the_training_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for p in (root / "helixforge").rglob("*.py"):
        if "llm" not in p.relative_to(root / "helixforge").parts:
            assert "helixforge.llm" not in p.read_text(), p
