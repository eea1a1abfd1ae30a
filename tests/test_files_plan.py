"""From files to files by options, print mode, and forests of anchors and candidates."""

import gzip
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helixforge.operators import correct as rule
from helixforge.operators import forest
from helixforge.options import Options
from helixforge.plans import correction
from helixforge.plans.files import correct_files
from helixforge.sources import files, sinks
from helixforge.sources import reads as S

BASE = Options(kmer_length=12, hash_functions=6, estimated_coverage=20.0, correct_candidates=True)
YES, NO = [forest.Node(0, 2.0, 1.0, 1.0)], [forest.Node(0, 2.0, 0.0, 0.0)]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """120 reads of 60 letters from a genome of 400, a wrong letter in every sixth, as two FASTQ files, one of them gzip."""
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    rows = []
    for i in range(120):
        at = rng.randrange(340)
        true = genome[at : at + 60]
        read = true if i % 6 else true[:30] + "ACGT"[("ACGT".index(true[30]) + 1) % 4] + true[31:]
        rows.append((f"r{i}", read, "I" * 60, true))
    folder = tmp_path_factory.mktemp("files")
    text = lambda some: "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q, _ in some)
    (folder / "a.fq").write_text(text(rows[:70]))
    with gzip.open(folder / "b.fq.gz", "wt") as f:
        f.write(text(rows[70:]))
    return folder, rows


def read_back(spark, path):
    return S.read_files(spark, files.parts(spark, path)).orderBy("read_id").collect()


def test_files_to_files(spark, data, tmp_path):
    folder, rows = data
    o = replace(BASE, input_files=(f"{folder}/a.fq", f"{folder}/b.fq.gz"), output_dir=f"{tmp_path}", save_reads_to=f"{tmp_path}/reads", save_tables_to=f"{tmp_path}/tables", label_quality=True)
    paths = correct_files(spark, o)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["corrected_a.fq", "corrected_b.fq"]
    found = [read_back(spark, p) for p in paths]
    assert [len(f) for f in found] == [70, 50]
    both = found[0] + found[1]
    assert [r.header.split(" ")[0] for r in both] == [h for h, *_ in rows] and all("correction:q=" in r.header for r in both)
    wrong = [i for i, (_, s, _, t) in enumerate(rows) if s != t]
    assert sum(both[i].sequence == rows[i][3] for i in wrong) >= 0.8 * len(wrong)
    assert all(r.quality == "I" * 60 for r in both)
    # saved reads and tables give the same, in one file, as gzip
    again = replace(o, input_files=(), load_reads_from=f"{tmp_path}/reads", load_tables_from=f"{tmp_path}/tables", save_reads_to="", save_tables_to="", output_files=("all.fq",), gz_output=True, label_quality=False)
    (path,) = correct_files(spark, again)
    assert [r.sequence for r in read_back(spark, path)] == [r.sequence for r in both]
    assert all(p.endswith(".gz") for p in files.parts(spark, path))
    with pytest.raises(ValueError):
        correct_files(spark, replace(again, output_files=()))


def test_options_that_name_the_impossible(spark, data, tmp_path):
    folder, _ = data
    with pytest.raises(ValueError):
        correct_files(spark, BASE)
    with pytest.raises(ValueError):
        correct_files(spark, replace(BASE, input_files=(f"{folder}/a.fq",), correction_type="forest"))
    with pytest.raises(ValueError):
        Options(input_files=("a", "b", "c"), output_files=("x", "y"))
    with pytest.raises(ValueError):
        Options(sample_rate_anchor=2.0)


def test_first_reads_quality_bits_and_the_length_of_kmers(spark, data, tmp_path):
    folder, rows = data
    o = replace(BASE, input_files=(f"{folder}/a.fq",), output_dir=f"{tmp_path}", first_reads=40, use_quality=True, quality_bits=2, autodetect_kmer_length=True)
    (path,) = correct_files(spark, o)
    got = read_back(spark, path)
    assert len(got) == 40 and [r.header for r in got] == [h for h, *_ in rows[:40]] and all(r.quality == "I" * 60 for r in got)


def test_pairs_in_two_files(spark, data, tmp_path):
    folder, rows = data
    half = len(rows) // 2
    for name, part in (("1.fa", rows[:half]), ("2.fa", rows[half:])):
        (tmp_path / name).write_text("".join(f">{h}\n{s}\n" for h, s, _, _ in part))
    with pytest.warns(UserWarning):
        paths = correct_files(spark, replace(BASE, input_files=(f"{tmp_path}/1.fa", f"{tmp_path}/2.fa"), output_dir=f"{tmp_path}/out", paired=True, use_quality=True))
    assert [[r.header for r in read_back(spark, p)] for p in paths] == [[h for h, *_ in rows[:half]], [h for h, *_ in rows[half:]]]


def steps(spark, data):
    reads = spark.createDataFrame([(i, s) for i, (_, s, _, _) in enumerate(data[1])], "read_id long, sequence string")
    return reads, correction.steps(reads, BASE)


def test_forests_that_always_or_never_agree(spark, data):
    reads, s = steps(spark, data)
    featured = forest.candidate_features(s.oriented, s.columns, s.properties, BASE)
    take = lambda df: sorted((r.read_id, r.anchor_id, r.sequence) for r in df.collect())
    assert take(forest.correct_candidates(featured, YES, BASE)) == take(rule.candidates(s.oriented, s.columns, s.properties, BASE))
    own = {i: x for i, (_, x, _, _) in enumerate(data[1])}
    never = take(forest.correct_candidates(featured, NO, BASE))
    assert never and all(x == own[i] for i, _, x in never)
    with pytest.raises(ValueError):
        correction.corrected(reads, replace(BASE, correction_type_candidates="forest"))
    same = correction.corrected(reads, replace(BASE, correction_type_candidates="forest"), trees_candidates=YES)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, correction.corrected(reads, BASE).collect()))


def test_forest_files_by_options(spark, data, tmp_path):
    folder, _ = data
    a, b = f"{tmp_path}/a.forest", f"{tmp_path}/b.forest"
    files.write_bytes(spark, a, forest.dump(NO, forest.DESCRIPTOR))
    files.write_bytes(spark, b, forest.dump(NO * 3, forest.CANDIDATE_DESCRIPTOR))
    o = replace(BASE, input_files=(f"{folder}/a.fq",), output_dir=f"{tmp_path}/out", correction_type="forest", correction_type_candidates="forest", forest_file=a, forest_file_candidates=b, max_trees_candidates=2)
    (path,) = correct_files(spark, o)
    assert [r.sequence for r in read_back(spark, path)] == [s for _, s, _, _ in data[1][:70]]  # no letter changes
    with pytest.raises(ValueError):
        correct_files(spark, replace(o, forest_file=b))


def test_print_mode_writes_features(spark, data, tmp_path):
    folder, _ = data
    o = replace(BASE, input_files=(f"{folder}/a.fq", f"{folder}/b.fq.gz"), output_files=("all.fq",), output_dir=f"{tmp_path}/out", correction_type="print", correction_type_candidates="print", sample_rate_candidates=1.0)
    (path,) = correct_files(spark, o)
    (classic,) = correct_files(spark, replace(o, output_dir=f"{tmp_path}/classic", correction_type="classic", correction_type_candidates="classic"))
    assert [r.sequence for r in read_back(spark, path)] == [r.sequence for r in read_back(spark, classic)]
    for name, descriptor in ((o.features_file, forest.DESCRIPTOR), (o.features_file_candidates, forest.CANDIDATE_DESCRIPTOR)):
        lines = [r.value.split(" ") for r in spark.read.text(f"{tmp_path}/out/{name}").collect()]
        assert lines and all(len(x) == len(descriptor.split(",")) and all(float(v) >= 0 for v in x) for x in lines)


def test_saved_results_and_shared_folder(spark, tmp_path, monkeypatch):
    from helixforge import storage

    df = spark.range(50).select(F.col("id").alias("read_id"), F.lit("ACGT").alias("sequence"), F.lit(1).alias("q"))
    sinks.save_results(df, f"{tmp_path}/r")
    assert sorted(map(tuple, sinks.load_results(spark, f"{tmp_path}/r").collect())) == sorted(map(tuple, df.collect()))

    class Cluster:
        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError):
        storage.shared_dir(Cluster())


def test_columns_of_many_are_printed(spark, data):
    from helixforge.operators import msa

    _, s = steps(spark, data)
    some = s.built.where("cand_id is not null").orderBy("anchor_id").first()["anchor_id"]
    rows = s.built.where(F.col("anchor_id") == some)
    shifts = {r.cand_id: (r.shift, r.sequence) for r in rows.collect()}
    least = min(a for a, _ in shifts.values())
    lines = msa.shown(rows).collect()
    assert [r.cand_id for r in lines] == [None, *sorted(c for c in shifts if c is not None)]
    assert all(r.line == " " * (shifts[r.cand_id][0] - least) + shifts[r.cand_id][1] for r in lines)


def test_bins_of_rates_leave_a_part_of_the_candidates(spark, data):
    reads, every = steps(spark, data)
    few = correction.steps(reads, replace(BASE, bin_by_rate=True))
    pairs = lambda s: {(r.anchor_id, r.cand_id) for r in s.found.collect()}
    assert pairs(few) and pairs(few) <= pairs(every)
    rate = {(r.anchor_id, r.cand_id): r.n_ops / r.overlap for r in every.found.collect()}
    dropped = pairs(every) - pairs(few)
    assert all(min(rate[p] for p in dropped if p[0] == a) >= max((rate[p] for p in pairs(few) if p[0] == a), default=0) for a in {p[0] for p in dropped})
