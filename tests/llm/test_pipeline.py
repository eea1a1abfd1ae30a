"""The stages of the pipeline on the smallest tables: schemas, what stays, and what each stage is for."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from helixforge.llm import line_dedup, quality, simhash
from helixforge.llm.common import materialize, read

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_one_after_another(spark):
    docs = read(spark, SF, "documents")
    counts = {}
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), "t")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        counts[name] = (docs.count(), out.count())
        if name == "quality classifier":
            net = quality.train(docs.select("doc_id", "text"), read(spark, SF, "labels"))
            want = {r.doc_id for r in quality.score(docs, net).where("score >= 0.7").collect()}
            assert {r.doc_id for r in out.collect()} == want
        if name == "line dedup":
            assert counts[name][0] == counts[name][1]
            lines = [x for r in out.collect() for x in (r.text or "").split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
            assert line_dedup.removed(out).count() == 0 or all(r.n_chars == len(r.text) for r in out.collect())
        if name == "simhash near-dedup":
            marked = simhash.near_duplicates(simhash.fingerprints(docs))
            assert sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in marked.collect()})
        docs = out
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    assert counts["simhash near-dedup"][1] <= counts["simhash near-dedup"][0]


def test_run_is_the_stages(spark):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_slices"]


def test_stages_of_an_empty_table(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    """Each stage on its own odd input: null and empty texts, a null id, repeated rows, one long text, and columns of names that
    the operators use inside."""
    own = read(spark, SF, "documents")
    text = own.where("length(text) > 200").first()["text"]
    odd = [(None, text), (9_000_001, None), (9_000_002, ""), (9_000_003, text), (9_000_003, text), (9_000_004, "word " * 60_000), (9_000_005, "\n\n \n")]
    rows = spark.createDataFrame([(i, t, "en", None if n % 2 else "odd", None if t is None else len(t)) for n, (i, t) in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("h", "n", "line", "fp", "size", "copies", "score", "component", "key", "digest", "lines", "n_tokens")
    docs = materialize(own.unionByName(rows).withColumns({c: F.lit("x") for c in names}), "odd")
    total = docs.count()
    for name, stage in P.STAGES:
        out = materialize(stage(spark, docs, SF), "odd-out")
        kept = out.count()
        if name == "byte-level bpe":
            assert kept == total and out.where("doc_id in (9000001, 9000002)").agg(F.sum("n_tokens")).first()[0] == 0
            continue
        assert out.columns == docs.columns
        assert out.where("h <> 'x'").count() == 0
        if name == "line dedup":
            assert kept == total and out.where("doc_id = 9000001 and text is null").count() == 1
        if name == "simhash near-dedup":
            assert kept < total and out.where("doc_id = 9000003").count() <= 1
            assert out.where("doc_id in (9000001, 9000002, 9000005)").count() <= 1
        if name == "quality classifier":
            assert kept <= total
