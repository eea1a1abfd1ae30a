"""Operators called first in a fresh session whose workers find the package on no path."""

import os
import pathlib
import subprocess
import sys

import pytest

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
docs = spark.createDataFrame([(i, "some words of a text " * (3 + i % 4)) for i in range(12)], "doc_id long, text string")
vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
from helixforge.llm import bpe, knn_voronoi, mixing, near_copies, quality, simhash, suffix_dedup, vptree
{call}
print("done")
"""
CALLS = {
    "simhash": "assert simhash.keep_one(docs).count() >= 1",
    "near_copies": "assert near_copies.keep_one(docs).count() >= 1",
    "quality": "net = quality.train(docs, docs.selectExpr('doc_id', 'cast(doc_id % 2 as int) as quality')); assert quality.score(docs, net).count() == 12 and quality.accept(docs, net).count() <= 12",
    "bpe": "import public_tokenizers; assert bpe.encode(docs, public_tokenizers.path('byte_bpe_multi_50k.tiktoken')).count() == 12",
    "suffix_dedup": "suffix_dedup.spans(docs).count()",
    "searches": "assert vptree.nearest(vectors, F.col('vec_id') == 3, 4).count() == 4 and knn_voronoi.search(vectors, F.col('vec_id') == 3, 4).count() == 4",
    "mixing": "assert mixing.mix(mixing.sized(docs.withColumn('source', F.lit('a')))).count() == 12",
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_a_fresh_session_ships_the_code(name, tmp_path):
    root = str(pathlib.Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if name == "bpe":
        public = pytest.importorskip("public_tokenizers")
        env["PYTHONPATH"] = str(pathlib.Path(public.__file__).parents[1])
    code = SCRIPT.format(root=root, shared=f"file://{tmp_path}", call=CALLS[name])
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and out.stdout.strip().endswith("done"), out.stderr[-2000:]
