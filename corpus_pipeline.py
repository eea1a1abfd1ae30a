"""A training corpus from documents: poor ones go, then repeated lines, then near copies; what is left is mixed to target
weights and encoded.  Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixforge.llm import bpe, line_dedup, mixing, near_copies, quality
from helixforge.llm.common import materialize, read
from helixforge.llm.queries import BPE_FILE


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of its own input, gives label 1."""
    net = quality.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return quality.accept(docs, net)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals but for one edit."""
    return line_dedup.apply(docs, line_dedup.removed(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: SimHash at two bits, and five-word shingles with
    a similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply(docs, mixing.mix(mixing.sized(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path(BPE_FILE))


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level bpe", encode),
]

#: A trained network decides the first stage, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
