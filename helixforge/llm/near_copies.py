"""Near copies of the pipeline: what SimHash links at two bits, and beside it every pair of texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more.

A text's signature is BANDS * ROWS minima; texts that agree in all minima of one band meet, and what meets is compared by
the whole sets.  A pair of similarity s meets with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9998 at 0.8, more above.  Only
distinct sets are indexed, so copies cost nothing, and bands with the same members are compared once.  Members of a band
are linked as stars and not as all pairs.  A band with more than MOST members is first compared with its least member; what
this did not link is cut into parts, and each part is compared with each block of the band, so a task holds about twice
MOST sets, whatever the band.

Defined results: words are split and lowered as in simhash; a text of fewer words than a shingle is one shingle; texts
without words are copies of each other; 64-bit hashes stand for the shingles.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from . import simhash
from .common import bitmap, marked, materialize, ready
from .components import components

WORDS, BANDS, ROWS = 5, 16, 4
MOST = 256
_RNG = np.random.default_rng(42)
_A, _B = _RNG.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_A |= np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit murmur finalizer."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=7), words), np.uint64, len(words))
    k = min(WORDS, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[i : i + len(h)]
    return np.unique(_mix(h))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set's signature; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 2048):
        np.minimum(least, (own[None, i : i + 2048] * _A + _B).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def similar(one: np.ndarray, all_: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each of several sets (joined, none empty) has a similarity of 0.8 or more with one set."""
    place = np.minimum(np.searchsorted(one, all_), len(one) - 1)
    common = np.add.reduceat((one[place] == all_).astype(np.int64), np.cumsum(sizes) - sizes)
    return 9 * common >= 4 * (len(one) + sizes)  # common / union >= 4 / 5


def _stars(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Enough similar pairs that their closure is that of all similar pairs."""
    out, left = [], list(range(len(ids)))
    while left:
        queue = [left.pop(0)]
        while queue and left:
            j = queue.pop()
            n = len(sets[j])
            some = [i for i in left if 5 * min(n, len(sets[i])) >= 4 * max(n, len(sets[i]))]
            if not some:
                continue
            near = similar(sets[j], np.concatenate([sets[i] for i in some]), np.array([len(sets[i]) for i in some]))
            found = [i for i, x in zip(some, near.tolist()) if x]
            if found:
                out += [(ids[j], ids[i]) for i in found]
                queue += found
                gone = set(found)
                left = [i for i in left if i not in gone]
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, h, fp, digest, bands: of each text its hash, its SimHash, a hash of its set and its bands."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp, digest, bands = [], [], []
            for t in batch.column(2):
                text = t.as_py()
                own = shingles(text)
                fp.append(simhash.fingerprint(text))
                digest.append(xxhash.xxh64_intdigest(own.tobytes()))
                bands.append(band_keys(own))
            at = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, digest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, keys], names=["doc_id", "h", "fp", "digest", "bands"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, fp long, digest long, bands array<long>")


def _sets(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """digest, doc_id, h -> digest, own: the set of the text of one document each, as bytes."""
    key = F.xxhash64("doc_id", "h")
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    hit = marked(own, key, bitmap(needed, key)).where("hit").select(F.col("doc_id").alias("o_id"), F.col("h").alias("o_h"), "text")
    texts = hit.join(needed, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("h") == F.col("o_h"))).select("digest", "text").dropDuplicates(["digest"])

    def run(batches):
        for batch in batches:
            own = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["digest", "own"])

    return texts.mapInArrow(run, "digest long, own binary")


def _compare_groups(rows: DataFrame) -> DataFrame:
    """key, part, block, digest, own -> a, b: the stars of each (key, part, block); one group's sets are held at a time."""
    group = ("key", "part", "block")
    ordered = rows.select(*group, "digest", "own").repartition(*group).sortWithinPartitions(*group, "digest")

    def run(batches):
        at, ids, sets = None, [], []

        def close():
            found = _stars(ids, sets)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *group, digest, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if group != at:
                    if len(ids) > 1:
                        yield close()
                    at, ids, sets = group, [], []
                if not ids or ids[-1] != digest:
                    ids.append(digest), sets.append(np.frombuffer(own, np.uint64))
        if len(ids) > 1:
            yield close()

    return ordered.mapInArrow(run, "a long, b long")


def _compare_centres(rows: DataFrame) -> DataFrame:
    """key, block, blocks, least, digest, own, centre -> the same without the sets, with linked."""

    def run(batches):
        for batch in batches:
            own, centre = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            linked = [bool(similar(np.frombuffer(c, np.uint64), np.frombuffer(o, np.uint64), np.array([len(o) // 8]))[0]) for o, c in zip(own, centre)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(linked, pa.bool_())], names=["key", "block", "blocks", "least", "digest", "linked"])

    return rows.select("key", "block", "blocks", "least", "digest", "own", "centre").mapInArrow(run, "key long, block long, blocks long, least long, digest long, linked boolean")


def link(sketched: DataFrame, docs: DataFrame, most: int = MOST) -> DataFrame:
    """Output of sketches, and its documents -> a, b: pairs of digests whose closure is that of all similar pairs that meet."""
    one = sketched.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("k"), F.first("bands").alias("bands"))
    one = materialize(one, "near-distinct")
    keyed = one.select("digest", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("least"), F.bit_xor(F.xxhash64("digest")).alias("x")).where("n > 1")
    groups = materialize(groups.groupBy("n", "least", "x").agg(F.min("key").alias("key")), "near-groups")
    members = materialize(keyed.join(groups, "key").select("key", "n", "least", "digest"), "near-members")
    needed = one.join(members.select("digest").distinct(), "digest").select("digest", "k.doc_id", "k.h")
    sets = materialize(_sets(materialize(needed, "near-needed"), docs), "near-sets")
    none = F.lit(0).cast("long")
    small = members.where(F.col("n") <= most).select("key", none.alias("part"), none.alias("block"), "digest")
    blocks = F.ceil(F.col("n") / most)
    hot = members.where(F.col("n") > most).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), "blocks"))
    centres = groups.where(F.col("n") > most).withColumn("blocks", blocks).join(sets.select(F.col("digest").alias("least"), F.col("own").alias("centre")), "least")
    centres = centres.select("key", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    tried = materialize(_compare_centres(hot.join(sets, "digest").join(centres, ["key", "block"])), "near-centres")
    # what the least member did not link, in parts, against all blocks of its band: a group is one part and one block
    rest = tried.where("not linked")
    parts = rest.groupBy("key").agg(F.ceil(F.count("*") / most).alias("parts"))
    upto = lambda n: F.explode(F.sequence(none, F.col(n) - 1))
    every = rest.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("digest", F.lit(1)), "parts")).select("key", "part", upto("blocks").alias("block"), "digest")
    others = tried.join(parts, "key").select("key", upto("parts").alias("part"), "block", "digest")
    found = _compare_groups(small.unionAll(every).unionAll(others).join(sets, "digest"))
    return found.unionAll(tried.where("linked and digest <> least").select(F.col("least").alias("a"), F.col("digest").alias("b"))).distinct()


def _labels(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """nodes with `name`_c: the component of each node of that column, or the node itself."""
    found = components(edges).select(F.col("node").alias(name), F.col("component").alias("__c"))
    return nodes.join(found, name, "left").withColumn(f"{name}_c", F.coalesce("__c", name)).drop("__c")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, h, group: documents that SimHash or the shingles link have one group."""
    own = materialize(sketches(docs), "near-docs")
    labelled = _labels(own.select("doc_id", "h", "fp", "digest"), link(own, docs), "digest")
    labelled = _labels(labelled, simhash.link(materialize(own.select("fp").distinct(), "near-fps")), "fp")
    labelled = materialize(labelled.select("doc_id", "h", F.xxhash64("fp_c").alias("s"), F.col("digest_c").alias("d")), "near-labels")
    # an edge of which neither end has another one is a group by itself
    edges = labelled.select("s", "d").distinct()
    edges = edges.withColumn("n_s", F.count("*").over(Wd.partitionBy("s"))).withColumn("n_d", F.count("*").over(Wd.partitionBy("d")))
    found = components(edges.where("n_s > 1 or n_d > 1").select(F.col("s").alias("a"), F.col("d").alias("b")))
    return labelled.join(found, F.col("s") == F.col("node"), "left").select("doc_id", "h", F.coalesce("component", "s").alias("group"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which no smaller doc_id is in their group; columns as in docs.  Rows that repeat a doc_id and text are
    one document, and one of them stays."""
    first = groups(docs).groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("k"))
    return simhash.keep_keys(docs, first)
