"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits.  Two fingerprints that differ in two bits (or three) agree in one
segment up to one bit, so every distinct fingerprint is indexed under the variants of each segment with one bit as a
wildcard, 64 keys in all; fingerprints that share a key meet, and the whole of both is compared.  Only distinct
fingerprints are indexed, so copies of a document cost nothing.  A key's members are linked as a forest of stars and not
as all pairs.  A key with more than MOST members hands them on to the exact two-wildcard variants of all 64 bits, under
which four fingerprints can meet at most.  (That handing on is exact for two bits, the largest distance offered.)

Defined results: null and empty texts, and texts without words, have fingerprint zero and link like any other; texts of
fewer words than a shingle are one shingle; equal fingerprints link; rows that repeat are documents of their own; no
rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from .common import few, join_counted, materialize, ready
from .components import components

MOST = 1024

#: Keys that a task compares, at least: those of 2048 fingerprints.
TASK_KEYS = 1 << 17


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is set if over half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    shingles = [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), "<u8", len(shingles))
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """keep, text -> keep, fp (the 64 bits as a long)."""
    ready(docs.sparkSession)
    k = len(keep)

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(k)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(found.astype(np.int64))], names=[*keep, "fp"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", fp long"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def variants(distinct: DataFrame) -> DataFrame:
    """fp -> key, fp: for each segment and each of its bits the segment without that bit.  A key is segment, bit, value."""
    half = F.when(F.col("i") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    clear = F.expr("shiftleft(1L, i % 32)").bitwiseXOR(F.lit(0xFFFFFFFF))
    each = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return each.select((F.col("i").cast("long") * (1 << 32) + half.bitwiseAND(clear)).alias("key"), "fp")


def _stars(members: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the members (distinct, uint64) that differ in `bits` bits at most, as stars around one of each class."""
    out, left = [], np.ones(len(members), bool)
    for i in range(len(members)):
        if left[i]:
            left[i] = False
            queue = [i]
            while queue:
                j = queue.pop()
                near = np.flatnonzero(left & (np.bitwise_count(members ^ members[j]) <= bits))
                left[near] = False
                if len(near):
                    out.append((np.full(len(near), members[j]), members[near]))
                    queue += near.tolist()
    return out


def link(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """fp (distinct) -> a, b: enough pairs at `bits` differing bits or fewer (two at most) that their closure is that of all
    such pairs.  Rows: 64 keys a fingerprint, sorted within partitions; one key's rows are streamed."""
    return _links(distinct, bits)[0]


def _links(distinct: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """What link returns, and a number of rows that it has at most."""
    if not 0 <= bits <= 2:
        raise ValueError("bits: 0, 1 or 2")
    ready(distinct.sparkSession)
    keyed = variants(distinct)
    sorted_keys = few(keyed.repartition("key"), 64 * distinct.count(), TASK_KEYS).sortWithinPartitions("key", "fp")

    def run(batches):
        """Runs of equal keys: one star forest each; runs over MOST are passed on whole, as (key, fp)."""
        key0, held, over = None, [], False

        def close(key, parts, was_over):
            fps = np.concatenate(parts)
            if was_over:
                return [], (np.full(len(fps), key), fps)
            return _stars(fps.view(np.uint64), bits), None

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            if not len(keys):
                continue
            a, b, hot_key, hot_fp = [], [], [], []

            def put(done, a=a, b=b, hot_key=hot_key, hot_fp=hot_fp):
                pairs, hot = done
                for x, y in pairs:
                    a.append(x.view(np.int64)), b.append(y.view(np.int64))
                if hot:
                    hot_key.append(hot[0]), hot_fp.append(hot[1])

            size = np.diff(cut)
            # inner runs of two are most of those that matter, and are compared side by side
            inner = np.arange(len(size))
            inner = inner[(inner > 0) & (inner < len(size) - 1)]
            two = cut[:-1][inner[size[inner] == 2]]
            x, y = fps[two], fps[two + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= bits
            a.append(x[near]), b.append(y[near])
            for i in [0, *inner[size[inner] > 2].tolist(), *([len(size) - 1] if len(size) > 1 else [])]:
                part, key = fps[cut[i] : cut[i + 1]], keys[cut[i]]
                if 0 < i < len(size) - 1:
                    put(close(key, [part], len(part) > MOST))
                    continue
                if key != key0:
                    if held:
                        put(close(key0, held, over))
                    key0, held, over = key, [], False
                held.append(part)
                over = over or sum(map(len, held)) > MOST
                if over:  # nothing of a large run is held
                    put(close(key0, held, True))
                    held = []
            a, b = np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)
            k, f = np.concatenate(hot_key) if hot_key else np.zeros(0, np.int64), np.concatenate(hot_fp) if hot_fp else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, f])), pa.array(np.concatenate([b, f])), pa.array(np.concatenate([np.full(len(a), -1), k]))],
                names=["a", "b", "key"],
            )
        if held:
            pairs, hot = close(key0, held, over)
            for x, y in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(len(x), -1))], names=["a", "b", "key"])
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array(hot[1]), pa.array(hot[1]), pa.array(hot[0])], names=["a", "b", "key"])

    met = materialize(sorted_keys.mapInArrow(run, "a long, b long, key long"), "simhash-met")
    links, large = met.agg(F.count_if(F.col("key") == -1), F.count_if(F.col("key") >= 0)).first()
    most = links + 2 * 2016 * large
    edges = met.where("key = -1").select("a", "b").distinct()
    hot = met.where("key >= 0").select(F.col("a").alias("fp")).distinct()
    # the exact way for large runs: all pairs of wildcards, under which at most four fingerprints meet
    i, j = F.col("i"), F.col("j")
    mask = F.expr("~(shiftleft(1L, i) | shiftleft(1L, j))")
    two = hot.select("fp", F.explode(F.sequence(F.lit(1), F.lit(63))).alias("i")).select("fp", "i", F.explode(F.sequence(F.lit(0), i - 1)).alias("j"))
    met2 = two.groupBy(i, j, F.col("fp").bitwiseAND(mask).alias("v")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    if bits < 2:  # what meets differs in two bits at most
        both = met2.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where("a < b")
        return edges.unionAll(both.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).distinct()), most
    stars = met2.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", F.lit(2), F.lit(3))).alias("b"))
    return edges.unionAll(stars.distinct()), most


def near_duplicates(marked: DataFrame, bits: int = 2) -> DataFrame:
    """Output of fingerprints, with doc_id -> doc_id, fp, component_id: the smallest doc_id that links of `bits` bits reach."""
    marked = materialize(marked, "simhash-docs")
    every = marked.count()
    own = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("__n"))
    own = materialize(few(own, every), "simhash-distinct")
    distinct = own.count()
    found = components(*_links(own.select("fp"), bits))
    placed = own.join(found, own["fp"] == found["node"], "left").select("fp", "least", "__n", F.coalesce("component", "fp").alias("component"))
    placed = materialize(few(placed, 2 * distinct), "simhash-placed")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("__m"))
    # neither a large component nor a text of many copies meets in one task
    of = join_counted(placed, ids, ["component"], distinct, "__m").select("fp", "__n", "component_id")
    return few(join_counted(marked, of, ["fp"], every, "__n").drop("__n"), every)


def keep_one(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """The documents of which no smaller doc_id is in their group; columns as in docs.  Rows that repeat a doc_id and text are
    one document, and one of them stays."""
    marked = materialize(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), ("doc_id", "h"), width), "simhash-docs")
    return keep_keys(docs, near_duplicates(marked, bits).groupBy("component_id").agg(F.min(F.struct("doc_id", "h")).alias("k")))


def keep_keys(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The documents that first names, k: (doc_id, hash of the text), each once: of rows that repeat both, the one whose other
    columns have the smallest hash."""
    first = first.select(F.col("k.doc_id").alias("__k_id"), F.col("k.h").alias("__k_h"))
    own = docs.withColumn("__h", F.xxhash64("text"))
    kept = own.join(first, own["doc_id"].eqNullSafe(first["__k_id"]) & (own["__h"] == first["__k_h"]), "left_semi")
    other = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    one = Wd.partitionBy("doc_id", "__h").orderBy(F.xxhash64(*other))
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*docs.columns)
