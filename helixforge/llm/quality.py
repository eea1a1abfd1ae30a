"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with calibrated
probabilities.

Words are runs of letters and digits or runs of other visible characters, hashed into VOCABULARY slots.  Every slot has a
sparse ternary index vector, fixed by its number.  A slot's context vector is the sum of the index vectors that stand
within WINDOW places of it, over all documents; that is the only thing gathered from the corpus, and its size is fixed.
A document is the mean of its words' vectors (index and context), the
share of its words that repeat the one before, and its length.  The network learns from a bounded
sample of labelled rows; a part of them, which it does not see, fits the temperature of its probabilities.

Defined results: a null text is empty and is scored like any text; a document whose id is null is not held out and has
no label; rows that repeat are scored each; with fewer than two classes in the sample every score is the share of
label 1 (one half with no rows at all); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

VOCABULARY, DIMENSIONS, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: at most so many labelled rows are fitted (those with the smallest hash of doc_id); bounds the driver's memory and time
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 3e-3, 1e-3
ACCEPT = 0.7
CHUNK = 1 << 15

words_of = re.compile(r"\w+|[^\w\s]+").findall


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(17)
    out = np.zeros((VOCABULARY, DIMENSIONS), np.float32)
    places = rng.permuted(np.tile(np.arange(DIMENSIONS), (VOCABULARY, 1)), axis=1)[:, :NONZERO]
    signs = rng.choice(np.array([-1, 1], np.float32), (VOCABULARY, NONZERO))
    np.put_along_axis(out, places, signs, 1)
    return out


class Slots(dict):
    """word -> slot; forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        slot = self[word] = zlib.crc32(word.encode()) % VOCABULARY
        return slot


#: column of slots that slotted makes, two bytes each; the functions below read it instead of the text where it is
SLOTS = "__slots"


def _input(docs: DataFrame) -> str:
    return SLOTS if SLOTS in docs.columns else "text"


def slotted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text -> keep and the slots of all words: the only pass over texts that are read several times."""
    ready(docs.sparkSession)
    k = len(keep)

    def run(batches):
        cache = Slots()
        for batch in batches:
            own = [np.fromiter((cache[w] for w in words_of(t.as_py() or "")), "<u2").tobytes() for t in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(own, pa.binary())], names=[*keep, SLOTS])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + f", `{SLOTS}` binary"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def slots_of(column: pa.Array, cache: Slots):
    """Batches of whole documents, texts or slots, as (number of documents, slots, document of each slot)."""
    held: list[list[int] | np.ndarray] = []
    size, known = 0, pa.types.is_binary(column.type)
    for t in column:
        t = t.as_py()
        held.append(np.frombuffer(t or b"", "<u2") if known else [cache[w] for w in words_of(t or "")])
        size += len(held[-1])
        if size > CHUNK:
            yield _flat(held, size)
            held, size = [], 0
    if held:
        yield _flat(held, size)


def _flat(held: list[list[int] | np.ndarray], size: int):
    slots = np.concatenate(held).astype(np.int32) if isinstance(held[0], np.ndarray) else np.fromiter((x for d in held for x in d), np.int32, size)
    return len(held), slots, np.repeat(np.arange(len(held)), list(map(len, held)))


def gather(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and context sums of every slot over all documents.  Each task adds its documents up and sends a row for
    each slot that it has met; what reaches the driver is VOCABULARY rows at most."""
    ready(docs.sparkSession)
    names = [f"c{i}" for i in range(DIMENSIONS)]

    def run(batches):
        index, cache = index_vectors(), Slots()
        count, context = np.zeros(VOCABULARY), np.zeros((VOCABULARY, DIMENSIONS))
        for batch in batches:
            for _, slots, doc in slots_of(batch.column(0), cache):
                if not len(slots):
                    continue
                own = index[slots]
                near = np.zeros_like(own)
                for k in range(1, WINDOW + 1):
                    same = (doc[k:] == doc[:-k])[:, None]
                    near[k:] += own[:-k] * same
                    near[:-k] += own[k:] * same
                order = np.argsort(slots, kind="stable")
                first = np.flatnonzero(np.diff(slots[order], prepend=-1))
                met = slots[order[first]]
                context[met] += np.add.reduceat(near[order], first, axis=0)
                count[met] += np.diff(np.append(first, len(slots)))
        met = np.flatnonzero(count)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), *(pa.array(context[met, i]) for i in range(DIMENSIONS))], names=["slot", "n", *names])

    parts = docs.select(_input(docs)).mapInArrow(run, "slot int, n double, " + ", ".join(f"{c} double" for c in names))
    rows = parts.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toPandas()
    count, context = np.zeros(VOCABULARY), np.zeros((VOCABULARY, DIMENSIONS))
    count[rows["slot"]] = rows["n"]
    context[rows["slot"]] = rows[names].to_numpy()
    return count, context


def word_vectors(count: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Index and context vector of each slot, the latter without the corpus mean and of length 1."""
    mean = context.sum(0) / max(1.0, count.sum())
    own = context / np.maximum(count, 1)[:, None] - mean
    own[count == 0] = 0
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    return np.hstack([index_vectors(), own]).astype(np.float32)


def pooled(n: int, slots: np.ndarray, doc: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per document the mean of its words' vectors, the share of words that repeat the one before, and the log of the length."""
    out = np.zeros((n, vectors.shape[1] + 2), np.float64)
    if len(slots):
        size = np.bincount(doc, minlength=n)
        some = np.flatnonzero(size)
        first = np.concatenate([[0], np.cumsum(size)])[some]
        again = (slots[1:] == slots[:-1]) & (doc[1:] == doc[:-1])
        out[:, -2] = np.bincount(doc[1:][again], minlength=n) / np.maximum(size, 1)
        out[some, :-2] = np.add.reduceat(vectors[slots], first, axis=0) / size[some, None]
        out[:, -1] = np.log1p(size)
    return out


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Network:
    """Adam on the logistic loss; every fifth row is kept for choosing the epoch and the temperature."""
    rng = np.random.default_rng(seed)
    kept = np.arange(len(y)) % 5 == 4
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    net = Network(vectors, mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    if len(np.unique(y[~kept])) < 2:
        share = float(y.mean()) if len(y) else 0.5
        net.w2, net.b2 = np.zeros(HIDDEN), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return net
    z, t = (x - mean) / scale, y.astype(float)
    at = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in at], [np.zeros_like(p) for p in at], 0
    own = np.flatnonzero(~kept)
    judge = np.flatnonzero(kept) if kept.any() else own
    best, best_at = np.inf, [p.copy() for p in at]

    def loss(parts: list[np.ndarray], rows: np.ndarray, heat: float = 1.0) -> float:
        s = (np.tanh(z[rows] @ parts[0] + parts[1]) @ parts[2] + parts[3]) / heat
        return float(np.mean(np.logaddexp(0, s) - t[rows] * s))

    for _ in range(max(EPOCHS, min(600, 60_000 // max(1, len(own))))):
        rng.shuffle(own)
        for i in range(0, len(own), BATCH):
            r = own[i : i + BATCH]
            h = np.tanh(z[r] @ at[0] + at[1])
            g = (1 / (1 + np.exp(-np.clip(h @ at[2] + at[3], -30, 30))) - t[r]) / len(r)
            back = g[:, None] * at[2] * (1 - h * h)
            grads = [z[r].T @ back + DECAY * at[0], back.sum(0), h.T @ g + DECAY * at[2], np.array([g.sum()])]
            step += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                at[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if (now := loss(at, judge)) < best:
            best, best_at = now, [p.copy() for p in at]
    heats = np.exp(np.linspace(np.log(0.5), np.log(5), 81))
    heat = float(heats[int(np.argmin([loss(best_at, judge, c) for c in heats]))])
    net.w1, net.b1, net.w2, net.b2, net.temperature = *best_at[:3], float(best_at[3][0]), heat
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Network:
    """docs: doc_id, text (or the output of slotted); labels: doc_id, quality.  Learns from labelled rows that are not held
    out, at most `most`.  A document with several labels counts with the largest, and a doc_id with several texts with that
    of the smallest hash."""
    ready(docs.sparkSession)
    own_text = _input(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text)
    vectors = word_vectors(*gather(docs))
    own = labels.select("doc_id", "quality").where("quality is not null").where(~held_out(F.col("doc_id")))
    few = own.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    few = few.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        cache = Slots()
        for batch in batches:
            at = 0
            for n, slots, doc in slots_of(batch.column(2), cache):
                x = pooled(n, slots, doc, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(list(x))], names=["doc_id", "quality", "x"])
                at += n

    # at most `most` rows of two numbers: bounded, so only their texts are shuffled
    sample = docs.join(F.broadcast(few), docs["doc_id"] == F.col("l_id")).groupBy(docs["doc_id"], "quality").agg(F.min_by(own_text, F.xxhash64(own_text)).alias(own_text))
    sample = sample.mapInArrow(run, "doc_id long, quality int, x array<double>")
    rows = sorted(((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["quality"], r["x"]) for r in sample.toLocalIterator()), key=lambda r: r[:3])
    x = np.array([r[3] for r in rows]).reshape(len(rows), vectors.shape[1] + 2)
    return fit(x, np.array([r[2] for r in rows], int), vectors)


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text (or the output of slotted) -> keep, score."""
    ready(docs.sparkSession)
    shared, k = docs.sparkSession.sparkContext.broadcast(net), len(keep)

    def run(batches):
        own, cache = shared.value, Slots()
        for batch in batches:
            parts = [own.probabilities(pooled(n, slots, doc, own.vectors)) for n, slots, doc in slots_of(batch.column(k), cache)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(scores)], names=[*keep, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", score double"
    return docs.select(*keep, _input(docs)).mapInArrow(run, schema)


def accept(docs: DataFrame, net: Network, least: float = ACCEPT) -> DataFrame:
    """The documents that score at least `least`; columns as in docs.  Texts are scored where they are: no shuffle."""
    ready(docs.sparkSession)
    names = docs.columns
    place = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        own, cache = shared.value, Slots()
        for batch in batches:
            parts = [own.probabilities(pooled(n, slots, doc, own.vectors)) for n, slots, doc in slots_of(batch.column(place), cache)]
            yield batch.filter(pa.array(np.concatenate(parts) >= least)) if parts else batch

    return docs.mapInArrow(run, docs.schema)
