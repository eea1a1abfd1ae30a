"""Removal of repeated passages by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller doc_id, or earlier in
the same one.  Strings lie within a document and are judged on the input.

Which suffixes meet.  Every string of LENGTH bytes (a window) belongs to the one of its GRAM-byte strings with the least
hash, the leftmost of equal ones; equal windows have equal anchors at equal places.  The windows of an anchor follow one
another, so a document is a list of runs of windows, each with its anchor.  A run whose anchor no other run has cannot
repeat and is left out.  That is all that hashes decide: which suffixes are merged, never which are repeated.  The others
go, with their bytes, to bins of whole anchors.

How they are merged.  A bin is cut into shards.  Each shard sorts the suffixes of its strings, a sentinel after each string,
and keeps the byte before each suffix in that order: its Burrows-Wheeler transform.  From then on no suffixes are compared
or sorted.  The merge starts with the shards' suffixes one shard after another, as if no byte were known, and refines this
interleave byte by byte: reading the transforms in the order of the interleave, each suffix hands its place to the one that
is longer by the byte before it, and these are counted out by that byte, in order (one pass with a bucket for each byte,
the last-to-first step).  After round n the interleave is in the order of the first n bytes, and two neighbours that the
rounds have not parted have n bytes in common.  A suffix that is parted from both its neighbours has no longer prefix in
common with any other and leaves; what is still together after LENGTH rounds is an interval of equal windows, and all but
the earliest are repeated.

How it is spread.  Each task first merges the runs of a chunk of its own documents whose anchors meet there, so that of
copies in a chunk one goes on.  Anchors with over MOST runs are merged in parts of about MOST, what the parts leave is
merged again, and where that no longer shrinks (many different texts around one common phrase), windows with one hash
of the whole window meet instead of runs with one anchor.  A part that is repeated stays repeated: it has an earlier equal
window, and the earliest of all is never dropped.

Defined results: a null text is empty; rows that repeat a doc_id and a text are one document, and each gets its result;
documents that share a doc_id come in the order of their texts' hashes, a null doc_id first; documents shorter than
LENGTH keep all; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, join_counted, marked, materialize, n_buckets, ready

LENGTH, GRAM = 100, 24
#: runs in a bin, bytes of a shard, and runs of one anchor in one task
BIN, SHARD, MOST = 16_384, 1 << 16, 16_384
CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BITS = 28
_LOW = np.uint64((1 << _BITS) - 1)
_FIRST = -(2**63)
_RUN = "h long, doc long, dh long, a int, b int"


class Hashes:
    """Hashes of substrings of a buffer, from running sums of a polynomial modulo 2^64."""

    _codes = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        power = np.full(n + 1, _BASE)
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._codes[data] * power[:n], out=self.sums[1:])
        self.back = np.full(n + 1, _INVERSE)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.back[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes (a multiple of eight), eight bytes at a time."""
    n = len(data) - GRAM + 1
    padded = np.ascontiguousarray(data)
    out = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        out = (out ^ np.ndarray((n,), "<u8", padded, k, (1,))) * _BASE
        out ^= out >> np.uint64(32)
    return mixed(out)


def least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive keys, from running minima of blocks, forwards and backwards."""
    n = len(keys)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.uint64(2**64 - 1))
    grid[:n] = keys
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(buffer: np.ndarray, firsts: np.ndarray, ends: np.ndarray):
    """Pieces at firsts..ends of one buffer -> for each run its piece, first and last window (in the buffer), and the hash of
    its anchor."""
    none = np.zeros(0, np.int64)
    if len(buffer) < LENGTH:
        return none, none, none, none
    grams = gram_hashes(buffer)
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = (least_in((grams & ~_LOW) | place, LENGTH - GRAM + 1) & _LOW).astype(np.int64)
    piece = np.repeat(np.arange(len(ends)), ends - firsts)[: len(anchor)]
    whole = np.ones(len(anchor), bool)
    for e in ends[:-1].tolist():
        whole[max(0, e - LENGTH + 1) : e] = False  # windows that would go beyond their piece
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none, none
    new = np.concatenate([[True], (np.diff(anchor[at]) != 0) | (np.diff(piece[at]) != 0)])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return piece[first], first, last, grams[anchor[first]].view(np.int64)


# --- transforms and their merge ---


class Shard(NamedTuple):
    """before: the transform, a byte (plus one; zero is the sentinel) for each suffix in order.  longer: the place, in that
    order, of the suffix that is longer by that byte.  rank: the place of the suffix that begins at a position."""

    before: np.ndarray
    longer: np.ndarray
    rank: np.ndarray


def _alone(new: np.ndarray) -> np.ndarray:
    """Where new says which rows begin a block: the rows that are a block by themselves."""
    out = new.copy()
    out[:-1] &= new[1:]
    return out


def sorted_suffixes(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of t in the order of their first `depth` bytes at least, and the place of each in it.  The first eight
    bytes (four of a wider kind) are compared as one number; then what is tied is ranked by ranks, over twice as many each
    time."""
    n, wide = len(t), t.dtype.itemsize
    known = 8 // wide
    padded = np.zeros(n + known, t.dtype.newbyteorder(">"))
    padded[:n] = t
    key = np.ndarray((n,), ">u8", padded, 0, (wide,)).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the place of the first of equal ones
    at = np.flatnonzero(~_alone(new))
    while len(at) and known < depth:
        p = order[at]
        key = (rank[p] << 32) | np.where(p + known < n, rank[np.minimum(p + known, n - 1)] + 1, 0)
        by = np.argsort(key)
        p, key = p[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        order[at] = p
        rank[p] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~_alone(new)]
        known *= 2
    rank[order] = np.arange(n)
    return order, rank


def transform(texts: list[bytes], depth: int = 2 * LENGTH) -> Shard:
    """The transform of a shard's texts, a sentinel after each."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    is_end = np.zeros(len(data), bool)
    is_end[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1] = True
    # bytes plus one; a text in UTF-8 has no byte 255, but strings may be any
    t = data + np.uint8(1) if np.count_nonzero(data == 255) == len(texts) else data.astype(np.uint16) + np.uint16(1)
    t[is_end] = 0
    order, rank = sorted_suffixes(t, depth)
    return Shard(t[order - 1], rank[order - 1].astype(np.int32), rank.astype(np.int32))


class Merge:
    """The merge of some shards' transforms.  Positions and places are numbered on through all shards."""

    def __init__(self, shards: list[Shard]) -> None:
        first = (np.cumsum([len(s.before) for s in shards]) - [len(s.before) for s in shards]).tolist()
        self.before = np.concatenate([s.before for s in shards])
        self.longer = np.concatenate([s.longer + np.int32(f) for s, f in zip(shards, first)])
        self.rank = np.concatenate([s.rank + np.int32(f) for s, f in zip(shards, first)])

    def refine(self, ends: np.ndarray, life: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings of `life` bytes before the positions `ends` -> those that are equal to another one, interval after interval, and
        the number of the interval of each.  One shard's strings come after another's, each in their shard's order; a
        round moves every string to its suffix that is longer by a byte, in the order of these bytes."""
        who = np.argsort(self.rank[ends], kind="stable").astype(np.int32)
        now, block = self.rank[ends[who]], np.zeros(len(who), np.int32)
        least, most = (int(life.min()), int(life.max())) if len(life) else (0, 0)
        found, of, numbered = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for n in range(1, most + 1):
            if not len(now):
                break
            byte = self.before[now]
            to = np.argsort(byte, kind="stable")  # of small numbers: a counting pass, not a sort by comparison
            byte, block, now, who = byte[to], block[to], self.longer[now[to]], who[to]
            new = np.concatenate([[True], (block[1:] != block[:-1]) | (byte[1:] != byte[:-1])])
            block = np.cumsum(new, dtype=np.int32)
            if n >= least:
                done = life[who] == n
                ready, number = who[done], block[done]
                if len(ready):
                    single = _alone(np.concatenate([[True], number[1:] != number[:-1]]))
                    found.append(ready[~single])
                    of.append(number[~single].astype(np.int64) + numbered)
                    numbered += int(number[-1]) + 1
                    now, who, block = now[~done], who[~done], block[~done]
            if n % 4 == 0 and len(now):
                stays = ~_alone(np.concatenate([[True], block[1:] != block[:-1]]))
                now, who, block = now[stays], who[stays], block[stays]
        return np.concatenate(found), np.concatenate(of)


def _earlier(found: np.ndarray, of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of equal strings and the strings' places -> the strings that are repeated, and those that are there again at
    the place of the earliest."""
    if not len(found):
        return found, found
    heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    own, width = place[found], np.diff(np.append(heads, len(of)))
    least = np.repeat(np.minimum.reduceat(own, heads), width)
    first = own == least
    lead = np.repeat(np.minimum.reduceat(np.where(first, np.arange(len(of)), len(of)), heads), width)
    return found[~first], found[first & (np.arange(len(of)) != lead)]


def repeated(texts: list[bytes], text: np.ndarray, at: np.ndarray, own: np.ndarray, h: np.ndarray, document: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of `own` windows, at `at` of texts[text] and from `start` of their documents (numbered in order) -> for each window of
    each run, in order, whether an equal window starts earlier; and the runs that are there a second time.

    First the interleave is refined over whole runs: runs of one length that stay together to their first byte are equal,
    and all windows of all but the earliest are repeated.  Then over single windows, of the earliest runs of those anchors
    that have several."""
    hit, second = np.zeros(int(own.sum()), bool), np.zeros(len(own), bool)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(size) - size
    cuts = np.flatnonzero(np.diff(first // SHARD, prepend=-1)).tolist() if len(texts) else []
    if not cuts:
        return hit, second
    shards = Merge([transform(texts[i:j]) for i, j in zip(cuts, [*cuts[1:], len(texts)])])
    position, number = first[text] + at, np.cumsum(own) - own
    again, second_runs = _earlier(*shards.refine(position + own + LENGTH - 1, own + LENGTH - 1), (document << 32) | start)
    second[second_runs] = True
    whole = second.copy()
    whole[again] = True
    hit[np.repeat(number[again], own[again]) + _counts(own[again])] = True
    left = np.flatnonzero(~whole)
    _, inverse, count = np.unique(h[left], return_inverse=True, return_counts=True)
    left = left[count[inverse] > 1]
    into, of = _counts(own[left]), np.repeat(left, own[left])
    windows, _ = _earlier(*shards.refine(position[of] + into + LENGTH, np.full(len(of), LENGTH)), (document[of] << 32) | (start[of] + into))
    hit[(number[of] + into)[windows]] = True
    return hit, second


def _counts(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of several sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _numbered(doc: np.ndarray, dh: np.ndarray) -> np.ndarray:
    """The number of each row's document in the order of (doc, dh)."""
    sort = np.lexsort((dh, doc))
    out = np.empty(len(sort), np.int64)
    out[sort] = np.cumsum(np.concatenate([[False], (np.diff(doc[sort]) != 0) | (np.diff(dh[sort]) != 0)])) if len(sort) else 0
    return out


def _stretches(hit: np.ndarray, own: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are hit, run after run -> the run, and the first and last window of each stretch of them."""
    of = np.repeat(np.arange(len(own)), own)
    at = np.flatnonzero(hit)
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of[at]) != 0)]) if len(at) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
    shift = (start - (np.cumsum(own) - own))[of[at[heads]]]
    return of[at[heads]], at[heads] + shift, at[tails] + shift


# --- from documents to bins ---


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), F.xxhash64(text).alias("dh"), text.cast("binary").alias("bytes"), F.col("doc_id").isNull().alias("null_id")
    )


def _chunks(texts: pa.Array):
    """Lists of (row, offset, bytes) of about CHUNK bytes together.  A long text comes in pieces that share LENGTH - 1 bytes, so
    that every window is in one piece."""
    held, size = [], 0
    for row, t in enumerate(texts):
        t = t.as_py() or b""
        for at in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            piece = t[at : at + CHUNK + LENGTH - 1]
            if held and size + len(piece) > CHUNK:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield held


def _merged_chunk(data: bytes, piece: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray, document: np.ndarray, start: np.ndarray):
    """Runs a..b of a chunk's buffer, from `start` of their documents -> which windows of the buffer (by their first byte) are
    repeated in it, and the stretches of windows that are left.  Runs that follow one another are one text of the merge."""
    gone, left = np.zeros(len(data), bool), np.ones(len(data), bool)
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    if len(some):
        new = np.concatenate([[True], (a[some][1:] != b[some][:-1] + 1) | (np.diff(piece[some]) != 0)])
        text, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        begins, stops = a[some][heads], b[some][np.append(heads[1:], len(some)) - 1] + LENGTH
        own = b[some] - a[some] + 1
        hit, second = repeated([data[x:y] for x, y in zip(begins.tolist(), stops.tolist())], text, a[some] - begins[text], own, h[some], document[some], start[some])
        at = np.repeat(a[some], own) + _counts(own)
        gone[at[hit]] = True
        left[at[hit | np.repeat(second, own)]] = False
    own = b - a + 1
    of, first, last = _stretches(left[np.repeat(a, own) + _counts(own)], own, a)
    return gone, of, first, last


def runs(documents: DataFrame) -> DataFrame:
    """doc, dh, bytes -> h, doc, dh, a, b: every run of windows a..b with the hash of its anchor, after the runs of a chunk that
    share an anchor have been merged; with null h the stretches of windows that are repeated in their chunk."""

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for chunk in _chunks(batch.column(2)):
                rows, offsets = (np.array(x, np.int64) for x in zip(*((r, o) for r, o, _ in chunk)))
                ends = np.cumsum([len(p) for _, _, p in chunk])
                firsts = np.concatenate([[0], ends[:-1]])
                data = b"".join(p for _, _, p in chunk)
                piece, a, b, h = runs_of(np.frombuffer(data, np.uint8), firsts, ends)
                shift = firsts - offsets
                gone, left, a, b = _merged_chunk(data, piece, a, b, h, _numbered(ids[rows[piece]], hashes[rows[piece]]), a - shift[piece])
                piece, h = piece[left], h[left]
                at, width = np.flatnonzero(gone), ends - firsts
                of = np.searchsorted(ends, at, side="right")
                new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)]) if len(at) else np.zeros(0, bool)
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
                piece = np.concatenate([of[heads], piece])
                a, b = np.concatenate([at[heads], a]) - shift[piece], np.concatenate([at[tails], b]) - shift[piece]
                named = pa.array(np.concatenate([np.zeros(len(heads), np.int64), h]), mask=np.arange(len(piece)) < len(heads))
                yield pa.RecordBatch.from_arrays(
                    [named, pa.array(ids[rows[piece]]), pa.array(hashes[rows[piece]]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["h", "doc", "dh", "a", "b"]
                )

    return documents.select("doc", "dh", "bytes").mapInArrow(run, _RUN)


def contexts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of runs (h, n, doc, dh, a, b): h, n, doc, dh, a, s.  Only documents with such runs are shuffled."""
    listed = materialize(wanted.groupBy("doc", "dh").agg(F.collect_set(F.struct("h", "n", "a", "b")).alias("runs")), "suffix-wanted")
    some = marked(documents, F.xxhash64("doc", "dh"), bitmap(listed.select("doc", "dh"), F.xxhash64("doc", "dh"))).where("hit").drop("hit")
    both = some.dropDuplicates(["doc", "dh"]).join(listed, ["doc", "dh"]).select("doc", "dh", "bytes", "runs")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64).to_pylist()
                out = [(r["h"], r["n"], x["doc"], x["dh"], r["a"], x["bytes"][r["a"] : r["b"] + LENGTH]) for x in part for r in x["runs"]]
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.binary())], names=["h", "n", "doc", "dh", "a", "s"]
                    )

    return both.mapInArrow(run, "h long, n long, doc long, dh long, a int, s binary")


def solve(part: pd.DataFrame, keep: bool) -> pd.DataFrame:
    """Runs h, doc, dh, a, s -> doc, dh, a, b of the stretches of windows that are repeated; and if the rest is kept, its
    stretches with h and their bytes s."""
    part = part.sort_values(["doc", "dh", "a"], kind="stable")
    h, doc, dh, start = (part[c].to_numpy(np.int64) for c in ("h", "doc", "dh", "a"))
    strings = part["s"].tolist()
    own = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
    hit, second = repeated(strings, np.arange(len(strings)), np.zeros(len(strings), np.int64), own, h, _numbered(doc, dh), start)
    of, a, b = _stretches(hit, own, start)
    gone = pd.DataFrame({"doc": doc[of], "dh": dh[of], "a": a.astype(np.int32), "b": b.astype(np.int32)})
    if not keep:
        return gone
    of, a, b = _stretches(~(hit | np.repeat(second, own)), own, start)
    bytes_ = [strings[i][x - s : y - s + LENGTH] for i, x, y, s in zip(of.tolist(), a.tolist(), b.tolist(), start[of].tolist())]
    rest = pd.DataFrame({"h": h[of], "doc": doc[of], "dh": dh[of], "a": a.astype(np.int32), "b": b.astype(np.int32), "s": bytes_})
    both = pd.concat([gone.assign(h=0, s=None), rest])
    return both[["h", "doc", "dh", "a", "b", "s"]]


def _windows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs doc, dh, a, s -> h, n, doc, dh, a, s: their windows by a hash of the whole window, where another one has it; and
    these hashes, h and n."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                strings = part.column(3).to_pylist()
                own = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
                of = np.repeat(np.arange(len(strings)), own)
                into = np.arange(own.sum()) - (np.cumsum(own) - own)[of]
                data = b"".join(strings)
                at = (np.cumsum(own + LENGTH - 1) - own - LENGTH + 1)[of] + into
                h = Hashes(np.frombuffer(data, np.uint8)).grams(LENGTH)[at].view(np.int64)
                s = pa.array([data[x : x + LENGTH] for x in at.tolist()], pa.binary())
                place = (part.column(2).to_numpy()[of] + into).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), *(part.column(k).take(pa.array(of)) for k in (0, 1)), pa.array(place), s], names=["h", "doc", "dh", "a", "s"])

    each = rows.select("doc", "dh", "a", "s").mapInArrow(run, "h long, doc long, dh long, a int, s binary")
    several = materialize(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-hashes")
    return join_counted(each, several, ["h"], _size(several)[0]).select("h", "n", "doc", "dh", "a", "s"), several


def _size(counted: DataFrame) -> tuple[int, int]:
    """The sum of all n, and the largest."""
    total, most = counted.agg(F.sum("n"), F.max("n")).first()
    return total or 0, most or 0


def settle(found: DataFrame, total: int, most: int, whole: bool = False) -> DataFrame:
    """Runs h, n (how many have this h), doc, dh, a, s -> doc, dh, a, b: the stretches of windows that are repeated.
    total: how many runs, most: the largest n.  whole: they are windows with one hash, which no other key parts."""
    many = F.col("n") > MOST
    found = materialize(found, "suffix-strings") if most > MOST else found
    small, hot, done = found.where(~many), found.where(many), []
    while most > MOST:
        salt = F.pmod(F.xxhash64("doc", "dh", "a"), F.ceil(F.col("n") / MOST))
        level = hot.groupBy("h", salt.alias("salt"), "n").applyInPandas(lambda part: solve(part, True).assign(n=part["n"].iloc[0]), "h long, doc long, dh long, a int, b int, s binary, n long")
        level = materialize(level, "suffix-level")
        done.append(level.where("s is null").select("doc", "dh", "a", "b"))
        left = level.where("s is not null").withColumnRenamed("n", "before").drop("b")
        now = materialize(left.groupBy("h").agg(F.count("*").alias("n")), "suffix-left")
        left = materialize(join_counted(left, now, ["h"], total), "suffix-rest")
        shrunk = F.lit(whole) | (F.col("n") * 2 <= F.col("before"))
        small = small.unionAll(left.where(~many | F.lit(whole)).select(small.columns))
        stuck = left.where(many & ~shrunk)
        if not stuck.isEmpty():
            each, several = _windows(stuck)
            done.append(settle(each, *_size(several), True))
        hot = left.where(many & shrunk & F.lit(not whole)).select(small.columns)
        most = hot.agg(F.max("n")).first()[0] or 0
    binned = small.withColumn("bin", F.pmod("h", F.lit(n_buckets(total, BIN)))).groupBy("bin").applyInPandas(lambda part: solve(part, False), "doc long, dh long, a int, b int")
    for d in done:
        binned = binned.unionAll(d)
    return binned


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc, dh, a, b: bytes that go (spans may overlap); doc is the doc_id, the least number for null, and dh
    the hash of the text."""
    ready(docs.sparkSession)
    documents = _documents(docs).drop("null_id")
    found = materialize(runs(documents), "suffix-runs")
    named = found.where("h is not null")
    anchors = materialize(named.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-anchors")
    hit = marked(named, F.col("h"), bitmap(anchors, F.col("h"))).where("hit").drop("hit")
    total, most = _size(anchors)
    wanted = join_counted(hit, anchors, ["h"], total)
    gone = found.where("h is null").select("doc", "dh", "a", "b").unionAll(settle(contexts(documents, wanted), total, most))
    return gone.select("doc", "dh", "a", (F.col("b") + LENGTH).cast("int").alias("b"))


def report(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.  Texts that lose nothing are not shuffled."""
    ready(docs.sparkSession)
    lists = gone.groupBy("doc", "dh").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    lists = materialize(lists, "suffix-spans")
    documents = _documents(docs)
    flagged = marked(documents, F.xxhash64("doc", "dh"), bitmap(lists, F.xxhash64("doc", "dh")))
    doc_id = F.when(~F.col("null_id"), F.col("doc")).alias("doc_id")
    zero = F.lit(0).cast("long")
    whole = flagged.where("not hit").select(doc_id, F.octet_length("bytes").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"))
    cut = flagged.where("hit").drop("hit").join(lists, ["doc", "dh"], "left").select(doc_id, "bytes", "spans")

    def run(batches):
        for batch in batches:
            n, removed, count, digest = [], [], [], []
            for text, some in zip(batch.column(1), batch.column(2)):
                text, some = text.as_py(), some.as_py() or []
                kept, at, lost, k = hashlib.sha256(), 0, 0, 0
                end = -1
                for s in sorted((x["a"], x["b"]) for x in some):
                    if s[0] > end:  # spans that touch are one
                        kept.update(text[at : s[0]])
                        at, k = s[0], k + 1
                    end = max(end, s[1])
                    lost += max(0, s[1] - at)
                    at = max(at, s[1])
                kept.update(text[at:])
                n.append(len(text)), removed.append(lost), count.append(k), digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return whole.unionAll(cut.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
