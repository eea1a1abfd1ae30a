"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is an automaton.  Every code point has a class (letter, number, blank, other white space, other), and
with the class that follows it becomes a symbol; a symbol is a function from states to states, and functions compose
associatively.  So a block scan finds every state without walking the text: all blocks compose their functions side by
side, a prefix scan over the blocks gives each block's first state, and a second sweep marks where matches begin.  The
slices between those marks go through a cache of pair merges; their offsets are kept, so ids can be cut back into slices.

Defined results: a null text is empty and has no ids; very long texts are worked on whole; empty tables, repeated rows
and further columns change nothing else, as each row stands for itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

END, LETTER, NUMBER, OTHER, BLANK, SPACE = range(6)
#: code points with the White_Space property, fixed values
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# symbols
S_END, S_LETTER, S_NUMBER, S_OTHER, S_JOINED, S_LAST, S_WHITE, S_QUOTE1, S_QUOTE2 = range(9)
# states: X a match has ended; A N O inside a run; P a blank that the next run takes; W white space; Q1, Q2 letters to come
X, A, N, O, P, W, Q1, Q2 = range(8)
STATES, BLOCK, CHUNK = 8, 256, 1 << 18


def _tables() -> tuple[np.ndarray, np.ndarray]:
    to = np.zeros((9, STATES), np.uint8)
    begins = np.ones((9, STATES), bool)

    def symbol(s: int, fresh: int, goes_on: dict[int, int]) -> None:
        to[s] = fresh
        for state, after in goes_on.items():
            to[s, state], begins[s, state] = after, False

    symbol(S_END, X, {})
    symbol(S_LETTER, A, {A: A, P: A, Q1: X, Q2: Q1})
    symbol(S_NUMBER, N, {N: N, P: N})
    symbol(S_OTHER, O, {O: O, P: O})
    symbol(S_JOINED, P, {})
    symbol(S_LAST, X, {})
    symbol(S_WHITE, W, {W: W})
    symbol(S_QUOTE1, Q1, {O: O, P: O})
    symbol(S_QUOTE2, Q2, {O: O, P: O})
    return to.ravel(), begins.ravel()


TO, BEGINS = _tables()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, from the character database."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        kind = {"L": LETTER, "N": NUMBER}
        first = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
        for name, code in kind.items():
            table[np.fromiter((x == name for x in first), bool, len(first))] = code
        table[WHITE] = SPACE
        table[0x20] = BLANK
        _classes.append(table)
    return _classes[0]


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """points: code points with one place to spare after each text; ends: those places."""
    kind = classes()[points]
    kind[ends] = END
    after = np.append(kind[1:], END)
    white = kind >= BLANK
    symbol = kind.copy()  # END, LETTER, NUMBER and OTHER keep their numbers
    symbol[white] = S_WHITE
    last = white & (after != END) & (after < BLANK)
    symbol[last] = S_LAST
    symbol[last & (kind == BLANK)] = S_JOINED
    quote = np.flatnonzero(points == 0x27)
    quote = quote[kind[quote] != END]
    one = np.append(points[1:], [0, 0])
    a, b = one[quote], one[quote + 1]
    symbol[quote[np.isin(a, [ord(c) for c in "stmd"])]] = S_QUOTE1
    pair = a.astype(np.int64) << 21 | b
    symbol[quote[np.isin(pair, [ord(x) << 21 | ord(y) for x, y in ("re", "ve", "ll")])]] = S_QUOTE2
    return symbol


def scan(symbol: np.ndarray) -> np.ndarray:
    """Where matches begin: the block scan over transition functions."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.intp)
    grid[:n] = symbol
    grid = np.ascontiguousarray((grid * STATES).reshape(blocks, BLOCK).T)  # offsets into the tables
    f = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for row in grid:
        f = TO[row[:, None] + f]
    step = 1
    while step < blocks:
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), 1)
        step *= 2
    state = np.concatenate([[X], f[:-1, X]]).astype(np.uint8)
    out = np.empty((BLOCK, blocks), bool)
    for i, row in enumerate(grid):
        at = row + state
        out[i] = BEGINS[at]
        state = TO[at]
    return out.T.reshape(-1)[:n]


def slices(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pre-tokens of all texts one after another, their number in each text, and their offsets in it (code points)."""
    joined = "\n".join(texts) + "\n"
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    marks = np.flatnonzero(scan(symbols(points, ends)))
    is_end = np.zeros(len(points), bool)
    is_end[ends] = True
    own = ~is_end[marks]
    at = marks.tolist()
    pieces = [joined[a:b] for a, b, k in zip(at, chain(at[1:], [len(joined)]), own.tolist()) if k]
    starts = marks[own]
    doc = np.searchsorted(ends, starts)
    return pieces, np.bincount(doc, minlength=len(texts)), starts - (ends - lengths)[doc]


class Codec:
    """Ranks of a vocabulary file (token in base64, rank) to ids and back."""

    def __init__(self, content: bytes, cache: int = 250_000) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, bytes] = {}  # slice: its ids, four bytes each
        self.old: dict[str, bytes] = {}  # what the cache held before it was full; both have `cache` slices at most, and a chunk's
        self.most = cache

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merges the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        return self.merge_short(piece) if len(piece) <= 64 else self.merge_long(piece)

    def merge_short(self, piece: bytes) -> tuple[int, ...]:
        ranks, none = self.ranks, 1 << 40
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return tuple(map(ranks.__getitem__, parts))

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and a linked list, in n log n."""
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j], after[i] = stop, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if end[i])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text its ids, and the offset of the slice that each id stems from."""
        pieces, counts, offsets = slices(texts)
        if len(self.cache) > self.most:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        for s in set(pieces).difference(cache):
            cache[s] = old.get(s) or np.array(self.merge(s.encode()), "<u4").tobytes()
        found = [cache[s] for s in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)[:-1]] if len(counts) else []
        return np.split(ids, cuts), np.split(np.repeat(offsets, sizes), cuts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decode_slices(self, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes]]:
        """The slices that the ids stem from, by the offsets that encode gave: (offset, bytes)."""
        heads = np.flatnonzero(np.diff(offsets, prepend=-1))
        return [(o, self.decode(part)) for o, part in zip(offsets[heads].tolist(), np.split(ids, heads[1:]))] if len(ids) else []


_codecs: dict[int, Codec] = {}


def codec(content: bytes) -> Codec:
    key = hash(content)
    if key not in _codecs:
        _codecs[key] = Codec(content)
    return _codecs[key]


def in_chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about CHUNK code points, a longer text alone."""
    some, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if some and size + len(t) > CHUNK:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file (bounded: under 1 MB here) is read by the driver once and broadcast."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, text -> keep, ids array<int>, offsets array<int> (code points, of the slice that an id stems from)."""
    ready(docs.sparkSession)
    content = vocabulary(docs, path)
    k = len(keep)

    def run(batches):
        own = codec(content.value)
        for batch in batches:
            at = 0
            for texts in in_chunks(batch.column(k)):
                ids, offsets = own.encode(texts)
                columns = [batch.column(i).slice(at, len(texts)) for i in range(k)]
                at += len(texts)
                lists = [
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32), np.concatenate(xs).astype(np.int32))
                    for xs in (ids, offsets)
                ]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=[*keep, "ids", "offsets"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", ids array<int>, offsets array<int>"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids -> keep, decoded binary.  Null ids decode to no bytes."""
    ready(encoded.sparkSession)
    content = vocabulary(encoded, path)
    k = len(keep)

    def run(batches):
        own = codec(content.value)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(texts, pa.binary())], names=[*keep, "decoded"])

    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.select(*keep).dtypes) + ", decoded binary"
    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes, decodes the ids, and reports both as digests: doc_id, n_tokens, ids_sha256, decoded_sha256, and n_slices, the
    number of slices by the offsets.  One Python pass, so that no ids cross to the JVM and back."""
    ready(docs.sparkSession)
    content = vocabulary(docs, path)

    def run(batches):
        own = codec(content.value)
        for batch in batches:
            n, a, b, m = [], [], [], []
            for texts in in_chunks(batch.column(1)):
                for ids, offsets in zip(*own.encode(texts)):
                    n.append(len(ids))
                    m.append(int(np.count_nonzero(np.diff(offsets, prepend=-1))))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(m, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_slices"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_slices long")
