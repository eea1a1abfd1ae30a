"""k-mers of reads, their counts, and sketches of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixforge.functions import hashing
from helixforge.functions.sequence import has_ambiguous


def canonical_kmers(reads: DataFrame, k: int, keep: tuple[str, ...] = ("read_id",)) -> DataFrame:
    """keep, pos (from 1), code of every k-mer of letters A, C, G, T; shorter reads have none.  A read is turned into digits
    once, on both strands; the k-mer at a place is then a slice of each, and the smaller one is its code."""
    s, n = F.col("sequence"), F.length("sequence")
    both = reads.where(n >= k).select(
        *keep, n.alias("n"), F.translate(s, "ACGT", "0123").alias("f"), F.reverse(F.translate(s, "ACGT", "3210")).alias("r"), has_ambiguous(s).alias("amb")
    )
    places = both.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - k + 1)).alias("pos"))
    f, r = F.substr("f", F.col("pos"), F.lit(k)), F.substr("r", F.col("n") - k + 2 - F.col("pos"), F.lit(k))
    words = places.select(*keep, "pos", "amb", F.least(f, r).alias("d")).where(~F.col("amb") | (F.length(F.translate("d", "0123", "")) == 0))
    return words.select(*keep, "pos", F.conv("d", 4, -10).cast("long").alias("code"))


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """code, n.  k-mers are counted in Arrow batches, as numbers; what is shuffled are a batch's distinct codes.  A stream has
    no batches to count in, and makes a row of each k-mer."""
    if reads.isStreaming:
        return canonical_kmers(reads, k).groupBy("code").agg(F.count("*").alias("n"))

    def run(batches):
        for batch in batches:
            parts = [(s or "").encode() for s in batch.column(0).to_pylist()]
            _, codes = _canonical_codes(_CODES[np.frombuffer(b"\n".join(parts), np.uint8)], k)
            codes, n = np.unique(codes.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    return reads.select("sequence").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


CHUNK = 1 << 22  #: k-mers that a task counts at a time


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers by bytes, the lowest of all first: what is alike lies together."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted codes as differences, and their counts."""
    raw = _packed(np.diff(codes, prepend=np.uint64(0))) + _packed(n)
    return len(codes).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=16 * size, codec="zstd", asbytes=True), np.uint8).reshape(2, 8, size)
    both = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw]
    return np.cumsum(both[0], dtype=np.uint64), both[1]


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[head], np.add.reduceat(n, head)


def _records(codes: np.ndarray, n: np.ndarray, k: int) -> str:
    """">count" and the k-mer for each, without the last line's end."""
    letters = np.frombuffer(b"ACGT", np.uint8)
    size = np.ones(len(n), np.int64) + sum(n >= np.uint64(10**i) for i in range(1, 20))
    where = np.cumsum(size + k + 3) - (size + k + 3)
    out = np.full(int(where[-1] + size[-1] + k + 3), ord("\n"), np.uint8)
    out[where] = ord(">")
    left = n.copy()
    for i in range(int(size.max())):  # digits from the last
        rows = np.flatnonzero(size > i) if i else slice(None)
        out[where[rows] + size[rows] - i] = (left[rows] % np.uint64(10)).astype(np.uint8) + ord("0")
        left //= np.uint64(10)
    at = where + size + 2
    for i in range(k):
        out[at + i] = letters[(codes >> np.uint64(2 * (k - 1 - i)) & np.uint64(3)).astype(np.intp)]
    return out[:-1].tobytes().decode()


def range_bounds(reads: DataFrame, k: int, sample: int = 4000) -> tuple[np.ndarray, int]:
    """Codes that part all k-mers into ranges of about half a CHUNK, and how many k-mers there are at most.  The bounds are
    drawn from a sample of the reads; they say where a k-mer is counted, not whether."""
    n, most = reads.agg(F.count("*"), F.sum(F.greatest(F.length("sequence") - k + 1, F.lit(0)))).first()
    some = reads.where(F.pmod(F.xxhash64("sequence"), F.lit(max(1, (n or 0) // sample))) == 0).select(F.col("sequence")).limit(4 * sample)
    text = b"\n".join((r[0] or "").encode() for r in some.collect())
    codes = np.unique(_canonical_codes(_CODES[np.frombuffer(text, np.uint8)], k)[1])
    parts = max(1, -(-2 * (most or 0) // CHUNK))
    return np.unique(codes[np.arange(1, parts) * len(codes) // parts]) if len(codes) else codes, most or 0


def dump_ranges(reads: DataFrame, k: int, bounds: np.ndarray, first: int, end: int) -> DataFrame:
    """Texts of records, in the order of codes, of the ranges from first to before end.  A task counts a CHUNK of k-mers at a
    time; what is shuffled are sorted codes as packed differences, 2 to 3 bytes each, and a range is summed up by one task."""

    def counted(held):
        codes = np.concatenate(held)
        codes, n = np.unique(codes, return_counts=True)
        cut = [0, *np.searchsorted(codes, bounds[first : end - 1], side="left"), len(codes)]
        some = [(first + i, codes[a:b], n[a:b]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return pa.RecordBatch.from_pydict({"part": pa.array([x[0] for x in some], pa.int32()), "blob": pa.array([_pack(x[1], x[2]) for x in some], pa.binary())})

    def count(batches):
        held, size = [], 0
        for batch in batches:
            text = b"\n".join((s or "").encode() for s in batch.column(0).to_pylist())
            codes = _canonical_codes(_CODES[np.frombuffer(text, np.uint8)], k)[1]
            inside = np.ones(len(codes), bool)
            if first:
                inside &= codes >= bounds[first - 1]
            if end <= len(bounds):
                inside &= codes < bounds[end - 1]
            held.append(codes[inside])
            size += len(held[-1])
            if size >= CHUNK:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def written(blobs):
        codes, n = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
        codes, n = _summed(codes, n)
        for i in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_pydict({"value": pa.array([_records(codes[i : i + (1 << 16)], n[i : i + (1 << 16)], k)])})

    def write(batches):
        part, held = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and held:
                    yield from written(held)
                    held = []
                part = p
                held.append(blob)
        if held:
            yield from written(held)

    packed = reads.select("sequence").mapInArrow(count, "part int, blob binary")
    return packed.repartition(max(1, end - first), "part").sortWithinPartitions("part").mapInArrow(write, "value string")


def spectrum(counts: DataFrame) -> DataFrame:
    """How many distinct k-mers occur n times."""
    return counts.groupBy("n").agg(F.count("*").alias("n_kmers"))


_CODES = np.full(256, 4, np.uint8)
_CODES[[ord(c) for c in "ACGT"]] = range(4)
_HASH = [np.uint64(c) for c in (hashing.C1, hashing.C2)]


def _canonical_codes(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes 0 to 3 of letters (4: another letter, or between reads) -> the place of every k-mer without a 4, and its canonical
    code.  Codes of longer strings are put together from those of shorter ones, on both strands."""
    bad = np.concatenate([[0], np.cumsum(letters == 4)])
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    single = (letters & 3).astype(np.uint64)
    size, f, r = 1, single, np.uint64(3) - single  # strings of `size` letters at each place
    done, ff, rr = 0, None, None  # what of k is put together
    left = k
    while True:
        if left & 1:
            if ff is None:
                ff, rr, done = f, r, size
            else:
                m = len(f) - done
                ff, rr = ff[:m] << np.uint64(2 * size) | f[done : done + m], rr[:m] | r[done : done + m] << np.uint64(2 * done)
                done += size
        left >>= 1
        if not left:
            break
        m = len(f) - size
        f, r = f[:m] << np.uint64(2 * size) | f[size:], r[:m] | r[size:] << np.uint64(2 * size)
        size *= 2
    at = np.flatnonzero(bad[k : k + n] == bad[:n])
    return at, np.minimum(ff[at], rr[at])


def _murmur(x: np.ndarray) -> np.ndarray:
    s = np.uint64(33)
    for c in _HASH:
        x = (x ^ (x >> s)) * c
    return x ^ (x >> s)


def _sketched(reads: DataFrame, k: int, functions: int, mask: int, first: int, window: int | None) -> DataFrame:
    """read_id, window_id, keys: the least hashes of each read's (window's) k-mers.  Map-only: reads stay where they are, and
    no k-mer becomes a row."""

    def run(batches):
        for batch in batches:
            parts = [(s or "").encode() for s in batch.column(1).to_pylist()]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
            at, codes = _canonical_codes(_CODES[np.frombuffer(b"\n".join(parts), np.uint8)], k)
            read = np.searchsorted(begin, at, side="right") - 1
            part = (at - begin[read]) // (window - k + 1) if window else np.zeros(len(at), np.int64)
            head = np.flatnonzero(np.concatenate([[True], (np.diff(read) != 0) | (np.diff(part) != 0)])) if len(at) else at
            least = [np.minimum.reduceat(_murmur(codes + np.uint64(first + i)), head) if len(at) else codes for i in range(functions)]
            keys = (np.stack(least, axis=1) & np.uint64(mask & (2**64 - 1))).view(np.int64).ravel()
            offsets = np.arange(0, len(keys) + 1, functions, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(read[head])), pa.array(part[head].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(keys))], names=["read_id", "window_id", "keys"]
            )

    found = reads.select(F.col("read_id").cast("long").alias("read_id"), "sequence").mapInArrow(run, "read_id long, window_id int, keys array<long>")
    return found.select("read_id", "window_id", F.posexplode("keys").alias("i", "key")).select("read_id", "window_id", (F.col("i") + first).alias("map_id"), "key")


def minhash(reads: DataFrame, k: int, functions: int, mask: int, first: int = 0) -> DataFrame:
    """read_id, map_id, key: for each hash function the least hash over a read's k-mers, masked afterwards.  Reads shorter
    than k, and reads without a k-mer of the four letters, are not sketched."""
    return _sketched(reads, k, functions, mask, first, None).drop("window_id")


def minhash_windowed(reads: DataFrame, k: int, window: int, functions: int, mask: int, first: int = 0) -> DataFrame:
    """read_id, window_id, map_id, key: windows of window - k + 1 successive k-mers; none if k is over the window."""
    return _sketched(reads if k <= window else reads.limit(0), k, functions, mask, first, max(k, window))


def bottom_sketch(reads: DataFrame, k: int, n: int) -> DataFrame:
    """read_id, sketch: the n least distinct hashes in unsigned order; if there are fewer, all of them and one largest value
    (-1 as a signed long) as a mark.  Reads without k-mers have the mark only."""
    hashed = hashing.murmur64(canonical_kmers(reads, k), {"h": F.col("code")}).select("read_id", hashing.flip(F.col("h")).alias("h"))
    some = hashed.groupBy("read_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))  # as many as a read has k-mers
    every = reads.select("read_id").join(some, "read_id", "left")
    hs = F.coalesce("hs", F.array().cast("array<bigint>"))
    mark = F.array(F.lit(2**63 - 1))
    full = F.when(F.size(hs) >= n, F.slice(hs, 1, n)).otherwise(F.concat(hs, mark))
    return every.select("read_id", F.transform(full, hashing.flip).alias("sketch"))


def in_genome(kmers: DataFrame, genome: DataFrame) -> DataFrame:
    """Rows of kmers whose code occurs in genome, on either strand (codes are canonical)."""
    return kmers.join(genome.select("code").distinct(), "code", "left_semi")


def genome_share(counts: DataFrame, genome: DataFrame) -> DataFrame:
    """counts (code, n) and the genome's codes, each once -> n_in, weight_in, n_all, weight_all: distinct and all k-mers that the
    genome has, and all that there are.  One join and one row."""
    both = counts.join(genome.select("code", F.lit(True).alias("inside")), "code", "left")
    return both.agg(F.count_if("inside").alias("n_in"), F.sum(F.when(F.col("inside"), F.col("n"))).alias("weight_in"), F.count("*").alias("n_all"), F.sum("n").alias("weight_all"))


def lost(true: DataFrame, corrected: DataFrame) -> DataFrame:
    """Distinct true k-mers that no corrected read has."""
    return true.select("code").distinct().join(corrected.select("code"), "code", "left_anti")


def autodetect_k(reads: DataFrame, shortest: int = 16, longest: int = 32) -> int:
    """The least k for which a random k-mer is unlikely (under 1 %) to occur in all bases of the input by chance."""
    bases = reads.agg(F.sum(F.length("sequence"))).first()[0] or 0
    k = shortest
    while k < longest and bases > 0.01 * 4.0**k:
        k += 1
    return k
