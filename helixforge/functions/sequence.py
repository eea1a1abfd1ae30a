"""Columns over DNA sequences.  Letters A, C, G, T have the codes 0 to 3; a complement is 3 minus the code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper(s: Column) -> Column:
    return F.upper(s)


def has_ambiguous(s: Column) -> Column:
    """Whether a sequence has a letter other than A, C, G, T (of a null sequence: null)."""
    return F.length(F.translate(s, "ACGT", "")) > 0


def reverse_complement(s: Column) -> Column:
    """Other letters stay as they are."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    """The smaller of a string and its reverse complement: in the order of codes, as letters sort like them."""
    return F.least(s, reverse_complement(s))


def encode(s: Column) -> Column:
    """Two bits a letter, at most 32 letters, as the signed long of the 64 bits.  Null if another letter occurs."""
    return F.when(~has_ambiguous(s), F.conv(F.translate(s, "ACGT", "0123"), 4, -10).cast("long"))


def decode(code: Column, length: int) -> Column:
    """Digits come from the 64 bits, as conv takes the decimal text of the least long for another number."""
    digits = F.lpad(F.conv(F.hex(code.cast("long")), 16, 4), length, "0")
    return F.translate(digits, "0123", "ACGT")


def planes(s: Column) -> tuple[Column, Column]:
    """High and low bit of each letter, as the longs of two bit strings (at most 64 letters)."""
    high, low = (F.conv(F.translate(s, "ACGT", bits), 2, -10).cast("long") for bits in ("0011", "0101"))
    return high, low


def _pieces(s: Column, size: int) -> Column:
    """A sequence cut into pieces of `size` letters; an empty one has none."""
    n = F.ceil(F.length(s) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substr(s, i * size + 1, F.lit(size)))).otherwise(F.when(n == 0, F.array().cast("array<string>")))


def encode_all(s: Column) -> Column:
    """A sequence of any length as longs, one for each 32 letters.  Null if another letter occurs."""
    return F.when(~has_ambiguous(s), F.transform(_pieces(s, 32), encode))


def decode_all(codes: Column, length: Column) -> Column:
    """The sequence of `length` letters that encode_all made the codes of."""
    return F.array_join(F.transform(codes, lambda c, i: F.substr(decode(c, 32), F.lit(33) - F.least(F.lit(32), length - i * 32), F.lit(32))), "")


def distance_all(a: Column, b: Column) -> Column:
    """Hamming distance of two sequences of one length, whatever it is, from the planes of their pieces."""
    each = F.zip_with(_pieces(a, 64), _pieces(b, 64), lambda x, y: plane_distance(planes(x), planes(y)).cast("int"))
    return F.aggregate(each, F.lit(0), lambda n, x: n + x)


def plane_distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Hamming distance of two sequences of one length from their planes."""
    return F.bit_count(a[0].bitwiseXOR(b[0]).bitwiseOR(a[1].bitwiseXOR(b[1])))


def kmers(s: Column, k: int) -> Column:
    """All k-mers by position, array<string>; shorter sequences have none."""
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, k))).otherwise(F.array().cast("array<string>"))


def kmer_mask(code: Column, k: int) -> Column:
    return code if k == 32 else code.bitwiseAND(F.lit((1 << 2 * k) - 1))


def close(l: Column, r: Column) -> Column:
    return F.abs(l - r) < 1e-5


def at_most(l: Column, r: Column) -> Column:
    return (l < r) | close(l, r)


def at_least(l: Column, r: Column) -> Column:
    return (l > r) | close(l, r)


def label(header: Column, q: Column, prefix: str = "correction") -> Column:
    """The header with the confidence of the correction, 0 to 3."""
    return F.concat(header, F.lit(f" {prefix}:q="), q.cast("string"))
