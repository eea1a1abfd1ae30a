"""Quality characters, error probabilities and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE, LEAST_WEIGHT = 33, 0.001


def error_probability(q: Column) -> Column:
    """Of a quality character; below '!' it is 1."""
    return F.when(F.ascii(q) < BASE, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), -(F.ascii(q) - BASE) / 10.0))


def weight(q: Column) -> Column:
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - error_probability(q))


def character(w: Column) -> Column:
    """The quality character of a weight: 'I' where the error is next to nothing, between '!' and 'I' else."""
    p = F.greatest(1 - w, F.lit(0.0))
    code = F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * 10 + BASE + 0.5)
    return F.when(p < 1e-5, F.lit("I")).otherwise(F.chr(F.least(F.greatest(code, F.lit(33)), F.lit(73)).cast("int")))


def requantize(qualities: Column, bits: int) -> Column:
    """Qualities in 2^bits steps: the middle of each step stands for it.  8 bits keep them."""
    if bits == 8:
        return qualities
    letters = [chr(c) for c in range(33, 127)]
    steps = 1 << bits
    width = -(-41 // steps)
    to = [chr(33 + min(40, min(steps - 1, (ord(c) - 33) // width) * width + width // 2)) for c in letters]
    return F.translate(qualities, "".join(letters), "".join(to))
