"""Quality functions on strings of Phred + 33 characters, values 0 to 93."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRINTABLE = "".join(chr(33 + q) for q in range(94))
#: The levels of 8-level quantisation by tens of the Phred value (from 70 on the last).
ILLUMINA_LEVELS = (0, 6, 15, 22, 27, 33, 37, 40)


def eight_level(q: int) -> int:
    return ILLUMINA_LEVELS[min(q // 10, 7)]


def four_level(q: int) -> int:
    return 6 if q < 10 else 15 if q < 20 else 25 if q < 30 else 37


def binary(q: int, threshold: int = 20, high: int = 40, low: int = 6) -> int:
    return high if q >= threshold else low


def eight_bin(q: int) -> int:
    """The value that an 8-level bin (bounds 2, 10, 20, 25, 30, 35, 40) stands for."""
    return next((v for top, v in ((10, 6), (20, 15), (25, 22), (30, 27), (35, 33), (40, 37)) if q < top), 40)


def _mapped(s: Column, f) -> Column:
    return F.translate(s, PRINTABLE, "".join(chr(33 + f(q)) for q in range(94)))


def quantise(s: Column, mode: str) -> Column:
    """mode: lossless, illumina8, four, binary or discard (all values 0)."""
    if mode == "discard":
        return F.repeat(F.lit("!"), F.length(s))
    return s if mode == "lossless" else _mapped(s, {"illumina8": eight_level, "four": four_level, "binary": binary}[mode])


def stored(s: Column, mode: str) -> Column:
    """What comes back after quantising, binning and unbinning; low binary values come back as 10."""
    if mode in ("lossless", "discard", "four"):
        return quantise(s, mode)
    return _mapped(s, {"illumina8": lambda q: eight_bin(eight_level(q)), "binary": lambda q: 40 if binary(q) >= 20 else 10}[mode])


def bits(mode: str) -> int:
    return {"illumina8": 3, "four": 2, "binary": 1}.get(mode, 7)


def packed_size(s: Column, mode: str) -> Column:
    """Bytes of the packed bins of a read."""
    return F.ceil(F.length(s) * bits(mode) / 8).cast("long")


def values(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substr(s, i, F.lit(1))) - 33)


def mean(s: Column) -> Column:
    """Integer mean of the characters; 0 for an empty string."""
    return F.when(F.length(s) > 0, F.floor(F.aggregate(values(s), F.lit(0), lambda a, x: a + x + 33) / F.length(s))).otherwise(0)


def context(pos: Column, q1: Column, q2: Column, prev_base: Column, base: Column) -> Column:
    """Context number of a value: position by fives (to 63), last value (to 49), whether the last two differ by more
    than 2, and the last and present base (A C G T, else 4)."""
    code = lambda b: F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).otherwise(4)
    steady = F.when(F.abs(q1 - q2) <= 2, 0).otherwise(1)
    return F.least(F.floor(pos / 5), F.lit(63)) * 2500 + F.least(q1, F.lit(49)) * 50 + steady * 25 + code(prev_base) * 5 + code(base)


def clamp8(x: Column) -> Column:
    return F.greatest(F.lit(-128), F.least(F.lit(127), x))


def to_bytes(s: Column) -> Column:
    """The values as bytes of alignment records; a character below 33 counts as 0."""
    return F.unhex(F.array_join(F.transform(values(s), lambda q: F.lpad(F.hex(F.greatest(q, F.lit(0))), 2, "0")), ""))


def from_bytes(b: Column) -> Column:
    """Characters of the bytes of alignment records; 255 (no quality) is !."""
    h = F.hex(b)
    q = lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("int")
    return F.when(F.length(h) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.when(q(i) == 255, "!").otherwise(F.chr(q(i) + 33))), "")).otherwise(F.lit(""))


def context_by_base(pos: Column, q1: Column, base: Column) -> Column:
    """Context number: position by twenties (to 19), last value (to 39) and base."""
    code = F.when(base == "A", 0).when(base == "C", 1).when(base == "G", 2).when(base == "T", 3).otherwise(4)
    return F.least(F.floor(pos / 20), F.lit(19)) * 200 + F.least(q1, F.lit(39)) * 5 + code


def context_by_byte(pos: Column, before: Column) -> Column:
    """Context number: position (by eights from 8 on) and the upper six bits of the character before."""
    return F.when(pos < 8, pos).otherwise(8 + F.floor(pos / 8)) * 64 + F.floor(before / 4)
