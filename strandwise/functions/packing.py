"""Packed forms of sequences and qualities, and the way back. Packed values are binary; a null gives a null.

Bits are filled from the highest of each byte, and the last byte is filled with zeros, but for `pack_codes`, which
fills from the lowest. Lengths are not stored, so the way back takes them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwise.functions.dna import let

#: Codes of the bases: with two bits, and with four bits where an N occurs (a fixed value of the format).
TWO_BITS, FOUR_BITS = "ACGT", "AGCTN"
HEX = "0123456789ABCDEF"
PAIRS = "".join(a + b for a in TWO_BITS for b in TWO_BITS)


def every(n: Column, step: int) -> Column:
    """1, 1 + step, ... up to n; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))


def bytes_of(digits: Column) -> Column:
    """The bytes of hexadecimal digits, filled up with a zero."""
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def pack2(seq: Column) -> Column:
    """Four bases a byte; anything but A, C, G and T counts as A."""
    code = lambda s, i: F.greatest(F.call_function("instr", F.lit(TWO_BITS), F.substr(s, i, F.lit(1))) - 1, F.lit(0))
    # beyond the end substr gives '', whose place in a string is 1: code 0
    return let(seq, lambda s: bytes_of(F.array_join(F.transform(every(F.length(s), 2), lambda i: F.substr(F.lit(HEX), code(s, i) * 4 + code(s, i + 1) + 1, F.lit(1))), "")))


def unpack2(packed: Column, n: Column) -> Column:
    """`n` bases of `pack2`."""
    return let(F.hex(packed), lambda h: F.substr(F.array_join(F.transform(every(F.length(h), 1), lambda i: F.substr(F.lit(PAIRS), F.call_function("instr", F.lit(HEX), F.substr(h, i, F.lit(1))) * 2 - 1, F.lit(2))), ""), F.lit(1), n))


def pack(seq: Column) -> Column:
    """struct<wide, data>: two bits a base, or four where the sequence has an N."""
    wide = F.contains(seq, F.lit("N"))
    return F.struct(wide.alias("wide"), F.when(wide, bytes_of(F.translate(seq, FOUR_BITS, "01234"))).otherwise(pack2(seq)).alias("data"))


def unpack(packed: Column, n: Column) -> Column:
    return F.when(packed["wide"], F.substr(F.translate(F.hex(packed["data"]), "01234", FOUR_BITS), F.lit(1), n)).otherwise(unpack2(packed["data"], n))


def pack_masked(seq: Column) -> Column:
    """struct<data, mask>: two bits a base (N as A), and a bit for each base that is an N. Other letters become A."""
    bit = lambda s, i: (F.substr(s, i, F.lit(1)) == "N").cast("int")
    mask = let(seq, lambda s: bytes_of(F.array_join(F.transform(every(F.length(s), 4), lambda i: F.substr(F.lit(HEX), bit(s, i) * 8 + bit(s, i + 1) * 4 + bit(s, i + 2) * 2 + bit(s, i + 3) + 1, F.lit(1))), "")))
    return F.struct(pack2(seq).alias("data"), mask.alias("mask"))


def unpack_masked(packed: Column, n: Column) -> Column:
    """`n` bases of `pack_masked`."""

    def back(v: Column) -> Column:
        mask = lambda i: F.shiftright(F.call_function("instr", F.lit(HEX), F.substr(v["mask"], F.floor((i - 1) / 4).cast("int") + 1, F.lit(1))) - 1, 0)
        weight = lambda i: F.element_at(F.array(*[F.lit(x) for x in (8, 4, 2, 1)]), (i - 1) % 4 + 1)
        return F.array_join(F.transform(every(F.length(v["seq"]), 1), lambda i: F.when(mask(i).bitwiseAND(weight(i)) > 0, "N").otherwise(F.substr(v["seq"], i, F.lit(1)))), "")

    return let(F.struct(unpack2(packed["data"], n).alias("seq"), F.hex(packed["mask"]).alias("mask")), back)


def pack_codes(codes: Column, bits: int) -> Column:
    """Numbers below 2 ** bits (array<int>), `bits` each, from the lowest bit of the first byte on."""

    def packed(v: Column) -> Column:
        # the last code first gives the bits of the whole from the highest on
        digits = F.array_join(F.transform(F.reverse(v), lambda c: F.lpad(F.bin(c.cast("long")), bits, "0")), "")
        whole = F.lpad(digits, (F.ceil(F.size(v) * bits / 8) * 8).cast("int"), F.lit("0"))
        return let(whole, lambda b: F.unhex(F.array_join(F.transform(F.reverse(every(F.length(b), 8)), lambda i: F.lpad(F.conv(F.substr(b, i, F.lit(8)), 2, 16), 2, "0")), "")))

    return let(codes, packed)


def unpack_codes(packed: Column, n: Column, bits: int) -> Column:
    """`n` numbers of `pack_codes`."""

    def bits_of(h: Column) -> Column:
        return F.array_join(F.transform(F.reverse(every(F.length(h), 2)), lambda i: F.lpad(F.conv(F.substr(h, i, F.lit(2)), 16, 2), 8, "0")), "")

    return let(F.struct(bits_of(F.hex(packed)).alias("b"), n.alias("n")), lambda v: F.transform(every(v["n"], 1), lambda i: F.conv(F.substr(v["b"], F.length(v["b"]) - i * bits + 1, F.lit(bits)), 2, 10).cast("int")))
