"""Sequence functions. Unless said otherwise a null gives a null and an empty string an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 4-bit base codes of alignment records: a fixed value of the format.
NIBBLES = "=ACMGRSVTWYHKDBN"
#: Their complements, in the same order.
NIBBLE_COMPLEMENTS = "=TGKCYSBAWRDMHVN"


def reverse_complement(s: Column) -> Column:
    """Upper case; anything but A, C, G and T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "N"), "ACGT", "TGCA"))


def reverse_complement_keep(s: Column) -> Column:
    """Other characters stay, and so does case in upper form: acgt complement to TGCA."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCATGCA"))


def is_reverse(s: Column) -> Column:
    """Whether the reverse complement is the canonical form. A palindrome keeps the forward strand."""
    return reverse_complement(s) < s


def canonical(s: Column) -> Column:
    return F.least(s, reverse_complement(s))


def restore(s: Column, was_reversed: Column) -> Column:
    """Inverse of `canonical` for upper-case A, C, G, T and N."""
    return F.when(was_reversed, reverse_complement(s)).otherwise(s)


def chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)))


def hamming(a: Column, b: Column, most: int | None = None) -> Column:
    """Differing positions over the shorter length; null above `most`."""

    def differ(v: Column) -> Column:
        n = F.least(F.length(v["a"]), F.length(v["b"]))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + (F.substr(v["a"], i, F.lit(1)) != F.substr(v["b"], i, F.lit(1))).cast("int"))).otherwise(F.lit(0))

    found = F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), differ))
    return found if most is None else let(found, lambda d: F.when(d <= most, d))


def kmer_hash(s: Column) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3), first base highest; null if another letter occurs. Up to 31 bases."""
    return F.when(s.rlike("^[ACGT]+$"), F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("long"))


def hash_kmer(h: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(h.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_hash(h: Column, k: int) -> Column:
    return kmer_hash(reverse_complement(hash_kmer(h, k)))


def count_of(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def composition_entropy(s: Column) -> Column:
    """Bits a base of the shares of A, C, G and T in the whole length, N included; 0 for an empty sequence."""
    total = F.lit(0.0)
    for base in "ACGT":
        p = count_of(s, base) / F.length(s)
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(F.length(s) > 0, total).otherwise(0.0)


def packed_size(s: Column) -> Column:
    """Bytes of a packed sequence: 4 bases a byte, or 2 where an N occurs."""
    n = F.length(s)
    return F.when(F.contains(s, F.lit("N")), F.ceil(n / 2)).otherwise(F.ceil(n / 4)).cast("long")


def varint_size(x: Column) -> Column:
    """Bytes of an unsigned LEB128 number."""
    bits = F.length(F.bin(x))
    return F.greatest(F.lit(1), F.ceil(bits / 7)).cast("long")


def zigzag(d: Column) -> Column:
    d = d.cast("long")
    return (d * 2).bitwiseXOR(F.shiftright(d, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(1)))


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once, as a lambda variable and not a repeated expression."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def running(sizes: Column, block: int = 64) -> Column:
    """array<int>: for each element of `sizes` (array<int>) the sum of those before it.

    A fold that appends copies its result with every element, so it runs over blocks, and over the sums of the blocks:
    the work grows in proportion to the elements up to some millions of them.
    """

    def fold(xs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, fold(totals, F.lit(0)), fold))

    blocks = let(sizes, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, block)))
    return F.when(F.size(sizes) > 0, let(blocks, summed)).otherwise(F.expr("cast(array() as array<int>)"))


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order; none for a shorter sequence."""
    starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(s, i, F.lit(k)))


def canonical_kmers(s: Column, k: int) -> Column:
    """All k-mers in order, each the lesser of its strands, cut from the read and from its reverse complement."""

    def cut(v: Column) -> Column:
        n = F.length(v["f"])
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.least(F.substr(v["f"], i, F.lit(k)), F.substr(v["r"], n - i - (k - 2), F.lit(k))))

    return let(F.struct(s.alias("f"), reverse_complement(s).alias("r")), cut)


def open_syncmer(s: Column, k: int = 21, m: int = 10) -> Column:
    """struct<kmer, pos>: the least canonical k-mer whose least m-mer stands at its start; the leftmost of equals.

    k-mers with letters other than A, C, G and T take no part; null if none is left.
    """

    def chosen(v: Column) -> Column:
        own = F.filter(F.sequence(F.lit(1), F.size(v["k"])), lambda i: F.get(v["m"], i - 1) == F.array_min(F.slice(v["m"], i, k - m + 1)))
        pairs = F.transform(own, lambda i: F.struct(F.get(v["k"], i - 1).alias("kmer"), (i - 1).alias("pos")))
        return F.array_min(F.filter(pairs, lambda p: ~p["kmer"].rlike("[^ACGT]")))

    return F.when(F.length(s) >= k, let(F.struct(canonical_kmers(s, k).alias("k"), kmers(s, m).alias("m")), chosen))


def minimizers(s: Column, k: int = 21, w: int = 11) -> Column:
    """array<string>: the least canonical k-mer of every window of w k-mers, equal neighbours once.

    k-mers with N count as N's complement does; sequences shorter than k + w have none.
    """

    def least(canon: Column) -> Column:
        return F.when(F.length(s) >= k + w, F.transform(F.sequence(F.lit(1), F.length(s) - (k + w - 2)), lambda i: F.array_min(F.slice(canon, i, w)))).otherwise(F.array().cast("array<string>"))

    return let(let(canonical_kmers(s, k), least), lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1))))


def minimizer_places(s: Column, k: int = 23, w: int = 9) -> Column:
    """array<struct<kmer, pos, forward>>: the least canonical k-mer of every window of w k-mers, the leftmost of equals,
    each place once; forward is whether the read has it as it stands. Sequences shorter than k + w have none."""
    none = F.expr("cast(array() as array<struct<kmer:string, pos:int>>)")

    def least(v: Column) -> Column:
        pairs = F.transform(v, lambda x, i: F.struct(x.alias("kmer"), i.alias("pos")))
        return let(pairs, lambda p: F.when(F.length(s) >= k + w, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (k + w - 2)), lambda i: F.array_min(F.slice(p, i, w))))).otherwise(none))

    return F.transform(let(canonical_kmers(s, k), least), lambda m: F.struct(m["kmer"].alias("kmer"), m["pos"].alias("pos"), (F.substr(s, m["pos"] + 1, F.lit(k)) == m["kmer"]).alias("forward")))


def sketch(s: Column, k: int, n: int) -> Column:
    """array<string>: the `n` least distinct canonical k-mers of A, C, G and T, fewer if there are fewer."""
    return let(F.filter(canonical_kmers(s, k), lambda x: ~x.rlike("[^ACGT]")), lambda v: F.slice(F.array_sort(F.array_distinct(v)), 1, n))


def closed_syncmers(s: Column, k: int = 21, m: int = 10) -> Column:
    """array<int>: places of the k-mers of A, C, G and T whose least m-mer stands at either end."""

    def chosen(v: Column) -> Column:
        ends = lambda i: (F.get(v["m"], i) == F.array_min(F.slice(v["m"], i + 1, k - m + 1))) | (F.get(v["m"], i + (k - m)) == F.array_min(F.slice(v["m"], i + 1, k - m + 1)))
        return F.filter(F.transform(v["k"], lambda x, i: F.when(ends(i) & ~x.rlike("[^ACGT]"), i)), lambda i: i.isNotNull())

    return let(F.struct(kmers(s, k).alias("k"), kmers(s, m).alias("m")), chosen)


def centre_windows(s: Column) -> Column:
    """struct<left, right>: the stretches before and after the middle, up to 32 bases or 32% of a read under 100; N as A."""
    n = F.length(s)
    c = F.floor(n / 2).cast("int")
    w = F.least(c, F.when(n > 100, F.lit(32)).otherwise(F.floor(n * 32 / 100).cast("int")))
    clean = F.translate(s, "N", "A")
    return F.struct(F.substr(clean, c - w + 1, w).alias("left"), F.substr(clean, c + 1, w).alias("right"))


def profile(values: Column, bins: int) -> Column:
    """Integer means of `bins` stretches of an array (bounds b * n / bins)."""

    def means(v: Column) -> Column:
        def mean(b: Column) -> Column:
            lo, hi = F.floor(b * F.size(v) / bins).cast("int"), F.floor((b + 1) * F.size(v) / bins).cast("int")
            return F.when(hi > lo, F.floor(F.aggregate(F.slice(v, lo + 1, hi - lo), F.lit(0), lambda a, x: a + x) / (hi - lo))).otherwise(0)

        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: mean(b))

    return let(values, means)


def mod4_delta(s: Column, before: Column) -> Column:
    """Base codes of `s` minus those of `before`, modulo 4, over the shorter length; N is 0. An array of int."""
    value = lambda x, i: F.call_function("instr", F.lit("CGT"), F.substr(x, i, F.lit(1)))
    n = F.least(F.length(s), F.length(before))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(value(s, i) - value(before, i), F.lit(4))))
