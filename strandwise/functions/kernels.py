"""Kernels over batches of sequences, in numpy within mapInArrow: k-mers as whole numbers, their choice and their counts.

A batch is one array of letters, cut at the ends of its sequences, so the work is a few passes over the letters whatever
k is. They give what the Column functions of `functions.dna` give. A k-mer of A, C, G, N and T is known by its number in
base 5, in alphabetical order; where another letter occurs, the slice of the batch is numbered over the letters that it
has, and such a k-mer is known by its letters in the column `odd` (with m = -1; else `odd` is empty).
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of a batch that are worked on at once (a longer sequence is taken alone).
SLICE = 1 << 21
LETTERS, BASES = np.frombuffer(b"ACGNT", np.uint8), np.frombuffer(b"ACGT", np.uint8)
RANK = np.full(256, 255, np.uint8)
RANK[LETTERS] = np.arange(5)
TURN = {ord(a): ord(b) for a, b in zip("ACGTacgt", "TGCATGCA", strict=True)}
BIG = np.iinfo(np.int64).max


def ship(spark: SparkSession) -> None:
    """Give executors this package, as a zip that the driver serves, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandwise_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "strandwise.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "strandwise")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    sc._strandwise_shipped = True


def later(x: np.ndarray, a: int) -> np.ndarray:
    """x[i + a] at i, 0 beyond the end."""
    return np.concatenate([x[a:], np.zeros(min(a, len(x)), x.dtype)])


def over(x: np.ndarray, n: int, join: Callable) -> np.ndarray:
    """`x` joined over n neighbours from i on, by doubling: join(left, length of left, right, length of right)."""
    whole, have, power, size = None, 0, x, 1
    while True:
        if n & size:
            whole = power if whole is None else join(whole, have, later(power, have), size)
            have += size
        if size * 2 > n:
            return whole
        power, size = join(power, size, later(power, size), size), size * 2


def numbers(codes: np.ndarray, k: int, base: int) -> np.ndarray:
    """The number of the k letters from i on, the first letter highest."""
    return over(codes.astype(np.int64), k, lambda a, na, b, nb: a * base**nb + b)


def turned(codes: np.ndarray, k: int, base: int) -> np.ndarray:
    """The number of the k letters from i on, the last letter highest."""
    return over(codes.astype(np.int64), k, lambda a, na, b, nb: a + b * base**na)


def first_least(x: np.ndarray, n: int) -> np.ndarray:
    """Where the least of the n values from i on stands, the leftmost of equals."""
    at, size = np.arange(len(x)), 1
    while size < n:
        step = min(size, n - size)
        other = np.concatenate([at[step:], np.full(min(step, len(at)), len(x) - 1)])
        at, size = np.where(x[other] < x[at], other, at), size + step
    return at


class Seqs:
    """The sequences of a batch: `text` (letters one after another), `start` (n + 1 bounds), `row` of each letter."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.string()).fill_null("")
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2]
        self.text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        self.start = bounds - bounds[0]
        if (self.text > 127).any():
            strings = column.to_pylist()
            self.text = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
            self.start = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.size = np.diff(self.start)
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.pos = np.arange(len(self.text)) - self.start[self.row]
        self.left = self.size[self.row] - self.pos
        codes = RANK[self.text] if self.text.dtype == np.uint8 else np.full(len(self.text), 255, np.uint8)
        self.plain = not (codes == 255).any()
        self.alphabet = LETTERS if self.plain else np.unique(np.concatenate([LETTERS.astype(self.text.dtype), self.text]))
        self.codes = codes if self.plain else np.searchsorted(self.alphabet, self.text)
        turn = np.array([TURN.get(int(c), ord("N")) for c in self.alphabet])
        self.turn = np.searchsorted(self.alphabet, turn)[self.codes]

    def within(self, k: int) -> np.ndarray:
        """Whether k letters of one sequence stand from i on."""
        return self.left >= k

    def strands(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the k-mers and of their reverse complements, in alphabetical order."""
        base = len(self.alphabet)
        if base**k < BIG:
            return numbers(self.codes, k, base), turned(self.turn, k, base)
        at = np.minimum(np.arange(len(self.text))[:, None] + np.arange(k), max(len(self.text) - 1, 0))
        rank = np.unique(np.concatenate([self.codes[at], self.turn[at][:, ::-1]]), axis=0, return_inverse=True)[1].reshape(-1)
        return rank[: len(self.text)].astype(np.int64), rank[len(self.text) :].astype(np.int64)

    def known(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers in base 4) of the k-mers of A, C, G and T as they stand; k up to 31."""
        two, fit = np.searchsorted(BASES, self.text), np.isin(self.text, BASES)
        at = np.flatnonzero(self.within(k) & (over(fit.astype(np.uint8), k, lambda a, na, b, nb: a & b) > 0))
        return at, numbers(two, k, 4)[at]

    def canonical(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, whether it is that of the other strand, whether it has other letters than A, C, G and T)."""
        forward, back = self.strands(k)
        other = back < forward
        odd = lambda of: over((~np.isin(of, BASES)).astype(np.uint8), k, lambda a, na, b, nb: a | b) > 0
        bad = odd(self.text) if self.plain else np.where(other, odd(self.alphabet[self.turn]), odd(self.text))
        return np.where(other, back, forward), other, bad

    def cut(self, at: np.ndarray, k: int, other: np.ndarray | None = None) -> pa.Array:
        """The k letters from each `at` on as strings, of the other strand where `other` says so."""
        places = np.minimum(at[:, None] + np.arange(k), max(len(self.text) - 1, 0))
        out = self.text[places]
        if other is not None:
            out = np.where(other[:, None], self.alphabet[self.turn[places]][:, ::-1], out)
        return strings(out)

    def named(self, number: np.ndarray, at: np.ndarray, k: int, other: np.ndarray) -> list[pa.Array]:
        """(m, odd) of k-mers."""
        if self.plain:
            return [pa.array(number[at]), pa.array(np.full(len(at), "", object), pa.string())]
        texts = self.cut(at, k, other[at]).to_pylist()
        fit = [set(s) <= set("ACGNT") for s in texts]
        value = [sum("ACGNT".index(c) * 5 ** (k - 1 - i) for i, c in enumerate(s)) if f else -1 for s, f in zip(texts, fit, strict=True)]
        return [pa.array(value, pa.int64()), pa.array(["" if f else s for s, f in zip(texts, fit, strict=True)], pa.string())]

    def selected(self, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(windows, least, number, other): of each window of w k-mers, in sequences of k + w letters or more, the place
        of the least canonical one, the leftmost of equals."""
        number, other, _ = self.canonical(k)
        least = first_least(np.where(self.within(k), number, BIG), w)
        windows = np.flatnonzero((self.left >= k + w - 1) & (self.size[self.row] >= k + w))
        return windows, least[windows], number, other


def strings(letters: np.ndarray) -> pa.Array:
    """Rows of a matrix of letters as strings."""
    n, k = letters.shape
    if letters.dtype == np.uint32 or (letters > 127).any():
        return pa.array([x.astype("<u4").tobytes().decode("utf-32-le") for x in letters], pa.string())
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters.astype(np.uint8))))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE letters of `column`, a row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            begun = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, begun + SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to


def mapped(df: DataFrame, keep: list[str], fields: str, kernel: Callable, column: str = "seq") -> DataFrame:
    """Rows of `kernel(Seqs)`, which gives (row of the batch, arrays of `fields`), with the columns `keep` of those rows."""
    schema = T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(fields).fields)

    def run(batches):
        for batch in slices(batches, column):
            rows, arrays = kernel(Seqs(batch[column]))
            took = [batch[c].take(pa.array(rows)) for c in keep]
            yield pa.RecordBatch.from_arrays(took + list(arrays), names=schema.names)

    ship(df.sparkSession)
    return df.select(*keep, *([] if column in keep else [column])).mapInArrow(run, schema)


def syncmers(reads: DataFrame, keep: list[str], k: int = 21, m: int = 10) -> DataFrame:
    """Rows of `reads` (columns `keep`) with kmer, hash and spos of `dna.open_syncmer`; null where there is none."""

    def kernel(s: Seqs):
        number, other, bad = s.canonical(k)
        forward = s.strands(m)[0]
        least = over(forward, k - m + 1, lambda a, na, b, nb: np.minimum(a, b))
        own = np.flatnonzero(s.within(k) & ~bad & (forward == least))
        # the least number of each sequence, the leftmost of equals
        order = np.lexsort((own, number[own], s.row[own]))
        own = own[order]
        own = own[np.unique(s.row[own], return_index=True)[1]]
        at = np.full(len(s.size), -1)
        at[s.row[own]] = np.arange(len(own))
        took = pa.array(at, mask=at < 0)
        places = own[:, None] + np.arange(k)
        two = np.where(other[own][:, None], s.alphabet[s.turn[places]][:, ::-1], s.text[places])
        digits = np.searchsorted(BASES, two).astype(np.int64)
        hashes = digits @ (4 ** np.arange(k - 1, -1, -1, dtype=np.int64))
        return np.arange(len(s.size)), [strings(two).take(took), pa.array(hashes).take(took), pa.array(s.pos[own].astype(np.int32)).take(took)]

    return mapped(reads, keep, "kmer string, hash long, spos int", kernel)


def closed_syncmers(reads: DataFrame, k: int = 21, m: int = 10) -> DataFrame:
    """(ord, p): array<int> of `dna.closed_syncmers`, for reads that have one."""

    def kernel(s: Seqs):
        bad = over((~np.isin(s.text, BASES)).astype(np.uint8), k, lambda a, na, b, nb: a | b) > 0
        forward = s.strands(m)[0]
        least = over(forward, k - m + 1, lambda a, na, b, nb: np.minimum(a, b))
        at = np.flatnonzero(s.within(k) & ~bad & ((forward == least) | (later(forward, k - m) == least)))
        rows, counts = np.unique(s.row[at], return_counts=True)
        return rows, [lists(counts, pa.array(s.pos[at].astype(np.int32)))]

    return mapped(reads, ["ord"], "p array<int>", kernel)


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def minimizers(reads: DataFrame, k: int = 21, w: int = 11, distinct: bool = False) -> DataFrame:
    """(ord, place, m, odd): the minimizers of `dna.minimizers`, with the place of the first window of each run; those
    that a read has several times once, if `distinct`. k is up to 27."""

    def kernel(s: Seqs):
        at, least, number, other = s.selected(k, w)
        if distinct:
            order = np.lexsort((at, number[least], s.row[at]))
            at, least = at[order], least[order]
        new = fresh(s, at, number[least])
        return s.row[at[new]], [pa.array(s.pos[at[new]].astype(np.int32)), *s.named(number, least[new], k, other)]

    return mapped(reads, ["ord"], "place int, m long, odd string", kernel)


def minimizer_text(k: int) -> Column:
    """The letters of a minimizer (m, odd)."""
    return F.when(F.col("m") < 0, F.col("odd")).otherwise(F.translate(F.lpad(F.conv(F.col("m").cast("string"), 10, 5), k, "0"), "01234", "ACGNT"))


def fresh(s: Seqs, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which windows are the first of their sequence or have another value than the one before."""
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (s.row[at[1:]] != s.row[at[:-1]])
    return new


def minimizer_lists(reads: DataFrame, k: int = 21, w: int = 11) -> DataFrame:
    """(ord, m): array<string> of `dna.minimizers`, for reads that have one."""

    def kernel(s: Seqs):
        at, least, number, other = s.selected(k, w)
        new = fresh(s, at, number[least])
        rows, counts = np.unique(s.row[at[new]], return_counts=True)
        return rows, [lists(counts, s.cut(least[new], k, other[least[new]]))]

    return mapped(reads, ["ord"], "m array<string>", kernel)


def minimizer_places(reads: DataFrame, k: int = 23, w: int = 9, text: bool = True) -> DataFrame:
    """(ord, kmer, pos, forward) of `dna.minimizer_places`; with `text` false m and odd in place of kmer."""

    def kernel(s: Seqs):
        at, least, number, other = s.selected(k, w)
        new = fresh(s, at, least)  # places of the leftmost least never go back
        least = least[new]
        own = [s.cut(least, k, other[least])] if text else s.named(number, least, k, other)
        return s.row[least], [*own, pa.array(s.pos[least].astype(np.int32)), pa.array(~other[least])]

    return mapped(reads, ["ord"], ("kmer string" if text else "m long, odd string") + ", pos int, forward boolean", kernel)


def sketches(reads: DataFrame, k: int, n: int) -> DataFrame:
    """(ord, s): array<string> of `dna.sketch`, empty for reads without a k-mer."""

    def kernel(s: Seqs):
        number, other, bad = s.canonical(k)
        at = np.flatnonzero(s.within(k) & ~bad)
        at = at[np.lexsort((number[at], s.row[at]))]
        at = at[fresh(s, at, number[at])]
        first = np.searchsorted(s.row[at], np.arange(len(s.size)))
        at = at[np.arange(len(at)) - first[s.row[at]] < n]
        counts = np.bincount(s.row[at], minlength=len(s.size))
        return np.arange(len(s.size)), [lists(counts, s.cut(at, k, other[at]))]

    return mapped(reads, ["ord"], "s array<string>", kernel)


def kmer_hashes(reads: DataFrame, k: int) -> DataFrame:
    """(ord, pos, hash, kmer, reverse) of all k-mers of A, C, G and T: numbers in base 4, of both strands. k up to 31."""

    def kernel(s: Seqs):
        at, x = s.known(k)
        return s.row[at], [pa.array(s.pos[at].astype(np.int32)), pa.array(x), s.cut(at, k), pa.array(turned(3 - np.searchsorted(BASES, s.text), k, 4)[at])]

    return mapped(reads, ["ord"], "pos int, hash long, kmer string, reverse long", kernel)


def kmer_counts(reads: DataFrame, k: int, canonical: bool = True, both: bool = False) -> DataFrame:
    """(x, n): occurrences of k-mers of A, C, G and T by their number in base 4, summed; k up to 31.

    canonical: by the lesser of their strands; both: on either strand, as they stand. A batch is counted before the
    shuffle, so its copies are one row.
    """

    def kernel(s: Seqs):
        at, x = s.known(k)
        if canonical or both:
            y = turned(3 - np.searchsorted(BASES, s.text), k, 4)[at]
            x = np.minimum(x, y) if canonical else np.concatenate([x, y])
        x, n = np.unique(x, return_counts=True)
        return np.zeros(0, np.int64), [pa.array(x), pa.array(n)]

    return mapped(reads.select("seq"), [], "x long, n long", kernel).groupBy("x").agg(F.sum("n").alias("n"))


def letters_of(x: Column, k: int) -> Column:
    """The k-mer of a number in base 4, eight letters at a time."""
    out = [F.translate(F.lpad(F.conv(F.shiftright(x, 2 * max(k - a - 8, 0)).bitwiseAND(4 ** min(8, k - a) - 1).cast("string"), 10, 4), min(8, k - a), "0"), "0123", "ACGT") for a in range(0, k, 8)]
    return F.concat(*out)


def compared(df: DataFrame, a: str, b: str, name: str = "mismatches") -> DataFrame:
    """`df` with the number of positions at which the texts `a` and `b` differ, over the shorter length (`dna.hamming`)."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])

    def run(batches):
        for batch in slices(batches, a):
            s, t = Seqs(batch[a]), Seqs(batch[b])
            n = np.minimum(s.size, t.size)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            differ = s.text[s.start[row] + at] != t.text[t.start[row] + at]
            none = pc.or_(pc.is_null(batch[a]), pc.is_null(batch[b])).to_numpy(zero_copy_only=False)
            found = pa.array(np.bincount(row[differ], minlength=len(n)).astype(np.int32), mask=none)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def context_counts(reads: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """(model, columns of all sets, n): how often each combination of a set's columns stands at a base, others null.

    pos from 0, pos5 (pos div 5), base, q (Phred value), p1, p2 and so on (the letters before, null where there are
    fewer), q1 and q2 (values before), steady (0 where the last two values, 0 for missing, differ by 2 or less, else 1).
    A batch is counted before the shuffle.
    """
    columns = sorted({c for own in sets.values() for c in own})
    kind = lambda c: "string" if c == "base" or c[0] == "p" and c[1:].isdigit() else "int"
    fields = "model string, " + ", ".join(f"{c} {kind(c)}" for c in columns) + ", n long"
    schema = T.StructType.fromDDL(fields)

    def coded(c: str, s: Seqs, q: np.ndarray) -> np.ndarray:
        """Whole numbers from 0, where 0 is null in columns that can be."""
        if c in ("pos", "pos5"):
            return s.pos // (5 if c == "pos5" else 1)
        if c == "base":
            return s.codes.astype(np.int64)
        if c == "q":
            return q
        if c == "steady":
            one, two = (np.where(s.pos >= k, before(q, k) - 33, 0) for k in (1, 2))
            return (np.abs(one - two) > 2).astype(np.int64)
        k = int(c[1:])
        if c[0] == "q":
            return np.where(s.pos >= k, before(q, k) + 1, 0)
        return np.where(s.pos >= k, before(numbers(s.codes, k, len(s.alphabet)), k) + 1, 0)

    def shown(c: str, s: Seqs, q: np.ndarray, at: np.ndarray) -> pa.Array:
        if kind(c) == "string":
            k = 0 if c == "base" else int(c[1:])
            there = s.pos[at] >= k
            return s.cut(np.where(there, at - k, 0), max(k, 1)).take(pa.array(np.arange(len(at)), mask=~there)) if len(at) else pa.array([], pa.string())
        value = coded(c, s, q)[at]
        if c == "q":
            return pa.array((value - 33).astype(np.int32))
        return pa.array((value - 34).astype(np.int32), mask=value == 0) if c in ("q1", "q2") else pa.array(value.astype(np.int32))

    def run(batches):
        for batch in slices(batches, "seq"):
            s, t = Seqs(batch["seq"]), Seqs(batch["qual"])
            q = np.zeros(len(s.text), np.int64)
            there = s.pos < t.size[s.row]
            q[there] = t.text[(t.start[s.row] + s.pos)[there]]
            codes = {c: coded(c, s, q) for c in columns}
            for name, own in sets.items():
                key, size = np.zeros(len(s.text), np.int64), 1
                for c in own:
                    more = int(codes[c].max(initial=0)) + 1
                    if size * more >= 1 << 62:
                        key = np.unique(key, return_inverse=True)[1].reshape(-1)
                        size = int(key.max(initial=0)) + 1
                    key, size = key * more + codes[c], size * more
                if size <= 1 << 23:
                    counts, at = np.bincount(key, minlength=size), np.zeros(size, np.int64)
                    at[key] = np.arange(len(key))
                    found = np.flatnonzero(counts)
                    counts, at = counts[found], at[found]
                else:
                    _, at, counts = np.unique(key, return_index=True, return_counts=True)
                arrays = [shown(c, s, q, at) if c in own else pa.nulls(len(at), pa.string() if kind(c) == "string" else pa.int32()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), *arrays, pa.array(counts.astype(np.int64))], names=schema.names)

    ship(reads.sparkSession)
    return reads.select("seq", "qual").mapInArrow(run, schema).groupBy("model", *columns).agg(F.sum("n").alias("n"))


def before(x: np.ndarray, k: int) -> np.ndarray:
    """x[i - k] at i, 0 before the start."""
    return np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[: max(len(x) - k, 0)]])


def bits(s: Seqs, value: np.ndarray, each: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(binary, byte of each letter, its shift): `each` bits a letter from the highest of each byte, the last filled with zeros."""
    per = 8 // each
    sizes = -(-s.size // per)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at, shift = bounds[s.row] + s.pos // per, 8 - each - each * (s.pos % per)
    data = np.bincount(at, value.astype(np.int64) << shift, bounds[-1]).astype(np.uint8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]), at, shift


def masked(reads: DataFrame) -> DataFrame:
    """(ord, data, mask, places, back): `packing.pack_masked`, the places of N, and the sequence rebuilt from both."""

    def kernel(s: Seqs):
        two = np.zeros(256, np.int64)
        two[BASES] = np.arange(4)
        n = s.text == ord("N")
        data, at, shift = bits(s, two[np.minimum(s.text, 255)], 2)
        mask, mask_at, mask_shift = bits(s, n, 1)
        code = (np.frombuffer(data.buffers()[2], np.uint8)[at] >> shift) & 3
        out = np.where((np.frombuffer(mask.buffers()[2], np.uint8)[mask_at] >> mask_shift) & 1 > 0, ord("N"), BASES[code]).astype(np.uint8)
        back = pa.StringArray.from_buffers(len(s.size), pa.py_buffer(s.start.astype(np.int32)), pa.py_buffer(out))
        return np.arange(len(s.size)), [data, mask, lists(np.bincount(s.row[n], minlength=len(s.size)), pa.array(s.pos[n].astype(np.int32))), back]

    return mapped(reads, ["ord"], "data binary, mask binary, places array<int>, back string", kernel)


def phred_bytes(reads: DataFrame) -> DataFrame:
    """(ord, b, back): `quality.to_bytes` of the qualities and `quality.from_bytes` of those."""

    def kernel(s: Seqs):
        if (s.text > 127).any():
            raise ValueError("qualities must be characters of ASCII")
        own, bounds = np.maximum(s.text.astype(np.int64) - 33, 0).astype(np.uint8), pa.py_buffer(s.start.astype(np.int32))
        b = pa.BinaryArray.from_buffers(pa.binary(), len(s.size), [None, bounds, pa.py_buffer(own)])
        return np.arange(len(s.size)), [b, pa.StringArray.from_buffers(len(s.size), bounds, pa.py_buffer(own + 33))]

    return mapped(reads, ["ord"], "b binary, back string", kernel, "qual")


def anchors(reads: DataFrame, k: int, number: int) -> DataFrame:
    """(ord, n, a, is_rc, x): the k-mers of A, C, G and T at `number` even steps of each read and of its reverse
    complement, by their number in base 4; n is the read's length."""

    def kernel(s: Seqs):
        known, x = s.known(k)
        y = turned(3 - np.searchsorted(BASES, s.text), k, 4)[known]
        place = np.full(len(s.text) + 1, -1)
        place[known] = np.arange(len(known))
        own = np.flatnonzero(s.size >= k)
        step = np.unique(np.stack([np.tile(own, number), np.concatenate([i * (s.size[own] - k) // (number - 1) for i in range(number)])]), axis=1)
        row, a = step
        row, a, rc = np.tile(row, 2), np.tile(a, 2), np.repeat([False, True], len(a))
        at = place[s.start[row] + np.where(rc, s.size[row] - k - a, a)]
        row, a, rc, at = row[at >= 0], a[at >= 0], rc[at >= 0], at[at >= 0]
        return row, [pa.array(s.size[row].astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(rc), pa.array(np.where(rc, y[at], x[at]))]

    return mapped(reads, ["ord"], "n int, a int, is_rc boolean, x long", kernel)


def places(refs: DataFrame, k: int) -> DataFrame:
    """(ref, size, p, x): the k-mers of A, C, G and T of references (ref, seq) by their number in base 4, their places,
    and the reference's length."""

    def kernel(s: Seqs):
        at, x = s.known(k)
        return s.row[at], [pa.array(s.size[s.row[at]].astype(np.int32)), pa.array(s.pos[at].astype(np.int32)), pa.array(x)]

    return mapped(refs, ["ref"], "size int, p int, x long", kernel)
