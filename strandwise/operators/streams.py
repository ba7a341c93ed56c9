"""Operators over the reads of a chunk in order, as streams: reads are dealt out by chunk, sorted, and passed by once in
numpy. A read moves once as it is, in place of a row for each base; a task holds what one chunk's state takes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandwise.functions import kernels

#: Rows of a result that are given out at once.
ROWS = 1 << 16


def streamed(df: DataFrame, by: str, order: list[str], columns: list[str], fields: str, run: Callable) -> DataFrame:
    """Rows of `run`(iterator of (first of its chunk, chunk, *columns)) as `fields`, over the rows of each chunk in `order`.

    `run` yields rows in tuples of columns (lists or arrays).
    """
    schema = T.StructType.fromDDL(fields)

    def rows(batches: Iterator[pa.RecordBatch]):
        last = None
        for batch in batches:
            keys = batch[by].to_pylist()
            for key, *values in zip(keys, *(batch[c].to_pylist() for c in columns), strict=True):
                yield (last is None or last[0] != key, key, *values)
                last = (key,)

    def arrow(batches):
        arrow_types = pa.schema([pa.field(f.name, TYPES[f.dataType.simpleString()]) for f in schema])
        for columns_out in run(rows(batches)):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns_out, arrow_types, strict=True)], schema=arrow_types)

    kernels.ship(df.sparkSession)
    names = list(dict.fromkeys([by, *order, *columns]))
    return df.select(*names).repartition(by).sortWithinPartitions(by, *order).mapInArrow(arrow, schema)


TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def given(rows: Iterator[tuple]) -> Iterator[list[list]]:
    """Single rows as columns of ROWS rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield list(zip(*held, strict=True))
            held = []
    if held:
        yield list(zip(*held, strict=True))


def points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def wider(x: np.ndarray, n: int) -> np.ndarray:
    """`x` with room for n rows at least, zeros beyond its own."""
    return x if len(x) >= n else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])


def qualities(deltas: DataFrame, by: str, missing: int) -> DataFrame:
    """(ord, qual) from deltas: each added to the value above, or to `missing` where the read above has none."""

    def rows(stream):
        for first, _, ord_, d in stream:
            if first:
                above, begun = np.zeros(0, np.int64), False
            if d is None:
                above, begun = np.zeros(0, np.int64), True
                yield ord_, None
                continue
            own = np.asarray(d, np.int64)
            n = min(len(own), len(above))
            base = np.full(len(own), missing if begun else 0)
            base[:n] = above[:n]
            above, begun = own + base, True
            yield ord_, text_of(above + 33)

    return streamed(deltas, by, ["ord"], ["ord", "deltas"], "ord long, qual string", lambda s: given(rows(s)))


def sequences(deltas: DataFrame, by: str, letters: str) -> DataFrame:
    """(ord, seq) from codes: at each position the last code above that is not 0; left out where there is none."""
    of = np.array([0, *map(ord, letters)])

    def rows(stream):
        for first, _, ord_, codes in stream:
            if first:
                state = np.zeros(0, np.int64)
            if codes is None:
                yield ord_, None
                continue
            own = np.asarray(codes, np.int64)
            state = wider(state, len(own))
            seen = state[: len(own)]
            seen[own > 0] = own[own > 0]
            out = of[seen]
            yield ord_, text_of(out[out > 0])

    return streamed(deltas, by, ["ord"], ["ord", "codes"], "ord long, seq string", lambda s: given(rows(s)))


def chunks(stream: Iterator[tuple]) -> Iterator[tuple]:
    """(chunk, its rows)."""
    key, held = None, []
    for first, k, *values in stream:
        if first and held:
            yield key, held
            held = []
        key = k
        held.append(values)
    if held:
        yield key, held


def transposed(reads: DataFrame, by: str = "chunk") -> DataFrame:
    """(chunk, pos, col): the letters of a chunk's reads at each position, in the order of ord."""

    def rows(stream):
        for key, own in chunks(stream):
            seqs = [points(s) for (s,) in own if s]
            if seqs:
                letters, pos = np.concatenate(seqs), np.concatenate([np.arange(len(s)) for s in seqs])
                letters = letters[np.argsort(pos, kind="stable")]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(pos))])
                whole = text_of(letters)
                for p in range(len(bounds) - 1):
                    yield key, p, whole[bounds[p] : bounds[p + 1]]

    return streamed(reads, by, ["ord"], ["seq"], f"{by} {reads.schema[by].dataType.simpleString()}, pos int, col string", lambda s: given(rows(s)))


def votes(key, counts: np.ndarray, letters: str, start: int = 0) -> Iterator[tuple]:
    """(chunk, place, base, n) of counts (place, letter): the most frequent, ties to the later of `letters`."""
    best = counts.shape[1] - 1 - np.argmax(counts[:, ::-1], axis=1)
    n = counts[np.arange(len(counts)), best]
    for p in np.flatnonzero(n):
        yield key, int(p) + start, letters[best[p]], int(n[p])


def coded(seq: str, letters: str) -> np.ndarray:
    at = np.full(128, -1)
    at[[ord(c) for c in letters]] = np.arange(len(letters))
    p = points(seq)
    code = np.where(p < 128, at[np.minimum(p, 127)], -1)
    if (code < 0).any():
        raise ValueError(f"letters other than {letters}: {seq[:200]}")
    return code


def consensus(reads: DataFrame, letters: str, by: str = "chunk") -> DataFrame:
    """(chunk, pos, base, n): `columns.consensus` of the bases of reads at each position."""

    def rows(stream):
        key, counts, width = None, None, 0
        for first, k, seq in stream:
            if first:
                if counts is not None:
                    yield from votes(key, counts, letters)
                key, counts = k, np.zeros((0, len(letters)), np.int64)
            own = coded(seq or "", letters)
            counts = wider(counts, len(own))
            counts[np.arange(len(own)), own] += 1
        if counts is not None:
            yield from votes(key, counts, letters)

    return streamed(reads, by, [], ["seq"], f"{by} {reads.schema[by].dataType.simpleString()}, pos int, base string, n long", lambda s: given(rows(s)))


class Anchor:
    """The k-mers of a chunk's first read and where each stands first; the shift that most k-mers of a read vote for."""

    def __init__(self, seq: str | None, k: int):
        self.k, self.there = k, {}
        for i in range(len(seq or "") - k, -1, -1):
            self.there[seq[i : i + k]] = i

    def shift(self, seq: str | None) -> tuple[int, int] | None:
        """(shift, n): ties go to the least distance, then the least shift."""
        votes: dict[int, int] = {}
        for i in range(len(seq or "") - self.k + 1):
            at = self.there.get(seq[i : i + self.k])
            if at is not None:
                votes[at - i] = votes.get(at - i, 0) + 1
        if not votes:
            return None
        best = min(votes, key=lambda d: (-votes[d], abs(d), d))
        return best, votes[best]


def shifts(reads: DataFrame, k: int, by: str = "chunk") -> DataFrame:
    """(ord, chunk, shift, n): `columns.best_shifts`."""

    def rows(stream):
        for first, key, ord_, seq in stream:
            if first:
                anchor = Anchor(seq, k)
            found = anchor.shift(seq)
            if found:
                yield ord_, key, *found

    return streamed(reads, by, ["ord"], ["ord", "seq"], f"ord long, {by} {reads.schema[by].dataType.simpleString()}, shift int, n long", lambda s: given(rows(s)))


def shifted_consensus(reads: DataFrame, k: int, letters: str, by: str = "chunk") -> DataFrame:
    """(chunk, place, base, n): the consensus of reads at their positions plus their best shift."""

    def rows(stream):
        key, counts, low = None, None, 0
        for first, chunk, seq in stream:
            if first:
                if counts is not None:
                    yield from votes(key, counts, letters, low)
                key, anchor, counts, low = chunk, Anchor(seq, k), np.zeros((0, len(letters)), np.int64), 0
            found = anchor.shift(seq)
            if found:
                own, shift = coded(seq, letters), found[0]
                if shift < low:
                    counts, low = np.concatenate([np.zeros((low - shift, len(letters)), np.int64), counts]), shift
                counts = wider(counts, shift - low + len(own))
                counts[np.arange(len(own)) + (shift - low), own] += 1
        if counts is not None:
            yield from votes(key, counts, letters, low)

    return streamed(reads, by, ["ord"], ["seq"], f"{by} {reads.schema[by].dataType.simpleString()}, place int, base string, n long", lambda s: given(rows(s)))
