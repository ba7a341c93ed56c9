"""Consensus of alignment records and differences to it, an aligned stretch at a time in numpy.

`operators.align` states them over one row for each base. Here a batch's bases are counted before the shuffle, and what
is joined is a stretch of a record with a block of the consensus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.functions import dna, kernels
from strandwise.operators import align
from strandwise.operators.graph import written

#: Positions of the consensus in a row of blocks.
BLOCK = 4096
#: 4-bit code of each character, 15 for those outside the table, and the characters and digits of the codes.
CODE = np.full(256, 15, np.uint8)
CODE[np.frombuffer(dna.NIBBLES.encode(), np.uint8)] = np.arange(16)
LETTER, DIGIT = np.frombuffer(dna.NIBBLES.encode(), np.uint8), np.frombuffer(b"0123456789ABCDEF", np.uint8)
VALUE = np.zeros(256, np.uint8)
VALUE[DIGIT] = np.arange(16)


def codes(s: kernels.Seqs) -> np.ndarray:
    return CODE[np.minimum(s.text, 255)] if s.text.dtype == np.uint8 else np.where(s.text < 128, CODE[np.minimum(s.text, 127)], 15).astype(np.uint8)


def stretches(batch: pa.RecordBatch, s: kernels.Seqs) -> tuple[np.ndarray, ...]:
    """(record, query position, length, reference position or -1) of the stretches of M, =, X, I and S, within the sequence."""
    cigar = batch["cigar"]
    bounds = cigar.offsets.to_numpy().astype(np.int64)
    bounds, ops = bounds - bounds[0], cigar.flatten()
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    op, n = number(ops.field("op")), number(ops.field("len"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))

    def running(kinds: tuple) -> np.ndarray:
        own = np.where(np.isin(op, kinds), n, 0)
        total = np.cumsum(own) - own
        return total - total[bounds[row]]

    q0, r0 = running((align.M, align.I, align.S, align.EQ, align.X)), running((align.M, align.D, align.N, align.EQ, align.X))
    aligned = np.isin(op, (align.M, align.EQ, align.X))
    ref_id, pos = (number(batch[c].fill_null(-1)) for c in ("ref_id", "pos"))
    n = np.minimum(n, s.size[row] - q0)
    keep = np.flatnonzero((ref_id[row] >= 0) & (n > 0) & (aligned | np.isin(op, (align.I, align.S))))
    return row[keep], q0[keep], n[keep], np.where(aligned, pos[row] + r0, -1)[keep]


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place in it) of each of its letters."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - (np.cumsum(n) - n)[of]


def consensus(records: DataFrame) -> DataFrame:
    """(ref_id, ref_pos, nibble, n): `align.consensus` of the walk of records."""
    schema = T.StructType.fromDDL("ref_id int, ref_pos long, nibble int, n long")

    def run(batches):
        for batch in kernels.slices(batches, "seq"):
            s = kernels.Seqs(batch["seq"])
            row, q0, n, r0 = stretches(batch, s)
            keep = r0 >= 0
            row, q0, n, r0 = row[keep], q0[keep], n[keep], r0[keep]
            of, i = spread(n)
            code = codes(s)[s.start[row[of]] + q0[of] + i].astype(np.int64)
            refs, rank = np.unique(batch["ref_id"].fill_null(-1).to_numpy(zero_copy_only=False), return_inverse=True)
            place = r0[of] + i
            width = int(place.max(initial=0)) + 1
            key, counts = np.unique((rank[row[of]] * width + place)[code > 0] * 16 + code[code > 0], return_counts=True)
            arrays = [pa.array(refs[key // 16 // width].astype(np.int32)), pa.array(key // 16 % width), pa.array((key % 16).astype(np.int32)), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    kernels.ship(records.sparkSession)
    counted = records.select("ref_id", "pos", "cigar", "seq").where("ref_id >= 0").mapInArrow(run, schema)
    return align.most(counted.groupBy("ref_id", "ref_pos", "nibble").agg(F.sum("n").alias("n")))


def blocks(votes: DataFrame) -> DataFrame:
    """(ref_id, block, votes): the consensus as a text of BLOCK letters for each block, = where nothing is covered."""
    schema = T.StructType.fromDDL("ref_id int, block long, votes string")

    def run(batches):
        for batch in batches:
            listed = batch["v"]
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            cells = listed.flatten()
            out = np.full((len(listed), BLOCK), LETTER[0], np.uint8)
            out[row, cells.field("at").to_numpy().astype(np.int64)] = LETTER[cells.field("nibble").to_numpy().astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch["ref_id"], batch["block"], kernels.strings(out)], names=schema.names)

    at = F.struct((F.col("ref_pos") % BLOCK).cast("int").alias("at"), F.col("nibble").cast("int").alias("nibble"))
    return votes.groupBy("ref_id", F.floor(F.col("ref_pos") / BLOCK).alias("block")).agg(F.collect_list(at).alias("v")).mapInArrow(run, schema)


def differences(records: DataFrame, votes: DataFrame) -> DataFrame:
    """(ord, query_pos, vote, diff): for each stretch of a record the consensus under it (null for insertions and clips)
    and, a hexadecimal digit for each base, its code XOR the consensus, or the code itself without one.

    The blocks are written, so their size is known: few are broadcast, many are joined by shuffles that AQE can split.
    """
    stretch = T.StructType.fromDDL("ord long, query_pos long, ref_id int, block long, at int, part string")

    def cut(batches):
        for batch in kernels.slices(batches, "seq"):
            s = kernels.Seqs(batch["seq"])
            row, q0, n, r0 = stretches(batch, s)
            # a stretch over several blocks is one row for each
            pieces = np.where(r0 >= 0, (r0 + n - 1) // BLOCK - r0 // BLOCK + 1, 1)
            of, i = spread(pieces)
            block = np.where(r0[of] >= 0, r0[of] // BLOCK + i, -1)
            lo = np.where(block >= 0, np.maximum(r0[of], block * BLOCK) - r0[of], 0)
            hi = np.where(block >= 0, np.minimum(r0[of] + n[of], (block + 1) * BLOCK) - r0[of], n[of])
            at = np.where(block >= 0, (r0[of] + lo) % BLOCK, 0)
            of, start, size = row[of], q0[of] + lo, hi - lo
            which, j = spread(size)
            text = LETTER[codes(s)[s.start[of[which]] + start[which] + j]]
            part = pa.StringArray.from_buffers(len(of), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(text))
            took = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch["ord"].take(took), pa.array(start), batch["ref_id"].cast(pa.int32()).take(took), pa.array(block, mask=block < 0), pa.array(at.astype(np.int32)), part], names=stretch.names)

    found = T.StructType.fromDDL("ord long, query_pos long, vote string, diff string")

    def differ(batches):
        for batch in batches:
            s, v = kernels.Seqs(batch["part"]), kernels.Seqs(batch["vote"])
            vote = np.zeros(len(s.text), np.uint8)
            there = np.repeat(v.size > 0, s.size)
            vote[there] = codes(v)
            text = DIGIT[codes(s) ^ vote]
            diff = pa.StringArray.from_buffers(len(s.size), pa.py_buffer(s.start.astype(np.int32)), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays([batch["ord"], batch["query_pos"], batch["vote"], diff], names=found.names)

    kernels.ship(records.sparkSession)
    own = records.where("ref_id >= 0").select("ord", "ref_id", "pos", "cigar", "seq").mapInArrow(cut, stretch)
    both = own.join(written(blocks(votes)), ["ref_id", "block"], "left")
    under = F.when(F.col("block").isNotNull(), F.coalesce(F.substr("votes", F.col("at") + 1, F.length("part")), F.repeat(F.lit(dna.NIBBLES[0]), F.length("part"))))
    return both.select("ord", "query_pos", under.alias("vote"), "part").mapInArrow(differ, found)


def summed(diffs: DataFrame) -> DataFrame:
    """(ord, n_diff, n_equal, n_extra, diffs): aligned bases, those equal to the consensus, others, and the sum of codes."""
    schema = T.StructType.fromDDL("ord long, n_diff long, n_equal long, n_extra long, diffs long")

    def run(batches):
        for batch in batches:
            s = kernels.Seqs(batch["diff"])
            aligned = ~batch["vote"].is_null().to_numpy(zero_copy_only=False)
            value = VALUE[s.text]
            total = lambda x: np.bincount(s.row, x, len(s.size)).astype(np.int64)  # noqa: B023, E731
            arrays = [np.where(aligned, s.size, 0), np.where(aligned, total(value == 0), 0), np.where(aligned, 0, s.size), total(value)]
            yield pa.RecordBatch.from_arrays([batch["ord"], *map(pa.array, arrays)], names=schema.names)

    return diffs.mapInArrow(run, schema).groupBy("ord").agg(*[F.sum(c).alias(c) for c in schema.names[1:]])


def rebuild(diffs: DataFrame) -> DataFrame:
    """(ord, seq): the aligned, inserted and clipped bases of each record from `vote` and `diff`, in order."""
    schema = T.StructType.fromDDL("ord long, query_pos long, part string")

    def run(batches):
        for batch in batches:
            s, v = kernels.Seqs(batch["diff"]), kernels.Seqs(batch["vote"])
            code = VALUE[s.text]
            code[np.repeat(v.size > 0, s.size)] ^= codes(v)
            part = pa.StringArray.from_buffers(len(s.size), pa.py_buffer(s.start.astype(np.int32)), pa.py_buffer(LETTER[code]))
            yield pa.RecordBatch.from_arrays([batch["ord"], batch["query_pos"], part], names=schema.names)

    back = diffs.mapInArrow(run, schema).groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("query_pos", "part"))).alias("v"))
    return back.select("ord", F.array_join("v.part", "").alias("seq"))
