"""Packed forms, column operators, codecs and block readers against plain Python."""

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandwise.functions import codecs, packing, quality
from strandwise.operators import columns, graph, mapping, stats
from strandwise.sources import bam


def reads_of(rng, n, lengths=(0, 1, 3, 4, 5, 8, 9, 30)):
    return ["".join(rng.choices("ACGT" if i % 2 else "ACGTN", k=lengths[i % len(lengths)])) for i in range(n)]


def test_packed_forms_come_back(spark):
    rng = random.Random(1)
    seqs = reads_of(rng, 60)
    n = F.length("s")
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string")
    out = df.select("i", "s", packing.pack(F.col("s")).alias("p"), packing.pack_masked(F.col("s")).alias("m"), n.alias("n")).select("*", packing.unpack(F.col("p"), F.col("n")).alias("a"), packing.unpack_masked(F.col("m"), F.col("n")).alias("b"))
    for r in out.collect():
        assert (r.a, r.b) == (r.s, r.s)
        value = sum("ACGT".index(c) << 2 * (3 - k % 4) for k, c in enumerate(r.s[:4]) if c != "N")
        assert not r.s or r.m.data[0] == value
        assert r.p.wide == ("N" in r.s) and len(r.p.data) == -(-r.n // (2 if r.p.wide else 4))


@pytest.mark.parametrize("bits", [1, 2, 3, 7])
def test_packed_codes_fill_from_the_lowest_bit(spark, bits):
    rng = random.Random(bits)
    rows = [[rng.randrange(2**bits) for _ in range(n)] for n in (0, 1, 2, 7, 8, 9, 50)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<int>")
    out = df.select("i", F.size("x").alias("n"), packing.pack_codes(F.col("x"), bits).alias("p")).select("*", packing.unpack_codes(F.col("p"), F.col("n"), bits).alias("back"))
    for r in out.collect():
        assert r.back == rows[r.i]
        assert int.from_bytes(r.p, "little") == sum(c << bits * k for k, c in enumerate(rows[r.i]))
        assert len(r.p) == -(-len(rows[r.i]) * bits // 8)


def test_column_deltas_come_back(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, s, "".join(chr(33 + rng.randrange(41)) for _ in s)) for i, s in enumerate(x for x in reads_of(rng, 80) if x)]
    df = spark.createDataFrame(rows, "ord long, chunk long, seq string, qual string")
    assert {tuple(r) for r in columns.undo_quality_deltas(columns.quality_deltas(df)).collect()} == {(r[0], r[3]) for r in rows}
    assert {tuple(r) for r in columns.undo_read_deltas(columns.read_deltas(df)).collect()} == {(r[0], r[2]) for r in rows}
    assert columns.undo_read_deltas(columns.read_deltas(df.limit(0))).count() == 0
    both = df.select("qual", quality.from_bytes(quality.to_bytes(F.col("qual"))).alias("back"))
    assert both.where("qual != back").count() == 0


def test_rescaled_model(spark):
    df = spark.createDataFrame([(0, 1, "aab"), (0, 2, "ba"), (0, 0, "b")], "chunk long, ord long, s string")
    (r,) = stats.rescaled_bits(df, "chunk", "ord", "s", "ab", 4).collect()
    state, bits = [1, 1], 0.0
    for c in "baabba":
        k = "ab".index(c)
        bits -= math.log2(state[k] / sum(state))
        state[k] += 1
        if sum(state) > 4:
            state = [(x + 1) // 2 for x in state]
    assert r.n == 6 and abs(r.bits - bits) < 1e-9


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codecs(spark, codec):
    df = spark.createDataFrame([(b"",), (None,), (b"abc" * 999,)], "b binary")
    out = df.select("b", codecs.compress(F.col("b"), codec).alias("c")).select("b", "c", codecs.decompress(F.col("c"), codec).alias("back")).collect()
    assert all(r.b == r.back for r in out) and len(out[2].c) < 100
    with pytest.raises(ValueError):
        codecs.compress(F.col("b"), "none")


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 6 + b"\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def test_blocks_and_stream():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    parts = [data[k : k + 30_000] for k in range(0, len(data), 30_000)]
    whole = b"".join(map(block, parts)) + block(b"")
    assert b"".join(bam.inflate(whole)) == data
    with pytest.raises((ValueError, zlib.error)):
        list(bam.inflate(whole[:-5]))
    s, at = bam.Stream(iter(parts)), 0
    while at < len(data):
        n = rng.choice((1, 4, 100, 70_000))
        assert s.read(n) == data[at : at + n]
        at += n
    assert s.read(5) == b""


def test_sort_order():
    assert [bam.sort_order(x) for x in ("@HD\tVN:1\tSO:coordinate\n@SQ", "@HD\tSO:queryname", "@SQ\tSO:coordinate", "", "@HD\tSO:unknown")] == ["coordinate", "other", "unknown", "unknown", "unknown"]


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(5)
    nodes = list(range(400))
    rng.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(299)] + [(nodes[300], x) for x in nodes[301:350]] + [(7, 7), (None, 3)]
    want = {x: min(nodes[:300]) for x in nodes[:300]} | {x: min(nodes[300:350]) for x in nodes[300:350]}
    out = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in out.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mapped_reads_come_back(spark):
    rng = random.Random(6)
    ref = "".join(rng.choices("ACGT", k=400))
    rows = []
    for i in range(30):
        at = rng.randrange(300)
        s = list(ref[at : at + 100])
        for k in rng.sample(range(100), i % 5):
            s[k] = rng.choice("ACGT")
        s = "".join(s)
        rows.append((i, s if i % 2 else s[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    reads, refs = spark.createDataFrame(rows, "ord long, seq string"), spark.createDataFrame([(9, ref)], "ref long, seq string")
    hits = mapping.best_hits(reads, refs)
    back = mapping.undo_mismatches(mapping.mismatches(reads, hits, refs), refs)
    assert {tuple(r) for r in back.collect()} == set(rows)
