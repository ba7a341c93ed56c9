"""Files: FASTQ, FASTA, gzip, archives, BAM bytes, and streamed chunks."""

import gzip
import random
import struct

import pytest

from strandwise.sources import archive, bam, fastq
from strandwise.streaming import ingest

_rng = random.Random(4)
READS = [(f"@name{i} of {i}", "".join(_rng.choices("ACGT", k=20)), "".join(chr(33 + _rng.randrange(41)) for _ in range(20))) for i in range(3)]


def text(reads):
    return "".join(f"{i}\n{s}\n+\n{q}\n" for i, s, q in reads)


def test_fastq_round_trip(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(text(READS * 50).replace("\n", "\r\n"))
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text(READS))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = sorted((r.ord, r.id, r.seq, r.qual) for r in fastq.records(spark, f"{tmp_path}/a.fastq").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert out == [(i, *r) for i, r in enumerate(READS * 50)]
    df = fastq.records(spark, f"{tmp_path}/b.fastq.gz")
    fastq.write(df, f"{tmp_path}/out", "gzip")
    back = fastq.records(spark, f"{tmp_path}/out")
    assert sorted((r.id, r.seq, r.qual) for r in back.collect()) == sorted(READS)
    (tmp_path / "c.fa").write_text(">s1\nACGT\n>s2\nTGCA\n")
    assert sorted((r.id, r.seq, r.qual) for r in fastq.records(spark, f"{tmp_path}/c.fa", fasta=True).collect()) == [(">s1", "ACGT", None), (">s2", "TGCA", None)]


@pytest.mark.parametrize("bad", ["@r\nACGT\nBAD\nIIII\n", "@r\nACGT\n+\nIII\n", "@r\nACGT\n+\n"])
def test_bad_fastq_is_an_error(spark, tmp_path, bad):
    (tmp_path / "x.fastq").write_text(bad)
    with pytest.raises(Exception, match="bad record 0 @r"):
        fastq.records(spark, f"{tmp_path}/x.fastq").collect()


@pytest.mark.parametrize("mode", ["lossless", "illumina8"])
def test_archive(spark, tmp_path, mode):
    rows = [(i, f"@SIM:1:FCX:1:2106:{i}:1063 1:N:0:ATCACG", s, q) for i, (_, s, q) in enumerate(READS)]
    df = spark.createDataFrame(rows, "ord long, id string, seq string, qual string")
    archive.write(df, f"{tmp_path}/a", mode)
    back = sorted(archive.read(spark, f"{tmp_path}/a").collect())
    assert [tuple(r)[:3] for r in back] == [r[:3] for r in rows]
    assert archive.verify(spark, f"{tmp_path}/a").collect()[0].ok
    assert (mode == "lossless") == ([r.qual for r in back] == [r[3] for r in rows])


def record(name, flag, ref, pos, cigar, seq, qual, aux=b""):
    nibbles = [bam.NIBBLES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for o, n in cigar) + packed + bytes(qual) + aux
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"@HD\tVN:1.6\tSO:coordinate\n"
    data = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<i", 248956422)
    rows = [record("r0", 0, 0, 100, [(4, 5), (0, 10)], "A" * 15, [30] * 15, b"NMC\x03"), record("r1", 4, -1, -1, [], "TTTTN", [255] * 5)]
    whole = data + b"".join(rows)
    (tmp_path / "x.bam").write_bytes(gzip.compress(whole[:60]) + gzip.compress(whole[60:]) + gzip.compress(b""))
    out = sorted(bam.records(spark, f"{tmp_path}/x.bam").collect(), key=lambda r: r.ord)
    assert [(r.name, r.flag, r.pos, r.seq) for r in out] == [("r0", 0, 100, "A" * 15), ("r1", 4, -1, "TTTTN")]
    assert [tuple(c) for c in out[0].cigar] == [(4, 5), (0, 10)] and bytes(out[0].aux) == b"NMC\x03" and out[1].qual == [255] * 5
    with pytest.raises(ValueError):
        list(bam.parse(gzip.compress(whole)[:-20]))


def test_stream_of_chunks(spark, tmp_path):
    schema = "ord long, id string, seq string, qual string"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(READS)], schema)
    df.where("ord < 2").write.parquet(f"{tmp_path}/in/1")
    for k in range(2):
        if k:
            df.where("ord = 2").write.parquet(f"{tmp_path}/in/2")
        ingest.chunks(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.ord, r.chunk) for r in out) == [(0, 0), (1, 0), (2, 1)]
