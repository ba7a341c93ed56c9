"""BAM files: header, references and records from block-gzip files, each file parsed by one task as a stream."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

NIBBLES = "=ACMGRSVTWYHKDBN"
SCHEMA = (
    "file string, ord long, ref_id int, pos int, mapq int, bin int, flag int, next_ref_id int, next_pos int, tlen int, "
    "name string, cigar array<struct<op:int,len:int>>, seq string, qual array<int>, aux binary"
)


def inflate(data: bytes) -> Iterator[bytes]:
    """The members of a (block-)gzip file; other data as they are.

    A block says its size in its header, so blocks are cut without a copy of what follows; members of other gzip files
    are fed piece by piece.
    """
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    whole, at = memoryview(data), 0
    while at < len(whole):
        # fixed values of the format: extra field of 6 bytes, named BC, that holds the block's size less one
        if len(whole) >= at + 18 and whole[at + 3] & 4 and whole[at + 10 : at + 16] == b"\x06\x00BC\x02\x00":
            end = at + 1 + int.from_bytes(whole[at + 16 : at + 18], "little")
            if end > len(whole):
                raise ValueError("the file is cut off within a gzip member")
            yield zlib.decompress(whole[at:end], 31)
            at = end
            continue
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = whole[at : at + (1 << 16)]
            if not len(piece):
                raise ValueError("the file is cut off within a gzip member")
            yield d.decompress(piece)
            at += len(piece) - len(d.unused_data)


class Stream:
    """Bytes of consecutive parts, of which only the present one is held."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.part, self.at = parts, b"", 0

    def read(self, n: int) -> bytes:
        got = self.part[self.at : self.at + n]
        self.at += len(got)
        if len(got) == n:
            return got
        more = [got]
        left = n - len(got)
        for self.part in self.parts:
            self.at = min(left, len(self.part))
            more.append(self.part[: self.at])
            left -= self.at
            if not left:
                break
        return b"".join(more)


def sort_order(header: str) -> str:
    """What the @HD line of a header text says of the order: coordinate, other, or unknown where it says nothing."""
    for line in header.split("\n"):
        if line.startswith("@HD"):
            for field in line.split("\t")[1:]:
                if field.startswith("SO:"):
                    return "coordinate" if field[3:] == "coordinate" else "unknown" if field[3:] in ("", "unknown") else "other"
    return "unknown"


def parse(data: bytes) -> Iterator[tuple]:
    """The records of a file as tuples of SCHEMA without the file. Bounds are checked; bad ones raise ValueError."""
    stream = Stream(inflate(data))

    def take(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError("the file is cut off")
        return got

    if take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    for _ in range(struct.unpack("<i", take(4))[0]):
        (n,) = struct.unpack("<i", take(4))
        if not 0 < n <= 256:
            raise ValueError("bad length of a reference name")
        take(n + 4)
    ord_ = 0
    while size := stream.read(4):
        if len(size) < 4:
            raise ValueError("the file is cut off")
        (n,) = struct.unpack("<i", size)
        if n < 32:
            raise ValueError(f"record {ord_}: its size is {n}")
        b = take(n)
        ref, pos, l_name, mapq, bin_, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
        at_cigar = 32 + l_name
        at_seq = at_cigar + 4 * n_cigar
        at_qual = at_seq + (l_seq + 1) // 2
        at_aux = at_qual + l_seq
        if l_seq < 0 or l_name < 1 or at_aux > n:
            raise ValueError(f"record {ord_}: its fields go beyond its end")
        cigar = [(v & 15, v >> 4) for v in struct.unpack_from(f"<{n_cigar}I", b, at_cigar)]
        seq = "".join(NIBBLES[v >> 4] + NIBBLES[v & 15] for v in b[at_seq:at_qual])[:l_seq]
        name = b[32 : at_cigar - 1].decode("ascii", "replace")
        yield ord_, ref, pos, mapq, bin_, flag, next_ref, next_pos, tlen, name, cigar, seq, list(b[at_qual:at_aux]), b[at_aux:]
        ord_ += 1


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM files by file and ord. The container can't be split, so a file is the work of one task."""

    def run(frames):
        import pandas as pd

        names = [x.strip().split(" ")[0] for x in SCHEMA.replace("struct<op:int,len:int>", "s").split(", ")]
        for frame in frames:
            for file, data in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for r in parse(data):
                    rows.append((file, *r[:10], [{"op": o, "len": n} for o, n in r[10]], *r[11:]))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)
