"""General codecs as Arrow functions over binary columns: block sorting (bz2), zlib and zstandard, and the way back.

They stand where an external entropy coder would; nulls stay null. A value that is no such stream is an error.
"""

from __future__ import annotations

import bz2
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = {
    "bz2": (lambda x: bz2.compress(x, 9), bz2.decompress),
    "zlib": (lambda x: zlib.compress(x, 9), zlib.decompress),
    "zstd": (lambda x: zstandard.ZstdCompressor(level=3).compress(x), lambda x: zstandard.ZstdDecompressor().decompress(x)),
}


def applied(value: Column, codec: str, way: int) -> Column:
    if codec not in CODECS:
        raise ValueError(f"no codec {codec}: {', '.join(CODECS)}")

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        of = CODECS[codec][way]
        return pa.array([None if x is None else of(x) for x in column.to_pylist()], pa.binary())

    return run(value.cast("binary"))


def compress(value: Column, codec: str) -> Column:
    return applied(value, codec, 0)


def decompress(value: Column, codec: str) -> Column:
    return applied(value, codec, 1)
