"""Archives: a Parquet dataset with one column per stream, and a manifest of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import headers, quality

FORMAT = 1


def fingerprint(reads: DataFrame) -> DataFrame:
    """(n, crc): the number of records and the sum of their CRC32, whatever their order."""
    row = F.concat_ws("\n", F.col("ord").cast("string"), "id", "seq", F.coalesce("qual", F.lit("")))
    return reads.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.crc32(row.cast("binary"))), F.lit(0)).alias("crc"))


def write(reads: DataFrame, path: str, mode: str = "lossless", no_quality: bool = False) -> None:
    """Write reads (ord, id, seq, qual) in order of ord. Header fields are columns where every header has one layout.

    The manifest has the fingerprint of what reading gives back (after quantising).
    """
    kept = reads.withColumn("qual", F.lit(None).cast("string") if no_quality else quality.stored(F.col("qual"), mode))
    parsed = kept.withColumn("p", headers.parse(F.col("id")))
    # one small aggregate decides the layout: columns if every header comes back from its fields, else text
    columns = bool(parsed.agg(F.coalesce(F.every(F.coalesce(headers.rebuild(F.col("p")) == F.col("id"), F.lit(False))), F.lit(False)).alias("ok")).collect()[0].ok)
    body = parsed.select("ord", F.col("p").alias("header") if columns else F.col("id").alias("header"), "seq", "qual")
    body.repartitionByRange("ord").sortWithinPartitions("ord").write.option("compression", "zstd").parquet(f"{path}/records")
    manifest = fingerprint(kept).select(F.lit(FORMAT).alias("format"), F.lit("columns" if columns else "text").alias("headers"), F.lit(mode).alias("mode"), F.lit(no_quality).alias("no_quality"), "n", "crc")
    manifest.coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, seq, qual) of an archive."""
    (manifest,) = spark.read.parquet(f"{path}/manifest").collect()
    body = spark.read.parquet(f"{path}/records")
    return body.select("ord", (headers.rebuild(F.col("header")) if manifest.headers == "columns" else F.col("header")).alias("id"), "seq", "qual")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(n, crc, n_written, crc_written, ok): whether the records read back have the fingerprint of the manifest."""
    (manifest,) = spark.read.parquet(f"{path}/manifest").collect()
    return fingerprint(read(spark, path)).select("n", "crc", F.lit(manifest.n).alias("n_written"), F.lit(manifest.crc).alias("crc_written"), ((F.col("n") == manifest.n) & (F.col("crc") == manifest.crc)).alias("ok"))
