"""FASTQ and FASTA files: reading, checking and writing, plain or gzip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their place in the file, from 0.

    Splits are numbered within themselves and then shifted by the lines of the splits before them, so no file passes
    through one task; what comes together in one place is a count for each split. Compressed files (by extension) are
    one split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value")
    )
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return lines.join(shifts, ["file", "start"]).select("file", (F.col("id") - F.col("first") + F.col("shift")).alias("line"), "value")


def records(spark: SparkSession, path: str, fasta: bool = False) -> DataFrame:
    """(file, ord, id, seq, qual) of FASTQ (4 lines a record) or FASTA (2 lines, qual null).

    A record without its + line, with another number of qualities than bases, or cut off is an error that names it
    when the row is used. Empty files have no records.
    """
    per = 2 if fasta else 4
    lines = numbered_lines(spark, path)
    part = lambda k: F.max(F.when(F.col("line") % per == k, F.col("value")))
    fields = [part(0).alias("id"), part(1).alias("seq")] + ([] if fasta else [part(2).alias("plus"), part(3).alias("qual")])
    own = lines.groupBy("file", F.expr(f"line div {per}").alias("ord")).agg(F.count("*").alias("lines"), *fields)
    name = F.concat(F.lit("bad record "), F.col("ord").cast("string"), F.lit(" "), F.coalesce("id", F.lit("")), F.lit(": "))
    bad = F.when(F.col("lines") < per, "it is cut off")
    if not fasta:
        bad = bad.when(~F.startswith("plus", F.lit("+")), "its third line does not begin with +").when(F.length("seq") != F.length("qual"), "it has another number of qualities than bases")
    checked = own.withColumn("seq", F.when(bad.isNotNull(), F.raise_error(F.concat(name, bad))).otherwise(F.col("seq")))
    return checked.select("file", "ord", "id", "seq", *([F.lit(None).cast("string").alias("qual")] if fasta else ["qual"]))


def write(reads: DataFrame, path: str, compression: str | None = None) -> None:
    """One text file for each partition of reads in order of ord: id, seq, + and qual (empty for a null) on four lines."""
    ordered = reads.repartitionByRange("ord").sortWithinPartitions("ord")
    lines = ordered.select(F.concat_ws("\n", "id", "seq", F.lit("+"), F.coalesce("qual", F.lit(""))).alias("value"))
    writer = lines.write.mode("error")
    (writer.option("compression", compression) if compression else writer).text(path)
