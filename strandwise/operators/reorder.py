"""Orders of reads: sort keys, groups, blocks and what a permutation costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import dna, quality


def sort_keys() -> dict[str, Column]:
    """Keys by which reads may be ordered, as columns of reads (seq, qual)."""
    v = quality.values(F.col("qual"))
    n = F.length("qual")
    total = F.aggregate(v, F.lit(0), lambda a, x: a + x)
    squares = F.aggregate(v, F.lit(0), lambda a, x: a + x * x)
    return {
        "lexicographic": F.col("seq"),
        "canonical": dna.canonical(F.col("seq")),
        "mean_q": F.floor(total / n),
        "squares": squares,
        "least_q": F.array_min(v),
        "ends": F.concat(F.substr("qual", F.lit(1), F.lit(16)), F.right("qual", F.lit(16))),
    }


def ranked(reads: DataFrame, keys: list[Column], by: str = "chunk") -> DataFrame:
    """(ord, chunk, place): the place of each read in its chunk by `keys`, nulls last, then ord."""
    order = [k.asc_nulls_last() for k in keys]
    return reads.select("ord", by, F.row_number().over(Window.partitionBy(by).orderBy(*order, "ord")).alias("place"))


def grouped(reads: DataFrame, key: Column, by: str = "chunk") -> DataFrame:
    """(ord, chunk, first, place): reads of one key stand together where the first of them stood."""
    first = reads.withColumn("key", key).withColumn("first", F.min("ord").over(Window.partitionBy(by, "key")))
    return first.select("ord", by, "first", F.row_number().over(Window.partitionBy(by).orderBy("first", "ord")).alias("place"))


def permutation_cost(order: DataFrame, by: str = "chunk") -> DataFrame:
    """(chunk, n, n_fixed, delta_bytes): rows in place, and bytes of the varint zigzag deltas of original places."""
    w = Window.partitionBy(by)
    original = F.row_number().over(w.orderBy("ord"))
    placed = order.withColumn("original", original)
    step = F.col("original") - F.lag("original", 1, 0).over(w.orderBy("place"))
    return placed.withColumn("step", step).groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(F.col("original") == F.col("place"), 1)).alias("n_fixed"), F.sum(dna.varint_size(dna.zigzag(F.col("step")))).alias("delta_bytes"))


def blocks(reads: DataFrame, size: int, by: str = "chunk") -> DataFrame:
    """(chunk, block, first, n, place): blocks of `size` reads ordered by the sequence of their first read."""
    own = reads.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(by).orderBy("ord")) - 1) / size))
    heads = own.groupBy(by, "block").agg(F.min(F.struct("ord", "seq")).alias("head"), F.count("*").alias("n"))
    return heads.select(by, "block", F.col("head.ord").alias("first"), "n", F.row_number().over(Window.partitionBy(by).orderBy("head.seq", "block")).alias("place"))


def bucketed(keyed: DataFrame, more: list[Column], buckets: int = 256) -> DataFrame:
    """(ord, bucket, place): places in one order over all rows of `keyed` (ord, hash): bucket, hash, `more`, ord.

    The bucket is taken from the upper half of the hash; rows without one are in the last. Rows are ranked within their
    bucket, and the buckets' counts, a row each, give the rest of the place.
    """
    own = keyed.withColumn("bucket", F.when(F.col("hash").isNull(), buckets - 1).otherwise(F.shiftright("hash", 32) % buckets))
    order = [F.col("hash").asc_nulls_last(), *[k.asc_nulls_last() for k in more], F.col("ord")]
    ranked = own.select("ord", "bucket", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)).alias("r"))
    counts = own.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each bucket
    return ranked.join(F.broadcast(before), "bucket").select("ord", "bucket", (F.col("before") + F.col("r")).alias("place"))


def permutation(order: DataFrame, by: str = "chunk") -> DataFrame:
    """(ord, chunk, place, original): for each place of an order the place before it, both within the chunk."""
    return order.select("ord", by, "place", (F.row_number().over(Window.partitionBy(by).orderBy("ord")) - 1).alias("original"))


def restored(permuted: DataFrame, by: str = "chunk") -> DataFrame:
    """`permuted` in its original order; an error if the stored places of a chunk aren't 0, 1, 2 and so on."""
    w = Window.partitionBy(by).orderBy("original")
    at = F.row_number().over(w) - 1
    return permuted.withColumn("_at", at).withColumn("original", F.when(F.col("_at") == F.col("original"), F.col("original")).otherwise(F.raise_error(F.lit("the permutation is not complete")).cast("int"))).drop("_at")
