"""Operators between the reads of a chunk, position by position: deltas and the way back, medians, consensus, shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import dna, quality
from strandwise.operators import stats, streams

#: Codes of written-out bases, from 1; 0 stands for a base equal to the one above.
LETTERS = "ACGTN"
#: What a missing quality of the read before counts as: a fixed value of the operator.
MISSING = 30


def quality_deltas(reads: DataFrame, by: str = "chunk") -> DataFrame:
    """(ord, chunk, deltas): each quality less that of the read before at its position, clamped to a signed byte.

    The first read of a chunk is taken as it is; MISSING stands for positions that the read before doesn't have.
    """
    own = reads.select("ord", by, quality.values(F.col("qual")).alias("v"), F.lag("qual").over(Window.partitionBy(by).orderBy("ord")).alias("p"))
    before = quality.values(F.col("p"))
    d = dna.let(F.struct("v", before.alias("b"), F.col("p").isNull().alias("first")), lambda x: F.transform(x["v"], lambda q, i: quality.clamp8(q - F.when(x["first"], 0).otherwise(F.coalesce(F.get(x["b"], i), F.lit(MISSING))))))
    return own.select("ord", by, d.alias("deltas"))


def undo_quality_deltas(deltas: DataFrame, by: str = "chunk") -> DataFrame:
    """(ord, qual): running sums by position, begun anew where the read before was shorter. Exact where no delta was clamped."""
    return streams.qualities(deltas, by, MISSING)


def frequent_length(reads: DataFrame) -> DataFrame:
    """One row (n): the most frequent length of a read, the shorter of equals."""
    by = reads.groupBy(F.length("seq").alias("n")).agg(F.count("*").alias("c"))
    return by.agg(F.max(F.struct("c", (-F.col("n")).alias("minus"))).alias("x")).select((-F.col("x.minus")).alias("n"))


def median_model(reads: DataFrame) -> DataFrame:
    """(pos, median, total): upper median of the qualities at each position of the reads of the most frequent length."""
    own = reads.join(F.broadcast(frequent_length(reads)), F.length("seq") == F.col("n"), "left_semi")  # one row
    long = own.select(F.posexplode(quality.values(F.col("qual"))).alias("pos", "q"))
    return stats.upper_median(long, ["pos"], "q")


def deviations(reads: DataFrame, model: DataFrame) -> DataFrame:
    """(ord, deviations): qualities less the median of their position, the last one beyond the model, clamped.

    The model has a row for each position of a read, so it is one row of an array, which is broadcast.
    """
    medians = model.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "median"))), lambda x: x["median"]).alias("m"))
    both = reads.select("ord", quality.values(F.col("qual")).alias("v")).join(F.broadcast(medians))
    return both.select("ord", F.transform("v", lambda q, i: quality.clamp8(q - F.get(F.col("m"), F.least(i, F.size("m") - 1)))).alias("deviations"))


def read_deltas(reads: DataFrame, by: str = "chunk") -> DataFrame:
    """(ord, chunk, codes): 0 where a base equals that of the read before at its position, else its place in LETTERS."""
    own = reads.select("ord", by, "seq", F.coalesce(F.lag("seq").over(Window.partitionBy(by).orderBy("ord")), F.lit("")).alias("p"))
    letter = lambda c, i: F.substr(c, i, F.lit(1))
    codes = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.when(letter(F.col("seq"), i) == letter(F.col("p"), i), 0).otherwise(F.call_function("instr", F.lit(LETTERS), letter(F.col("seq"), i))))
    return own.select("ord", by, F.when(F.length("seq") > 0, codes).otherwise(F.expr("cast(array() as array<int>)")).alias("codes"))


def undo_read_deltas(deltas: DataFrame, by: str = "chunk") -> DataFrame:
    """(ord, seq): at each position the last code above that is not 0."""
    return streams.sequences(deltas, by, LETTERS)


def consensus(long: DataFrame, *by: str) -> DataFrame:
    """(*by, base, n): the most frequent base of each group of a long form; ties go to the later of LETTERS."""
    counted = long.groupBy(*by, "base").agg(F.count("*").alias("n"))
    best = counted.groupBy(*by).agg(F.max(F.struct("n", F.call_function("instr", F.lit(LETTERS), F.col("base")).alias("at"), "base")).alias("x"))
    return best.select(*by, "x.base", "x.n")


def best_shifts(reads: DataFrame, k: int, by: str = "chunk") -> DataFrame:
    """(ord, chunk, shift, n): the shift against the chunk's first read that most k-mers vote for, where each k-mer of
    that read stands first. Ties go to the least distance, then the least shift. Reads without a common k-mer have none."""
    return streams.shifts(reads, k, by)


def adaptive_models(df: DataFrame, symbol: str, contexts: dict[str, list[str]], alphabet: int) -> DataFrame:
    """(model, n, bits) of `stats.adaptive_bits` under several contexts, rolled up from one count n of all their columns."""
    joint = df.withColumnRenamed("n", "_n")
    out = None
    for name, own in contexts.items():
        counts = joint.groupBy(*own, symbol).agg(F.sum("_n").alias("_n"))
        one = stats.adaptive_bits_of(counts, own, alphabet).select(F.lit(name).alias("model"), "n", F.round("bits", 2).alias("bits"))
        out = one if out is None else out.unionByName(one)
    return out

