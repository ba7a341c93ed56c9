"""Counts, entropies and code lengths. Every statistic is a grouped count, so map-side aggregation does most work."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators import streams


def entropy(df: DataFrame, symbol: str, context: list[str] | None = None) -> DataFrame:
    """(h, n, n_contexts): bits of `symbol` given `context` columns, from one count for each (context, symbol).

    H(Y|X) = (sum of n(x) log2 n(x) - sum of n(x,y) log2 n(x,y)) / N. Rows with null symbols or contexts are left out.
    """
    context = context or []
    joint = df.dropna(subset=[*context, symbol]).groupBy(*context, symbol).agg(F.count("*").alias("n"))
    by = joint.groupBy(*context).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("own"))
    return by.agg(((F.sum(F.col("n") * F.log2("n")) - F.sum("own")) / F.sum("n")).alias("h"), F.sum("n").alias("n"), F.count("*").alias("n_contexts"))


def entropies_of(joint: DataFrame, contexts: dict[str, list[str]]) -> DataFrame:
    """(model, h, n, n_contexts) of several contexts, as `entropy` does one, from the counts of `kernels.context_counts`.

    A row counts in a model if that model's columns are not null.
    """
    whole = F.lit(False)
    for name, own in contexts.items():
        full = F.col("model") == name
        for c in own:
            full = full & F.col(c).isNotNull()
        whole = whole | full
    # a symbol may be a context of another model, so the columns of a model are named in one key
    key = None
    for name, own in contexts.items():
        text = F.concat_ws(" ", F.lit(""), *[F.col(c).cast("string") for c in own])
        key = F.when(F.col("model") == name, text) if key is None else key.when(F.col("model") == name, text)
    by = joint.where(whole).groupBy("model", key.alias("key")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("own"))
    return by.groupBy("model").agg(((F.sum(F.col("n") * F.log2("n")) - F.sum("own")) / F.sum("n")).alias("h"), F.sum("n").alias("n"), F.count("*").alias("n_contexts"))


def log2_factorial(n: Column) -> Column:
    """log2(n!) by Stirling's series about n + 9, less the factors in between; exact to 1e-11."""
    x = n.cast("double") + 9
    series = (x + 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    product = F.lit(0.0)
    for k in range(1, 10):
        product = product + F.log(n.cast("double") + k)
    return (series - product) / F.lit(0.6931471805599453)


def adaptive_bits(df: DataFrame, symbol: str, context: list[str], alphabet: int) -> DataFrame:
    """(n, bits): total code length of an adaptive model with counts from 1, whatever the order of the rows.

    Per context: log2((N + K - 1)! / (K - 1)!) - sum of log2(n_i!).
    """
    return adaptive_bits_of(df.groupBy(*context, symbol).agg(F.count("*").alias("_n")), context, alphabet)


def adaptive_bits_of(counts: DataFrame, context: list[str], alphabet: int) -> DataFrame:
    """`adaptive_bits` of the counts `_n` of each context and symbol."""
    by = counts.groupBy(*context).agg(F.sum("_n").alias("n"), F.sum(log2_factorial(F.col("_n"))).alias("own"))
    start = log2_factorial(F.lit(alphabet - 1))
    return by.agg(F.sum("n").alias("n"), F.sum(log2_factorial(F.col("n") + (alphabet - 1)) - start - F.col("own")).alias("bits"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The element at n div 2 of each group's sorted values, from counts of equal values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    listed = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col("n")))).alias("_listed"), F.sum("n").alias("_total"))
    at = F.floor(F.col("_total") / 2)
    found = F.aggregate(
        "_listed",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(df.schema[value].dataType).alias("v")),
        lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["seen"] <= at) & (a["seen"] + x["n"] > at), x["v"]).otherwise(a["v"]).alias("v")),
    )["v"]
    return listed.select(*by, found.alias("median"), F.col("_total").alias("total"))


def rescaled_bits(df: DataFrame, by: str, order: str, symbols: str, alphabet: str, limit: int) -> DataFrame:
    """(`by`, n, bits): code length of the characters of `symbols` in order of `order`, under an adaptive model for each
    `by` whose counts begin at 1 and are halved (rounded up) when their sum passes `limit`.

    The counts depend on all symbols before, so each `by` is one task's work in order; it holds only the counts.
    """

    at, size = {ord(c): i for i, c in enumerate(alphabet)}, len(alphabet)
    code = np.full(max(at) + 2, -1)
    code[list(at)] = list(at.values())

    def rising(n: np.ndarray, more: np.ndarray) -> float:
        """log of n (n + 1) ... (n + more - 1), summed."""
        return sum(math.lgamma(a + m) - math.lgamma(a) for a, m in zip(n.tolist(), more.tolist(), strict=True) if m)

    def rows(stream):
        key = None
        for first, k, text in stream:
            if first:
                if key is not None:
                    yield key[0], total_n, bits / math.log(2)
                key, counts, total, total_n, bits = (k,), np.ones(size, np.int64), size, 0, 0.0
            own = code[np.minimum(streams.points(text or ""), len(code) - 1)]
            if (own < 0).any():
                raise ValueError(f"symbols outside the alphabet: {text[:200]}")
            total_n += len(own)
            while len(own):
                # up to the symbol whose count makes the sum pass the limit, the code length needs only the counts
                part, own = own[: max(limit - total + 1, 1)], own[max(limit - total + 1, 1) :]
                more = np.bincount(part, minlength=size)
                bits += math.lgamma(total + len(part)) - math.lgamma(total) - rising(counts, more)
                counts, total = counts + more, total + len(part)
                if total > limit:
                    counts = (counts + 1) // 2
                    total = int(counts.sum())
        if key is not None:
            yield key[0], total_n, bits / math.log(2)

    schema = f"{by} {df.schema[by].dataType.simpleString()}, n long, bits double"
    return streams.streamed(df, by, [order], [symbols], schema, lambda s: streams.given(rows(s)))
