"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.dna import let, running
from strandwise.functions.kernels import ship  # noqa: F401
from strandwise.operators.graph import checkpoint, shared_folder  # noqa: F401

#: Words of the text contracts: runs of ASCII letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Most rows that `size_checked` lets into a broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_checked(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if its counted `rows` are within `limit`, else `df` for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def words(text: Column) -> Column:
    """The words of `text` in lower case; exact for comparisons with ASCII words.

    Two letters beyond ASCII have an ASCII letter as lower case (the Kelvin sign, the dotted capital I). They are
    replaced by another letter beyond ASCII first, so a word equals an ASCII word only if its letters A-Z do.
    """
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ñ"))
    text = F.replace(text, F.lit("İ"), F.lit("ñ"))
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """`df` with a column for each pattern: array<struct<s:int, e:int, m:string>> of its leftmost non-overlapping matches.

    Positions are code points, end exclusive; a null text has no matches. The text between matches (split) and the
    matches themselves (extract) alternate, so the starts are running sums of their lengths. Matches are a projection
    of their own, so each pattern scans a text once, and a second time only where it was found.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({f"_{k}_found": F.regexp_extract_all(body, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    empty = F.expr("cast(array() as array<struct<s:int, e:int, m:string>>)")

    def spans(k: str, p: str) -> Column:
        found = F.col(f"_{k}_found")
        # the last stretch of text has no match after it
        pairs = F.zip_with(found, F.slice(F.split(body, p, -1), 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), (F.length(g) + F.length(m)).alias("n")))

        def placed(pairs: Column) -> Column:
            return F.zip_with(pairs, running(F.transform(pairs, lambda x: x["n"])), lambda x, at: F.struct((at + x["g"]).alias("s"), (at + x["n"]).alias("e"), x["m"].alias("m")))

        return F.when(F.size(found) > 0, let(pairs, placed)).otherwise(empty)

    return df.withColumns({k: spans(k, p) for k, p in patterns.items()}).drop(*[f"_{k}_found" for k in patterns])
