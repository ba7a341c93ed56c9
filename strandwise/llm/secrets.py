"""Secret scans: fixed rules, and character Markov models of random strings against ordinary identifiers.

Two first-order Markov models over the characters of tokens are trained by grouped counts: one from strings that the
fixed rules label as secrets (smoothed towards uniform random strings), one from ordinary words. A token that is long
enough and whose log-likelihood ratio passes the thresholds is reported beside the rules'
spans. Scoring is a fold over the token's characters with a table of |alphabet|^2 ratios, inside Spark expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import with_spans

#: Fixed rules of the contract, in the order of the kinds. Letters of keywords in either case.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters of tokens; index 0 stands for the border of the token.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"

#: Rows of the training sample (documents), smoothing, the least mean log2 ratio for each character, and the least log2
#: ratio of the whole token, which asks more of each character of a shorter one (tokens have 12 characters or more).
TRAIN_ROWS, SMOOTHING, THRESHOLD, EVIDENCE = 20_000, 0.5, 1.0, 24.0


def of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["m"].alias("m")))


def sorted_base(assign: str, access: str, hexes: str) -> Column:
    """array<struct<s, kind:int, e, m>> of the fixed rules' spans, sorted by start, then kind as listed."""
    kept = F.filter(F.col(assign), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 8)
    return F.sort_array(F.concat(of_kind(kept, 0), of_kind(F.col(access), 1), of_kind(F.col(hexes), 2)))


def with_base(docs: DataFrame, text: str) -> DataFrame:
    out = with_spans(docs, text, {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX})
    return out.withColumn("base", sorted_base("_assign", "_access", "_hex")).drop("_assign", "_access", "_hex")


def code(token: Column, at: Column) -> Column:
    """Place in ALPHABET, from 1, of the character at `at`."""
    return F.call_function("instr", F.lit(ALPHABET), F.substr(token, at, F.lit(1)))


def bigrams(token: Column) -> Column:
    """Pairs (previous, current) of a token's character codes as previous * size + current; the first has border 0."""
    size = len(ALPHABET) + 1
    return F.transform(
        F.sequence(F.lit(1), F.length(token)),
        lambda i: F.when(i == 1, F.lit(0)).otherwise(code(token, i - 1)) * size + code(token, i),
    )


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> list[float]:
    """Table of log2 ratios, random over ordinary, by pair of characters, from a bounded sample of documents.

    The sample is about `train_rows` documents (all, if fewer), chosen by a hash of id and text. Labelled random:
    values that the fixed rules find. Labelled ordinary: runs of 6 letters or more. Only the counts of at most
    2 * |alphabet|^2 pairs come to the driver.
    """
    n = docs.count()
    share = min(1.0, train_rows / max(n, 1))
    chosen = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000))
    sample = docs.where(chosen).select(F.col(text).alias("t"))
    secret = with_base(sample, "t").select(F.explode("base").alias("x")).select(F.lit(1).alias("label"), F.when(F.col("x.kind") == 0, F.regexp_extract("x.m", ASSIGN, 1)).otherwise(F.col("x.m")).alias("token"))
    plain = sample.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{6,}"), F.lit(0))).alias("token"))
    counts = secret.unionByName(plain).groupBy("label", "token").count().select("label", "count", F.explode(bigrams(F.col("token"))).alias("pair")).groupBy("label", "pair").agg(F.sum("count").alias("n")).collect()
    size = len(ALPHABET) + 1
    tables = [[0.0] * (size * size) for _ in range(2)]
    for r in counts:
        tables[r["label"]][r["pair"]] += r["n"]
    # each row of the random model is smoothed towards equal odds, of the ordinary one towards its characters' shares
    shares = [sum(tables[0][cur::size]) + SMOOTHING for cur in range(size)]
    shares = [x / sum(shares) for x in shares]
    ratio = [0.0] * (size * size)
    for prev in range(size):
        row = slice(prev * size, (prev + 1) * size)
        rand = [x + 1 for x in tables[1][row]]
        plain = [x + size * p for x, p in zip(tables[0][row], shares, strict=True)]
        for cur in range(size):
            ratio[prev * size + cur] = math.log2(rand[cur] / sum(rand)) - math.log2(plain[cur] / sum(plain))
    return ratio


def random_spans(tokens: Column, ratio: list[float], threshold: float = THRESHOLD, evidence: float = EVIDENCE) -> Column:
    """Of `tokens` (found by TOKEN) those that pass the ratio test, as `sorted_base` has spans. Tokens without a letter are numbers."""
    csv = ",".join(f"{x:.6f}" for x in ratio)
    lookup = F.split(F.lit(csv), ",").cast("array<double>")

    def total(token: Column) -> Column:
        return F.aggregate(bigrams(token), F.lit(0.0), lambda acc, p: acc + F.get(lookup, p))

    kept = F.filter(tokens, lambda x: F.when(x["m"].rlike("[A-Za-z]"), total(x["m"]) >= F.greatest(F.lit(evidence), threshold * F.length(x["m"]))).otherwise(False))
    return of_kind(kept, 3)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, ratio: list[float], text: str = "text") -> DataFrame:
    """`docs` with `base` and `secrets` (base and model spans, sorted): arrays of struct<s, kind, e, m>.

    Positions are code points, end exclusive. Null and empty texts have no spans. A model span has 12 characters or
    more, at least one of them a letter, and a log2 ratio of EVIDENCE in all and THRESHOLD for each character; one that overlaps a
    span of the rules is left out. Rows are independent: repeated rows, rows without an id and ties have equal results,
    and an empty table gives no rows. Columns of `docs` that are named base or secrets are replaced; others stay.
    """
    out = with_spans(with_base(docs, text), text, {"_tokens": TOKEN})
    apart = F.filter(random_spans(F.col("_tokens"), ratio), lambda x: ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    return out.withColumn("secrets", F.sort_array(F.concat(F.col("base"), apart))).drop("_tokens")
