"""Personal data: fixed rules, and identifiers found by bootstrapped contexts.

The rules' matches are seeds. A token that holds a digit or an @ is an instance; the word before it and the word after it are
its lexical patterns. Patterns and instances form a graph whose edges are counted by a grouped aggregation. ROUNDS
times, a pattern's confidence is the mean score of its distinct instances (with PRIOR unknown ones added) and an
instance's score is the noisy-or of its patterns' confidences; seeds keep score 1. A pattern with LEAST_SEEDS distinct
seeds and confidence of at least CONFIDENT then discovers the tokens beside it that no rule knows.

Texts are read once, into a narrow row per text with its spans and tokens. Edges are distinct before they meet, so a
copy, a frequent word or a frequent identifier adds no work in the rounds. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import checkpoint, size_checked, with_spans

#: Fixed rules of the contract. Where a run can match only from its start, it is tried there alone (or where the
#: match before it ended), so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}$"
KINDS = ("email", "ip", "card", "phone", "id")

#: Tokens without white space that hold a digit or an @.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

ROUNDS, PRIOR, LEAST_SEEDS, CONFIDENT, LEAST_DIGITS = 3, 2.0, 5, 0.8, 4


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(number)

    def value(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), lambda i: value(i)), F.lit(0), lambda a, b: a + b) % 10 == 0


def of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `base`: array<struct<kind, s, e>> by kind as listed, then start."""
    out = with_spans(docs, text, {"_email": EMAIL, "_ip": IP, "_card": CARD, "_phone": PHONE})
    ip = F.filter("_ip", lambda x: x["m"].rlike(OCTETS))
    card = F.filter("_card", lambda x: F.when(F.length(digits(x["m"])).between(13, 19), luhn(digits(x["m"]))).otherwise(False))
    phone = F.filter("_phone", lambda x: F.length(digits(x["m"])).between(9, 15))
    return out.withColumn("base", F.concat(of_kind(F.col("_email"), 0), of_kind(ip, 1), of_kind(card, 2), of_kind(phone, 3))).drop("_email", "_ip", "_card", "_phone")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def tokens(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with `tokens`: array<struct<s, e, name, before, after, seed>> of the tokens that hold a digit or an @.

    s and e leave out the signs at both ends of the token; `seed` is whether a span of the rules overlaps it. before
    and after are lower-case words, or null beside another such token or the border of the text.
    """
    out = with_spans(docs, text, {"_tokens": TOKEN})
    body = F.coalesce(F.col(text), F.lit(""))

    def at(x: Column, i: Column) -> Column:
        lead = F.length(F.regexp_extract(x["m"], r"^[^\p{L}\p{N}]*", 0))
        name = F.regexp_replace(x["m"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        start = x["s"] + lead
        end = start + F.length(name)
        last = F.when(i > 0, F.get(F.col("_tokens"), i - 1)["e"]).otherwise(F.lit(0))
        gap = F.substr(body, last + 1, x["s"] - last)
        next_s = F.get(F.col("_tokens"), i + 1)["s"]
        follow = F.substr(body, x["e"] + 1, F.coalesce(next_s, F.length(body)) - x["e"])
        # the words beside the token, without signs
        before = F.lower(F.regexp_replace(F.substring_index(F.rtrim(F.translate(gap, "\n\t\r", "   ")), " ", -1), r"[^\p{L}]+", ""))
        after = F.lower(F.regexp_replace(F.substring_index(F.ltrim(F.translate(follow, "\n\t\r", "   ")), " ", 1), r"[^\p{L}]+", ""))
        seed = F.exists(F.col("base"), lambda b: (b["s"] < end) & (b["e"] > start))
        return F.struct(start.alias("s"), end.alias("e"), name.alias("name"), F.when(before != "", before).alias("before"), F.when(after != "", after).alias("after"), seed.alias("seed"))

    return out.withColumn("tokens", F.transform("_tokens", at)).drop("_tokens")


def patterns(read: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of the confident patterns of `read` (with `tokens`). Patterns: `<word` before, `>word` after."""
    seen = read.select(F.explode("tokens").alias("t")).select(F.col("t.name").alias("instance"), F.col("t.seed").alias("seed"), F.explode(beside(F.col("t"))).alias("pattern"))
    edges = checkpoint(seen.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    scores = seeds.select("instance", F.col("seed").cast("double").alias("score"), "seed")
    confident = None
    for k in range(rounds):
        met = edges.select("pattern", "instance").join(scores, "instance")
        confident = met.groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence"), F.count(F.when(F.col("seed"), 1)).alias("n_seeds"))
        if k + 1 < rounds:
            doubt = edges.select("pattern", "instance").join(confident, "pattern").groupBy("instance").agg(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))).alias("doubt"))
            scores = seeds.join(doubt, "instance").select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("score"), "seed")
    return confident.where((F.col("n_seeds") >= LEAST_SEEDS) & (F.col("confidence") >= CONFIDENT)).select("pattern", "confidence")


def beside(t: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("<"), t["before"]), F.concat(F.lit(">"), t["after"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, base and found, arrays of struct<kind, s, e> by kind as listed, then start.

    found holds the rules' spans and those that patterns discover (kind `id`: tokens with LEAST_DIGITS digits or more,
    or an @ within, and no overlap with a rule's span; words of letters alone are never found). Positions are code points, end exclusive. Null and empty texts have no spans. Repeated
    rows and null ids each keep a row. An empty table gives no rows.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).alias("t"))
    read = checkpoint(tokens(with_base(source, "t"), "t").drop("t"))
    known = checkpoint(patterns(read))
    open_ = read.select("row", F.explode(F.filter("tokens", lambda t: ~t["seed"] & ((F.length(digits(t["name"])) >= LEAST_DIGITS) | F.contains(t["name"], F.lit("@"))))).alias("t"))
    asked = open_.select("row", "t.s", "t.e", F.explode(beside(F.col("t"))).alias("pattern"))
    hits = asked.join(size_checked(known, known.count()), "pattern").groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.lit(4).alias("kind"), "s", "e"))).alias("more"))
    return read.join(hits, "row", "left").select(F.col("id").alias(id_col), "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("found"))
