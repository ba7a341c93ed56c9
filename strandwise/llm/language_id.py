"""Language identification by Bayesian evidence fusion.

Evidence of a row: its text under byte-trigram models of the languages, the language that its markup declares, the
suffix of its address, and its host. The posterior of language l is proportional to

    P(text | l)^T * P(declared | l) * P(l | suffix) / P(l) * P(l | host)

* P(text | l): mean log-likelihood of the hashed trigrams; T = n / (1 + n / SPREAD) grows with the n trigrams but
  levels off, as neighbouring trigrams aren't independent. `und` (no known language) has equal odds for all trigrams.
* P(declared | l): smoothed counts of declared languages by the language that the text alone suggests.
* P(l | host), P(l | suffix): counts of the languages that texts alone suggest, summed by host, then by domain, then
  over all; each level is smoothed towards the one above with the weight of STRENGTH rows. A row's own vote is left
  out of its host's counts.

All counts come from one grouped aggregation over every row. The tables by host and suffix are broadcast only up to a
counted size. The trigram models are fitted on a bounded sample of labelled rows (TRAIN_ROWS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import checkpoint, ship, size_checked

#: Rows of the labelled sample, trigram buckets, smoothing, levelling of text evidence, and weights of priors.
TRAIN_ROWS, BUCKETS, ALPHA, SPREAD, STRENGTH = 8000, 1 << 15, 0.5, 100.0, 5.0
#: Rows of a label that the sample has at least (all, if fewer); the most languages of a model (the most frequent labels);
#: und's prior; bytes that are scored at once.
LEAST_SAMPLE, MOST_LANGUAGES, UND_PRIOR, CHUNK = 200, 256, 0.01, 1 << 20
#: A row is rejected below this posterior.
LEAST_POSTERIOR = 0.5

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of lower-case UTF-8, and which of them count (their middle is of a word)."""
    b = _FOLD[data]
    key = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1), b[1:-1] != 32


def padded(text: Column) -> Column:
    """Lower case, with a space at both ends, so that a word of one letter has a trigram."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def spans_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each string of an Arrow array, without copies; nulls are empty."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield data[a:b]


@dataclass
class TextModel:
    """Languages, and log-likelihoods of trigram buckets: (BUCKETS, languages + 1), und last."""

    languages: list[str]
    table: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """(rows, 1 + languages + 1): the number of trigrams, and mean log-likelihoods."""
        width = self.table.shape[1]
        out = np.zeros((len(column), 1 + width))
        for i, data in enumerate(spans_of(column)):
            for at in range(0, max(0, len(data) - 2), CHUNK):  # long texts in parts that overlap by two bytes
                buckets, counts = trigrams(data[at : at + CHUNK + 2])
                own = buckets[counts]
                out[i, 0] += len(own)
                out[i, 1:] += self.table[own].sum(axis=0, dtype=np.float64)
        out[:, 1:] /= np.maximum(out[:, :1], 1)
        return out


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> TextModel:
    """Trigram models of the labels, from about `train_rows` labelled rows (all, if fewer) chosen by a hash of the id.

    Rows are sampled label by label, so that a rare label has LEAST_SAMPLE rows too: at most `train_rows` and
    LEAST_SAMPLE for each of MOST_LANGUAGES labels. Whole texts are counted on the executors; what comes to the driver is
    a count for each label and bucket. Rows without a label or a text take no part; without labelled rows there is no
    language, and every row is `und`.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.lower(label).alias("label"), F.col(text).alias("t"), F.col(id_col).alias("id"))
    by_label = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LANGUAGES).collect()
    names, total = sorted(r["label"] for r in by_label), sum(r["n"] for r in by_label)
    shares = {r["label"]: min(1.0, max(train_rows * r["n"] / total, LEAST_SAMPLE) / r["n"]) for r in by_label}
    parts = [F.lit(x) for name, share in shares.items() for x in (name, int(share * 1_000_000 + 1))]
    most = F.create_map(*parts)[F.col("label")] if parts else F.lit(0)
    sample = rows.where(F.col("label").isin(names) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < most)).select("label", padded(F.col("t")).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), spans_of(batch.column(1)), strict=True):
                own = seen.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for at in range(0, max(0, len(data) - 2), CHUNK):
                    buckets, counts = trigrams(data[at : at + CHUNK + 2])
                    own += np.bincount(buckets[counts], minlength=BUCKETS)
        for name, own in seen.items():
            there = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(own[there], pa.int64())], names=["label", "bucket", "n"])

    counted = sample.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(names) + 1), ALPHA)
    own = counted.toArrow().to_pydict()
    for name, bucket, n in zip(own["label"], own["bucket"], own["n"], strict=True):
        table[bucket, names.index(name)] += n
    table[:, -1] = 1.0
    return TextModel(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def hosts_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, host: Column) -> DataFrame:
    """`rows` with language, posterior and text_language (what the text alone suggests).

    `declared` is cut at its first - or _; a declared language without a model is evidence as `other`. Null or empty
    declared languages and hosts are no evidence. A null text, an empty one, and one without letters is `und` with
    posterior 1. Ties go to the first language by name. Rows are independent given the counts: repeated rows get equal
    results and all columns stay, null ids too. An empty table gives no rows.
    """
    ship(rows.sparkSession)
    names = [*model.languages, "und"]
    size = len(names)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def scored(column: pa.Array) -> pa.Array:
        values = shared.value.score(column)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))

    said = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    own = F.when(host != "", host)
    parts = F.split(own, r"\.")
    rows = rows.select(
        F.struct(*rows.columns).alias("_row"),
        scored(padded(text)).alias("_s"),
        F.when(said.isin(names), said).when(said != "", "other").alias("_said"),
        own.alias("_host"),
        F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), ".").alias("_domain"),
        F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("_suffix"),
    )
    n = F.get(F.col("_s"), F.lit(0))
    power = n / (1 + n / SPREAD)
    lik = F.transform(F.slice("_s", 2, size), lambda x: x * power)
    best = F.when(n == 0, F.lit(size - 1)).otherwise(F.array_position(lik, F.array_max(lik)).cast("int") - 1)
    rows = rows.withColumns({"_n": n, "_lik": lik}).withColumn("_best", best).drop("_s")

    votes = F.array(*[F.sum(F.when(F.col("_best") == i, 1).otherwise(0)).cast("double") for i in range(size)])
    by = checkpoint(rows.groupBy("_host", "_domain", "_suffix", "_said").agg(votes.alias("votes")))
    summed = lambda df, *keys: df.groupBy(*keys).agg(F.array(*[F.sum(F.get("votes", F.lit(i))) for i in range(size)]).alias("votes"))
    total = summed(by).collect()[0]["votes"] if not by.isEmpty() else [0.0] * size
    total = [x or 0.0 for x in total]
    known = [x + STRENGTH for x in total[:-1]]
    globe = [x / sum(known) * (1 - UND_PRIOR) for x in known] + [UND_PRIOR]
    told = {r["_said"]: r["votes"] for r in summed(by.where("_said is not null"), "_said").collect()}  # languages, und, other
    columns = sorted({*names, "other"})
    of_lang = [sum(v[i] for v in told.values()) for i in range(size)]
    log_said = {d: [log((told.get(d, [0.0] * size)[i] + ALPHA) / (of_lang[i] + ALPHA * len(columns))) for i in range(size)] for d in columns}

    def smoothed(votes: Column, above: Column) -> Column:
        whole = F.aggregate(votes, F.lit(0.0), lambda a, b: a + b) + STRENGTH
        return F.zip_with(votes, above, lambda v, p: (v + STRENGTH * p) / whole)

    world = F.array(*[F.lit(x) for x in globe])
    by = by.withColumn("votes", F.transform("votes", lambda v, i: F.when(i < size - 1, v).otherwise(0.0)))  # und says nothing of a host
    domains = summed(by.where("_domain is not null"), "_domain").select(F.col("_domain").alias("d"), smoothed(F.col("votes"), world).alias("p_domain"))
    hosts = summed(by.where("_host is not null"), "_host", "_domain").withColumnsRenamed({"_host": "h", "_domain": "d"}).join(domains, "d").select("h", F.col("votes").alias("host_votes"), "p_domain")
    suffixes = summed(by.where("_suffix is not null"), "_suffix").select(F.col("_suffix").alias("x"), smoothed(F.col("votes"), world).alias("p_suffix"))
    hosts, suffixes = checkpoint(hosts), checkpoint(suffixes)
    rows = rows.join(size_checked(hosts, hosts.count()), rows["_host"] == hosts["h"], "left").join(size_checked(suffixes, suffixes.count()), rows["_suffix"] == suffixes["x"], "left")

    less_own = F.transform(F.col("host_votes"), lambda v, i: v - F.when((i == F.col("_best")) & (i < size - 1), 1.0).otherwise(0.0))
    prior = F.coalesce(smoothed(less_own, F.col("p_domain")), world)
    suffix = F.coalesce(F.zip_with(F.col("p_suffix"), world, lambda p, g: p / g), F.array(*[F.lit(1.0)] * size))
    evidence = F.array(*[F.lit(0.0)] * size)
    for d in columns:
        evidence = F.when(F.col("_said") == d, F.array(*[F.lit(x) for x in log_said[d]])).otherwise(evidence)
    joint = F.zip_with(F.zip_with(F.col("_lik"), evidence, lambda a, b: a + b), F.zip_with(prior, suffix, lambda p, x: F.log(p * x)), lambda a, b: a + b)
    rows = rows.withColumn("_joint", joint).withColumn("_top", F.array_max("_joint"))
    odds = F.aggregate("_joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    listed = F.array(*[F.lit(x) for x in names])
    return rows.select(
        "_row.*",
        F.when(F.col("_n") == 0, "und").otherwise(F.get(listed, F.array_position("_joint", F.col("_top")).cast("int") - 1)).alias("language"),
        F.when(F.col("_n") == 0, 1.0).otherwise(1 / odds).alias("posterior"),
        F.get(listed, F.col("_best")).alias("text_language"),
    )


def accepted(language: Column, posterior: Column) -> Column:
    return (language != "und") & (posterior >= LEAST_POSTERIOR)
