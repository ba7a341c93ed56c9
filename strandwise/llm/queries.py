"""Queries over the synthetic tables: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import bpe, chat, decontaminate, language_id, license_scan, line_dedup, pii, secrets, simhash, topk
from strandwise.llm.common import table
from strandwise.llm.oracles import ORACLE_SQL


#: Parts of a page that hold no text of its own.
MARKUP = r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[A-Za-z]+;"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page of `pages`; models are fitted on a bounded sample of `documents`."""
    pages = table(spark, sf_dir, "pages")
    model = language_id.fit(table(spark, sf_dir, "documents"))
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    out = language_id.identify(pages, model, F.regexp_replace("html", MARKUP, " "), declared, language_id.hosts_of(F.col("url")))
    return out.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", language_id.accepted(F.col("language"), F.col("posterior")).alias("accepted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole text of `documents`."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of `embeddings` by integer inner product, for every vec_id divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of `benchmark` in every whole text of `documents`."""
    out = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without the later occurrences of windows of three lines."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` as ids of the public 50k byte-level vocabulary, and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 of two turns with control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    made = chat.format_chats(rows)
    back = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`, by fixed rules and by bootstrapped contexts."""
    out = pii.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("found")).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`, by fixed rules and by the trained Markov models."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scan(docs, secrets.train(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_topk": op3_topk,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe": op6_bpe,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_pii": op8_pii,
    "op9_secret_scan": op9_secret_scan,
    "op10_simhash": op10_simhash,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
