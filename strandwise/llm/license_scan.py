"""License scans by diagonal voting.

Every rolling k-gram of words of a text joins the positions of the same k-gram in the templates. A match of k-grams
votes for a diagonal (text position minus template position). A diagonal with a vote for every k-gram of its template
is an exact place of it. Neighbouring diagonals (within SLACK words: words added or left out) are merged, and a merged
span is verified: the template words that its k-grams cover must be COVER or more of the template, and the span no
longer than LONGEST times the template.

Templates are a fixed list (under 100 k-grams), so their table is broadcast. k-grams meet by hash and are then compared
as strings, so votes are exact. One pass over the texts; what leaves it is one row per text and one per vote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.llm.common import words

#: Fixed values of the contract: phrases whose exact places count, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices that are also found with some words changed. Those that differ in one word are short, so that it decides.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
}

K, SLACK, COVER, LONGEST = 3, 3, 0.8, 1.25


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """(template, label, base, length, tpos, gram) of all k-grams of all templates."""
    rows = []
    for n, (phrase, label) in enumerate([*BASE.items(), *NOTICES.items()]):
        w = phrase.split()
        rows += [(n, label, n < len(BASE), len(w), i, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, length int, tpos int, gram string")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (label, first, last, coverage, base) of all verified spans, in words. Null and empty texts have no
    words; a text of fewer than k words has no k-gram. Repeated rows and null ids each keep a row. score is the
    largest coverage, 0 without a span. An empty table gives no rows.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, k).withColumn("gram_hash", F.xxhash64("gram"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text)).alias("w"))
    # position 0 has a row in any case, as it carries the text's row on
    rolled = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - k)), lambda i: F.array_join(F.slice(F.col("w"), i + 1, k), " "))
    rolling = texts.select("row", "id", F.size("w").alias("n_words"), F.posexplode(rolled).alias("pos", "own")).withColumn("own_hash", F.xxhash64("own"))
    met = rolling.join(F.broadcast(grams), (F.col("own_hash") == F.col("gram_hash")) & (F.col("own") == F.col("gram")), "left").where("template is not null or pos = 0")
    votes = met.select("row", "id", "n_words", "template", "label", "base", "length", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).repartition("row")
    one = ["row", "id", "n_words", "template", "label", "base", "length"]
    diagonals = votes.groupBy(*one, "diagonal").agg(F.collect_set("tpos").alias("hits"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    exact = F.col("template").isNotNull() & (F.size("hits") == F.col("length") - k + 1)
    # a base phrase counts where it stands exactly; the diagonals of a notice merge with their neighbours
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by) > SLACK), F.lit(True))
    merged = diagonals.withColumn("exact", exact).withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(by))
    cluster = merged.groupBy(*one, "group").agg(
        F.max("exact").alias("exact"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.min(F.col("diagonal") + F.array_min("hits")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("hits") + k - 1).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda t: F.sequence(t, t + k - 1))))) / F.col("length")
    spans = cluster.withColumn("coverage", F.when(F.col("template").isNotNull(), covered)).withColumn(
        "ok",
        F.coalesce(F.when(F.col("base"), F.col("exact")).otherwise((F.col("coverage") >= COVER) & (F.col("last") - F.col("first") + 1 <= LONGEST * F.col("length"))), F.lit(False)),
    )
    is_base = F.col("ok") & F.col("base")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans.groupBy("row", "id", "n_words").agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        listed(F.when(is_base, F.col("label"))).alias("base_labels"),
        listed(F.when(F.col("ok"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("first", "last", "label", "coverage", "base")))).alias("spans"),
    ).select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
