"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text are hashed (two 64-bit hashes in different orders). Windows that occur more
than once in all texts are found by a grouped count that also keeps the first occurrence. The lines that any later
occurrence covers are removed; positions that overlapping windows cover are merged first.

The first occurrence is the least (id, text hash, position). A removed line has an equal line at an earlier place, and
following those places leads to one that is kept, so every line of a repeated window stays in the corpus once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def repeated_windows(docs: DataFrame, id_col: str, text: str, window: int = WINDOW) -> DataFrame:
    """(id, th, pos): the later occurrences of windows, by document (id and text hash) and first line from 0."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(F.col(text), "\n", -1).alias("x"))
    # a window of nothing but spaces is layout and no repeat
    spans = F.when(F.size("x") >= window, F.sequence(F.lit(0), F.size("x") - window))

    def hashed(i):
        part = [F.get(F.col("x"), i + k) for k in range(window)]
        blank = F.length(F.trim(F.concat(*part))) == 0
        return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit(window), *part[::-1]).alias("h2")))

    rows = lines.select("id", "th", F.explode(F.filter(F.transform(spans, hashed), lambda w: w.isNotNull())).alias("w")).select("id", "th", "w.*")
    at = F.struct("id", "th", "pos")
    first = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").select("h1", "h2", "first")
    return rows.join(first, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first"))).select("id", "th", "pos")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and n_lines, n_removed (long).

    Lines end at a newline; texts of fewer lines than a window, empty and null texts stay as they are. A text of which
    every line is removed becomes empty. Rows of equal id and text count as one document; rows of one id and different
    texts, or of null ids, are documents of their own. Other columns stay. An empty table gives no rows.
    """
    later = repeated_windows(docs, id_col, text, window).withColumn("pos", F.explode(F.sequence("pos", F.col("pos") + window - 1)))
    covered = later.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_gone"))
    own = docs.withColumn("_own_th", F.xxhash64(text))
    # the text's hash is an equal key, so null ids meet too
    both = own.join(covered, (F.col("_own_th") == F.col("_th")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    every = F.split(F.col(text), "\n", -1)
    both = both.withColumn("_n", F.when(F.col(text).isNotNull(), F.size(every)).otherwise(0).cast("long"))
    both = both.withColumn("_lines", F.when(F.col("_gone").isNotNull(), every))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get(F.col("_lines"), i)), "\n")
    out = both.withColumn("_new", F.when(F.col("_gone").isNotNull(), left).otherwise(F.col(text)))
    return out.select(
        *[F.col("_new").alias(text) if c == text else F.col(c) for c in docs.columns],
        F.col("_n").alias("n_lines"),
        F.when(F.col("_gone").isNotNull(), F.size("_gone")).otherwise(0).cast("long").alias("n_removed"),
    )
