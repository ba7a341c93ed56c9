"""Record tables derived from the given tables, in expressions that DuckDB evaluates alike (see plans.oracle).

reads: every whole text of documents, letters only, cut into reads of READ letters. hdr: a header for every event.
aln: an alignment record for every read of 30 letters or more.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ = 150
#: Letters map to bases in turn, each 26th to N, and to qualities in steps of 7 over the printable range but for '.
LETTERS = ascii_lowercase + ascii_uppercase
BASES = "".join("N" if i % 26 == 25 else "ACGT"[i % 4] for i in range(52))
PHREDS = "".join(chr(c) for c in range(35, 74) if c != 39)
QUALS = "".join(PHREDS[(7 * i) % len(PHREDS)] for i in range(52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out anew if it has fewer partitions than the cluster has cores (one small file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, chunk, h, seq, qual). chunk is the document; h a dense number for the alignment carrier."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    letters = docs.select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("t")).where("length(t) > 0")
    mapped = letters.select("doc_id", F.translate("t", LETTERS, BASES).alias("b"), F.translate("t", LETTERS, QUALS).alias("q"))
    cut = mapped.select("*", F.explode(F.expr(f"sequence(0, (length(b) - 1) div {READ})")).alias("k"))
    return cut.selectExpr("doc_id * 1000000 + k as ord", "doc_id as chunk", "doc_id * 7 + k as h", f"substr(b, cast(k * {READ} + 1 as int), {READ}) as seq", f"substr(q, cast(k * {READ} + 1 as int), {READ}) as qual")


def bases(df: DataFrame) -> DataFrame:
    """Long form of reads: (ord, chunk, pos from 0, base, q)."""
    at = df.select("ord", "chunk", "seq", "qual", F.explode(F.expr("sequence(1, length(seq))")).alias("i"))
    return at.selectExpr("ord", "chunk", "i - 1 as pos", "substr(seq, i, 1) as base", "ascii(substr(qual, i, 1)) - 33 as q")


def hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, header) in the layout of sequencer run headers."""
    return spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")).selectExpr(
        "event_id as ord",
        "concat('@SIM:1:FC', user_id % 3, ':', event_id % 4 + 1, ':', 1101 + event_id % 50, ':', (event_id * 37) % 20000, ':', (event_id * 53) % 30000, ' 1:N:0:', event_type) as header",
    )


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, chunk, name, flag, ref_id, pos, mapq, next_ref_id, next_pos, tlen, cigar, seq, qual)."""
    r = reads(spark, sf_dir).where("length(seq) >= 30").withColumn("n", F.length("seq"))
    one = lambda op, n: f"named_struct('op', {op}, 'len', cast({n} as int))"
    return r.selectExpr(
        "ord",
        "chunk",
        "concat('r', h div 2) as name",
        "(case when h % 2 = 0 then 65 else 129 end) + (case when h % 3 = 0 then 16 else 0 end) + (case when h % 17 = 0 then 4 else 0 end) + (case when h % 29 = 0 then 256 else 0 end) as flag",
        "cast(case when h % 17 = 0 then -1 else h % 5 end as int) as ref_id",
        "case when h % 17 = 0 then -1 else (h * 37) % 3000 + (case when h % 11 = 0 then 200000 else 0 end) end as pos",
        "cast(h % 61 as int) as mapq",
        "cast((h + h % 2) % 5 as int) as next_ref_id",
        "(h * 53) % 3000 as next_pos",
        "h % 401 - 200 as tlen",
        f"case when h % 17 = 0 then cast(array() as array<struct<op:int,len:int>>) when h % 4 = 0 then array({one(0, 'n')}) when h % 4 = 1 then array({one(4, 5)}, {one(0, 'n - 5')}) when h % 4 = 2 then array({one(0, 5)}, {one(1, 2)}, {one(0, 'n - 7')}) else array({one(0, 8)}, {one(2, 3)}, {one(0, 'n - 8')}) end as cigar",
        "seq",
        "qual",
    )
