"""Components of reads that share minimizers, and maximal unbranched paths of a k-mer graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import dna, kernels


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which all executors share.

    A folder of this machine is set only in local mode where the session names none; elsewhere that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandwise-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the shared folder; a lost executor takes nothing of it along."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again.

    A checkpoint keeps the size that the optimizer has estimated, and a join multiplies the sizes of its sides, so in
    rounds of joins over checkpoints the estimate gets twice the digits each round and planning takes minutes. A
    written table has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node that can be reached, for every node of `edges`.

    In each round a node is merged into the least of its neighbours and itself, and edges are contracted: those within
    a merged node go, and equal ones become one. "Least" is by value and, every other round, by a new hash, which takes
    at least a quarter of the nodes on average whatever the graph looks like; so all rounds together have a few rows
    for each edge. Labels then go back from the last round to the first. Neighbours are aggregated before the shuffle,
    so a node with many edges is no hot group. An empty edge table has no nodes. Nulls are no nodes.
    """
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges, merges = written(edges.select(*pair).distinct()), []
    while not edges.isEmpty():
        ranked = [F.xxhash64(F.lit(len(merges)), "x").alias("rank")] if len(merges) % 2 else []
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("x", F.col("b"))
        near = near.groupBy("a").agg(F.min(F.struct(*ranked, "x")).alias("near")).withColumn("x", F.col("a"))
        merges.append(written(near.select(F.col("a").alias("node"), F.least(F.struct(*ranked, "x"), "near")["x"].alias("into"))))
        of_a, of_b = merges[-1].toDF("a", "into_a"), merges[-1].toDF("b", "into_b")
        contracted = edges.join(of_a, "a").join(of_b, "b").select(F.col("into_a").alias("a"), F.col("into_b").alias("b"))
        edges = written(contracted.where("a <> b").select(*pair).distinct())
    if not merges:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    last = merges.pop()
    while merges:
        last = written(merges.pop().join(last.toDF("into", "last"), "into", "left").select("node", F.coalesce("last", "into").alias("into")))
    least = last.groupBy("into").agg(F.min("node").alias("label"))
    return written(last.join(least, "into").select("node", "label"))


def read_groups(reads: DataFrame, k: int = 21, w: int = 11, least: int = 2, most: int = 50) -> DataFrame:
    """(ord, component): reads joined through minimizers that `least` to `most` reads have. Others are alone.

    Reads of a minimizer are linked to the first of them, so a minimizer adds as many edges as it has reads.
    """
    by = Window.partitionBy("m", "odd")
    own = kernels.minimizers(reads, k, w, distinct=True).select(F.col("ord").alias("a"), F.min("ord").over(by).alias("b"), F.count("*").over(by).alias("n"))
    edges = own.where(F.col("n").between(least, most)).select("a", "b").where("a <> b").distinct()
    labels = components(edges)
    return reads.select("ord").join(labels, F.col("ord") == F.col("node"), "left").select("ord", F.coalesce("label", "ord").alias("component"))


def unitigs(reads: DataFrame, k: int = 21, least: int = 2) -> DataFrame:
    """(seq, strands): maximal unbranched paths over k-mers seen `least` times, each by the lesser of its strands.

    Nodes are oriented k-mers of both strands, as numbers (k up to 31); a link holds where it is the only way out and the only way in. Each
    round doubles the steps that a node knows back to its head, so rounds are logarithmic in the longest path. A circle
    is cut before its least k-mer.
    """
    nodes = written(kernels.kmer_counts(reads, k, canonical=False, both=True).where(F.col("n") >= least).select("x"))
    links = nodes.select(F.col("x").alias("a"), F.col("x").bitwiseAND(4 ** (k - 1) - 1).alias("mid")).join(nodes.select(F.col("x").alias("b"), F.shiftright("x", 2).alias("mid")), "mid")
    out = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1")
    into = links.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1")
    sole = written(out.select("a", "b").join(into.select("a", "b"), ["a", "b"]).where("a <> b"))
    state = ranks(nodes, sole)
    paths = state.groupBy("anc").agg(F.sort_array(F.collect_list(F.struct("steps", F.substr(F.lit("ACGT"), F.col("x").bitwiseAND(3).cast("int") + 1, F.lit(1)).alias("base")))).alias("s"))
    whole = paths.select(F.concat(F.substr(kernels.letters_of(F.col("anc"), k), F.lit(1), F.lit(k - 1)), F.array_join(F.transform("s", lambda x: x["base"]), "")).alias("seq"))
    return whole.groupBy(dna.canonical(F.col("seq")).alias("seq")).agg(F.count("*").alias("strands"))


def ranks(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(x, anc, steps): the head of every node's path and the steps from it, by pointer doubling over links (a, b).

    Nodes of circles find no head; once the rounds reach as far as there are such nodes, each circle is cut before its
    least node and ranked as a path.
    """
    begin = nodes.join(links, nodes["x"] == links["b"], "left").select("x", F.coalesce("a", "x").alias("anc"), F.when(F.col("a").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("a").isNotNull().alias("open"), F.least("x", "a").alias("low"))
    state, reach = written(begin), 1
    while True:
        ahead = state.select(F.col("x").alias("anc"), F.col("anc").alias("next"), F.col("steps").alias("more"), F.col("open").alias("still"), F.col("low").alias("least"))
        state = written(state.join(ahead, "anc").select("x", F.col("next").alias("anc"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"), F.least("low", "least").alias("low")))
        left, reach = state.where("open").count(), reach * 2
        if left == 0 or reach > left:
            break
    done = state.where("not open").select("x", "anc", "steps")
    if left == 0:
        return done
    circles = written(state.where("open").select("x", "low"))
    within = links.join(circles, links["b"] == circles["x"]).where("b <> low").select("a", "b")
    return done.unionByName(ranks(circles.select("x"), within))
