"""Consensus and differences by stretches, against the walk of one row for each base; counts of contexts."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandwise.functions import kernels
from strandwise.operators import align, pileup


def test_stretches_agree_with_the_walk(spark, monkeypatch):
    monkeypatch.setattr(pileup, "BLOCK", 16)
    rng = random.Random(7)
    rows = []
    for i in range(60):
        cigar = [(rng.choice((0, 1, 2, 3, 4, 5, 7, 8)), rng.randrange(12)) for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice((-1, 0, 1)), rng.randrange(60), cigar, "".join(rng.choices("ACGTNRx", k=rng.randrange(40)))))
    df = spark.createDataFrame(rows, "ord long, ref_id int, pos long, cigar array<struct<op:int,len:int>>, seq string").repartition(3)
    some = lambda d: {tuple(r) for r in d.collect()}
    s = align.walk(df)
    votes = align.consensus(s)
    assert some(pileup.consensus(df)) == some(votes)
    d = align.differences(s, votes)
    there = F.col("ref_pos").isNotNull()
    want = d.groupBy("ord").agg(F.count(F.when(there, 1)), F.count(F.when(there & (F.col("diff") == 0), 1)), F.count(F.when(~there, 1)), F.sum("diff"))
    got = pileup.differences(df, pileup.consensus(df))
    assert some(pileup.summed(got)) == some(want)
    assert some(pileup.rebuild(got)) == some(align.rebuild(d))


def test_contexts_are_counted(spark, monkeypatch):
    monkeypatch.setattr(kernels, "SLICE", 50)
    rng = random.Random(1)
    reads = [("".join(rng.choices("ACGTNé", k=n)), "".join(rng.choices("#$I", k=n))) for n in (0, 1, 2, 9, 30, 30)]
    sets = {"a": ["pos", "base"], "b": ["p2", "base", "q"], "c": ["q1", "q"], "d": ["p8", "base"]}
    got = kernels.context_counts(spark.createDataFrame(reads, "seq string, qual string"), sets)
    out = {n: {tuple(r) for r in got.where(F.col("model") == n).select(*own, "n").collect()} for n, own in sets.items()}
    old = lambda s, i, k: s[i - k : i] if i >= k else None
    rows = [(s, q, i) for s, q in reads for i in range(len(s))]
    of = {"a": lambda s, q, i: (i, s[i]), "b": lambda s, q, i: (old(s, i, 2), s[i], ord(q[i]) - 33), "c": lambda s, q, i: (ord(q[i - 1]) - 33 if i else None, ord(q[i]) - 33), "d": lambda s, q, i: (old(s, i, 8), s[i])}
    assert out == {n: {(*k, c) for k, c in Counter(f(*r) for r in rows).items()} for n, f in of.items()}


def test_no_row_for_each_base(spark, tmp_path):
    from strandwise.plans import catalog

    spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, most in (("consensus_differences", 1), ("consensus_round_trip", 1), ("consensus_majority", 1), ("base_entropy_models", 1), ("quality_entropy_models", 1), ("mutual_information_previous_bases", 1), ("long_context_entropy", 1), ("quality_contexts", 1)):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == most, name  # the reads of a text
