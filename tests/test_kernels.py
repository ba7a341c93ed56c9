"""Kernels against the Column functions that state what they give, letters outside A, C, G, N and T included."""

import random

from pyspark.sql import functions as F

from strandwise.functions import dna, kernels
from strandwise.operators import kmers, mapping


def some_reads(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choices(letters, k=n)) for letters in ("ACGT", "ACGTN", "AC", "ACGTacgtx", "ACGTé") for n in (0, 1, 20, 21, 22, 31, 32, 33, 60, 150)]
    return spark.createDataFrame([*enumerate(seqs), (99, None)], "ord long, seq string").repartition(3)


def test_choices_of_kmers(spark, monkeypatch):
    monkeypatch.setattr(kernels, "SLICE", 100)
    df = some_reads(spark)
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    s = F.col("seq")
    want = df.select("ord", dna.open_syncmer(s).alias("s")).select("ord", "s.kmer", dna.kmer_hash(F.col("s.kmer")).alias("hash"), "s.pos")
    assert rows(kernels.syncmers(df, ["ord"])) == rows(want)
    assert rows(kernels.closed_syncmers(df)) == rows(df.select("ord", dna.closed_syncmers(s).alias("p")).where("size(p) > 0"))
    assert rows(kernels.minimizer_lists(df)) == rows(df.select("ord", dna.minimizers(s).alias("m")).where("size(m) > 0"))
    assert rows(kernels.minimizer_places(df)) == rows(df.select("ord", F.explode(dna.minimizer_places(s)).alias("m")).select("ord", "m.*"))
    assert rows(kernels.sketches(df, 21, 8)) == rows(df.select("ord", F.coalesce(dna.sketch(s, 21, 8), F.expr("cast(array() as array<string>)"))))
    distinct = df.select("ord", F.explode(F.array_distinct(dna.minimizers(s))).alias("m"))
    assert rows(kernels.minimizers(df, distinct=True).select("ord", kernels.minimizer_text(21))) == rows(distinct)


def test_pairs_count_the_places_of_a_minimizer(spark):
    rng = random.Random(8)
    one, two = ("".join(rng.choices("ACGT", k=60)) for _ in range(2))
    df = spark.createDataFrame([(0, one + two + one), (1, one)], "ord long, seq string")
    # the minimizers of `one` stand three times in two reads
    assert [r[:2] for r in kmers.shared_pairs(df, shared=1).collect()] == [(0, 1)]
    assert kmers.shared_pairs(df, shared=1, most=2).where("n > 2").count() == 0


def test_queries_on_kmers_take_no_lambda(spark, tmp_path):
    """Interpreted lambdas over the k-mers of a read were what took the time."""
    from strandwise.plans import catalog

    spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("open_syncmer_keys", "closed_syncmer_places", "rank_recode", "kmer_hashes", "minimizer_places", "cached_delta_candidates", "phred_bytes"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in plan, name


def test_a_frequent_minimizer_makes_no_overlap_pairs(spark):
    df = spark.createDataFrame([(i, "ACGTTGCAACGTAGCTAGCTAGGATCCAAT") for i in range(60)] + [(100 + i, "TTGACCAGGATTACAGATTACCAGGATACCAGTT") for i in range(3)], "ord long, seq string")
    got = {(r.a, r.b) for r in mapping.overlaps(df, cap=50).collect()}
    assert got == {(100, 101), (100, 102), (101, 102)}


def test_packed_kernels_and_least_of_equal_references(spark):
    from strandwise.functions import packing, quality

    rng = random.Random(2)
    df = spark.createDataFrame([(i, "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("!#Iz", k=n))) for i, n in enumerate((0, 1, 3, 4, 5, 8, 9, 40))], "ord long, seq string, qual string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    p = packing.pack_masked(F.col("seq"))
    assert rows(kernels.masked(df).select("ord", "data", "mask", "back")) == rows(df.select("ord", p["data"], p["mask"], "seq"))
    assert [r.places for r in kernels.masked(df).orderBy("ord").collect()] == [[i for i, c in enumerate(r.seq) if c == "N"] for r in df.orderBy("ord").collect()]
    b = quality.to_bytes(F.col("qual"))
    some = df.where("qual <> ''")
    assert rows(kernels.phred_bytes(some)) == rows(some.select("ord", b, quality.from_bytes(b)))
    assert [tuple(r)[1:] for r in kernels.phred_bytes(df.where("qual = ''")).collect()] == [(b"", "")]
    ref = "".join(rng.choices("ACGT", k=90))
    hits = mapping.best_hits(spark.createDataFrame([(0, ref[10:70])], "ord long, seq string"), spark.createDataFrame([(5, ref), (3, ref), (4, ref[1:])], "ref long, seq string"))
    assert [tuple(r) for r in hits.collect()] == [(0, 3, 10, False, 0)]
    # one row for equal references goes into the join
    assert "Aggregate [seq" in hits._jdf.queryExecution().optimizedPlan().toString()
