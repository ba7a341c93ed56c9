"""Operators on the literal fixtures, and invariants that SQL can't state."""

import random

from pyspark.sql import functions as F

from strandwise.functions import dna, headers, quality
from strandwise.operators import align, graph, kmers, mapping, stats


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'long' if isinstance(values[n], int) else 'string'}" for n in names))
    return df.select(column.alias("x")).collect()[0].x


def test_dna(spark):
    c = F.col("s")
    assert one(spark, dna.reverse_complement(c), s="acgtNx") == "NNACGT"
    assert one(spark, dna.canonical(c), s="TTTTAAAACCCCGGGG") == "CCCCGGGGTTTTAAAA"
    assert one(spark, dna.is_reverse(c), s="ACGT") is False
    assert one(spark, dna.kmer_hash(c), s="ACGT") == 27
    assert one(spark, dna.kmer_hash(c), s="ACNT") is None
    assert one(spark, dna.hash_kmer(F.col("h"), 4), h=27) == "ACGT"
    assert one(spark, dna.hamming(F.col("a"), F.col("b")), a="ACGT", b="AGGTT") == 1
    assert one(spark, dna.hamming(F.col("a"), F.col("b"), 0), a="ACGT", b="AGGT") is None
    assert one(spark, dna.composition_entropy(c), s="ACGT") == 2.0
    for d in (0, -1, 1, -300, 300, 2**40, -(2**40)):
        assert one(spark, dna.unzigzag(dna.zigzag(F.col("d"))), d=d) == d
    assert [one(spark, dna.varint_size(F.col("d")), d=d) for d in (0, 127, 128, 16384)] == [1, 1, 2, 3]
    assert one(spark, dna.profile(quality.values(F.col("s")), 2), s="II!!") == [40, 0]


def test_quality(spark):
    c = F.col("s")
    assert one(spark, quality.quantise(c, "discard"), s="IIHH") == "!!!!"
    assert one(spark, quality.quantise(c, "illumina8"), s="!5I") == "!0<"
    assert one(spark, quality.quantise(c, "binary"), s="45") == "'I"
    assert one(spark, quality.mean(c), s="II!!") == 53
    # stored values by tens of the Phred value
    want = {0: 6, 15: 6, 25: 15, 35: 22, 45: 27, 55: 33, 65: 37, 75: 40}
    for q, v in want.items():
        assert one(spark, quality.stored(c, "illumina8"), s=chr(33 + q)) == chr(33 + v), q


def test_headers(spark):
    rng = random.Random(9)
    place = lambda: f"RUN{rng.randrange(99)}:{rng.randrange(500)}:CELL{rng.randrange(99)}:{rng.randint(1, 8)}:{rng.randrange(65536)}:{rng.randrange(65536)}:{rng.randrange(65536)}"
    rows = [(f"@ACC{k}.{rng.randrange(2**32)} {place()}{'/1' * (k % 2)}", "sra") for k in range(6)]
    rows += [(f"@{place()}{tag} 1:N:0:{rng.choice('ACGT') * 8}", "casava") for tag in ("", "", ":AACCGGTT", ":rAAC:X")]
    rows += [("@name and a comment", None), (f"@{place()}".replace(":", ":999:", 1).rsplit(":", 3)[0] + " 1", None), ("@A:B:C:256:1:2:3 1", None), ("@A:B:C:1:65536:2:3 1", None), ("", None), (None, None)]
    df = spark.createDataFrame([(h,) for h, _ in rows], "h string").select("h", headers.parse(F.col("h")).alias("p")).select("h", "p", headers.rebuild(F.col("p")).alias("back"))
    for r, (h, fmt) in zip(df.collect(), rows, strict=True):
        assert r.p.fmt == fmt, h
        assert r.back == (h if fmt else None), h


def test_alignment_fixtures(spark):
    op = lambda *x: list(x)
    rows = [
        (0, "a", 0, 0, 100, op((4, 5), (0, 10)), "A" * 15, "?" * 15),
        (1, "b", 0, 0, 200, op((0, 5), (1, 2), (0, 8)), "C" * 15, ":" * 15),
        (2, "c", 4, -1, -1, [], "T" * 10, "5" * 10),
        (3, "d", 16, 0, 100, op((0, 2)), "GG", "!I"),
    ]
    df = spark.createDataFrame(rows, "ord long, name string, flag int, ref_id int, pos long, cigar array<struct<op:int,len:int>>, seq string, qual string")
    s = align.walk(df)
    assert s.groupBy("ord").count().count() == 3
    votes = {(r.ref_pos): r.nibble for r in align.consensus(s).collect()}
    assert votes[100] == 1 and votes[200] == 2 and len(votes) == 10 + 13  # a tie goes to the lower code
    d = align.differences(s, align.consensus(s))
    assert d.where("ref_pos is null").count() == 7
    reads = {r.ord: r for r in align.to_reads(df).collect()}
    assert (reads[3].seq, reads[3].qual, reads[0].id) == ("CC", "I!", "@a")


def test_entropy_and_code_length(spark):
    df = spark.createDataFrame([("a", i % 2) for i in range(8)] + [("b", 0)] * 8, "c string, y int")
    r = stats.entropy(df, "y", ["c"]).collect()[0]
    assert abs(r.h - 0.5) < 1e-12 and r.n == 16
    import math

    want = -sum(math.log2((n + 1) / (i + 2)) for i, n in enumerate(range(8)))
    got = stats.adaptive_bits(df.where("c = 'b'"), "y", [], 2).collect()[0].bits
    assert abs(got - want) < 1e-9
    assert stats.upper_median(df.where("c = 'a'"), ["c"], "y").collect()[0]["median"] == 1


def test_kmers(spark):
    reads = spark.createDataFrame([(0, "ACGTACGTAC"), (1, "GTACGTACGT"), (2, "ACN"), (3, "")], "ord long, seq string")
    want = {}
    for s in ("ACGTACGTAC", "GTACGTACGT"):
        for i in range(6):
            x = s[i : i + 5]
            back = x[::-1].translate(str.maketrans("ACGT", "TGCA"))
            want[min(x, back)] = want.get(min(x, back), 0) + 1
    assert {r.kmer: r.n for r in kmers.counts(reads, 5).collect()} == want


def test_unitigs_cover_paths_and_circles(spark):
    import random

    rng = random.Random(1)
    left, right = ("".join(rng.choices("ACGT", k=40)) for _ in range(2))
    circle = "".join(rng.choices("ACGT", k=30))
    reads = [left] * 2 + [right] * 2 + [circle + circle[:12]] * 2
    df = spark.createDataFrame(list(enumerate(reads)), "ord long, seq string")
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = {r.seq for r in graph.unitigs(df, 11, 2).collect()}
    assert {min(left, back(left)), min(right, back(right))} <= out
    rest = out - {min(left, back(left)), min(right, back(right))}
    assert {len(x) for x in rest} == {40} and all(x[:30] in circle * 3 or back(x)[:30] in circle * 3 for x in rest)


def test_best_hits(spark):
    import random

    rng = random.Random(2)
    ref = "".join(rng.choices("ACGT", k=300))
    read = list(ref[50:150])
    read[30] = "A" if read[30] != "A" else "C"
    read = "".join(read)
    back = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(0, read), (1, back), (2, "".join(rng.choices("ACGT", k=100)))], "ord long, seq string")
    refs = spark.createDataFrame([(7, ref)], "ref long, seq string")
    out = {r.ord: tuple(r)[1:] for r in mapping.best_hits(df, refs).collect()}
    assert out == {0: (7, 50, False, 1), 1: (7, 50, True, 1)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (40, 31)], "a long, b long")
    assert {r.node: r.label for r in graph.components(edges).collect()} == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30, 40: 30}


def test_all_kmers_are_hashed(spark, monkeypatch):
    from strandwise.plans import catalog

    seqs = ["ACGTTGCAACGTAGCTAGCTAGGATCC", "ACNTTGCAACGTAGCTAGCTAGGATC", "ACGT", "", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "ord long, seq string")
    monkeypatch.setattr(catalog, "reads", lambda spark, sf_dir: df)
    number = lambda s: sum("ACGT".index(c) * 4**i for i, c in enumerate(reversed(s)))
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cut = [(i, p, s[p : p + 21]) for i, s in enumerate(seqs) for p in range(len(s or "") - 20) if "N" not in s[p : p + 21]]
    want = {(i, p, number(x), x, number(turned(x)), number(x) >> 34) for i, p, x in cut}
    rows = catalog.QUERIES["kmer_hashes"](spark, "").collect()
    assert len(want) == 10 and len(rows) == 10 and {tuple(r) for r in rows} == want


def test_all_run_names_and_short_references(spark, monkeypatch, tmp_path):
    from strandwise.plans import catalog

    headers_of = [(i, f"@SIM:1:FC{i % 300:03d}:1:1101:5:7 1:N:0:A") for i in range(600)]
    monkeypatch.setattr(catalog, "hdr", lambda spark, sf_dir: spark.createDataFrame(headers_of, "ord long, header string"))
    got = {tuple(r) for r in catalog.QUERIES["combo_dictionary"](spark, "").select("code", "n", "first").collect()}
    assert got == {(i, 2, i) for i in range(300)}
    text = "The quick brown fox jumps over the lazy dog and the small cat"
    spark.createDataFrame([(1, text), (2, "tiny")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = {r.ord: (r.ref, r["at"], r.mismatches) for r in catalog.QUERIES["read_to_reference_hits"](spark, str(tmp_path)).collect()}
    assert hits == {1000000: (1, 0, 0)}
