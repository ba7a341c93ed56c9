"""Limits of the operators: very long texts, nulls, ties, repeated rows, empty tables, clashing names, and recall."""

import random
import time
from itertools import combinations
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions.dna import running
from strandwise.llm import bpe, decontaminate, language_id, license_scan, line_dedup, pii, secrets, simhash
from strandwise.llm.common import with_spans


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 1000, 20_000)]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<int>").select("i", running(F.col("x")).alias("r"))
    assert {r.i: r.r for r in out.collect()} == {i: np.concatenate([[0], np.cumsum(x)])[: len(x)].astype(int).tolist() for i, x in enumerate(rows)}


def test_spans_of_a_text_with_very_many_matches(spark):
    n = 100_000
    df = spark.createDataFrame([(" ".join(f"a{i}" for i in range(n)),)], "t string")
    start = time.time()
    (r,) = with_spans(df, "t", {"x": "[0-9]+"}).select(F.size("x").alias("n"), F.element_at("x", -1).alias("last"), F.get("x", F.lit(10)).alias("tenth")).collect()
    assert r.n == n and r.last.m == str(n - 1) and r.tenth.m == "10" and r.tenth.e - r.tenth.s == 2
    assert time.time() - start < 60


@pytest.mark.parametrize("n", range(1, 13))
def test_masks_of_short_items_miss_no_change(n):
    masks = decontaminate.short_masks(n)
    for changed in combinations(range(n), n - ceil(0.8 * n - 1e-9)):
        assert any(all(m[k] == "0" or at + k not in changed for k in range(len(m))) for m in masks for at in range(n - len(m) + 1))


def test_masks_of_a_window_miss_one_change_of_78():
    found = sum(any(all(m[k] == "0" or at + k not in c for k in range(9)) for m in decontaminate.MASKS for at in range(5)) for c in combinations(range(13), 2))
    assert found >= 77


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    items = [rng.choices(words, k=n) for n in (3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20, 40) for _ in range(4)]
    docs = []
    for i, item in enumerate(items * 3):
        own = list(item)
        for k in rng.sample(range(len(own)), len(own) - ceil(0.8 * len(own))):
            if rng.random() < 0.8:
                own[k] = "changed"
        docs.append(rng.choices(words, k=rng.randrange(60)) + own + rng.choices(words, k=rng.randrange(60)))
    docs.append(items[0])

    def best(item, doc):
        if len(item) < decontaminate.LEAST_WORDS and len(item) != len(doc):
            return 0
        width, score = min(13, len(item)), 0
        for at in range(-len(item) + 1, len(doc)):
            equal = [0 <= at + k < len(doc) and doc[at + k] == w for k, w in enumerate(item)]
            score = max(score, max(sum(equal[k : k + width]) for k in range(len(item) - width + 1)) / width)
        return score

    want = {(i, j): best(item, doc) for i, doc in enumerate(docs) for j, item in enumerate(items)}
    want = {k: v for k, v in want.items() if v >= 0.8}
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    out = {(r.id, r.item): r.score for r in decontaminate.leaks(df.unionByName(df.limit(3)), bench).collect()}
    assert set(out) <= set(want) and len(set(want) - set(out)) <= 0.02 * len(want)
    assert all(abs(out[k] - want[k]) < 1e-9 for k in out)


def test_leaks_in_a_very_long_text_of_one_passage(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    df = spark.createDataFrame([(1, (item + " ") * 2000), (2, None), (3, "")], "doc_id long, text string").withColumn("places", F.lit(1)).withColumn("w", F.lit(2))
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item)], "item_id long, text string")
    assert [(r.id, r.item, r.first_word, r.score) for r in decontaminate.leaks(df, bench).collect()] == [(1, 7, 0, 1.0)]


def test_markov_model_tells_random_strings_from_words(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n, of=letters: "".join(rng.choices(of, k=n))
    plain = "understanding internationalization representation of the ordinary neighbourhood everywhere characteristics misunderstanding responsibilities"
    names = ["get_current_connection_identifier", "internationalizationconfiguration", "HttpServletRequestWrapper", "characteristically-misunderstood"]
    texts = [f'{plain} token = "{key(32)}" and {plain}' for _ in range(40)] + [" ".join(names)] * 2 + [None, ""]
    held = [f"x {key(24)} y" for _ in range(50)] + [f"x {key(24, letters[:52])} y" for _ in range(50)]
    rows = [(i, t) for i, t in enumerate([*texts, *held])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("old")).withColumn("x", F.lit("kept"))
    out = secrets.scan(df.unionByName(df.limit(1)), secrets.train(df.where("doc_id < 42")))
    assert out.columns.count("x") == 1 and out.count() == len(rows) + 1
    found = {r.doc_id: r.s for r in out.select("doc_id", secrets.joined(F.col("secrets")).alias("s")).collect()}
    assert sum(found[len(texts) + i] == "random:2:26" for i in range(100)) >= 90
    assert found[40] == found[41] == found[42] == found[43] == ""
    assert secrets.scan(df.limit(0), secrets.train(df.limit(0))).count() == 0


def test_contexts_of_addresses_without_digits(spark):
    names = ["jane.doe", "john.roe", "mary.sue", "max.power", "ann.other", "tim.tam", "kim.lee", "bob.ray", "sue.may"]
    text = " ".join(f"{w} reach {x}@example.com soon" for w, x in zip("abcdefghi", names, strict=True)) + " reach jane@localhost soon"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string").withColumn("tokens", F.lit(1))
    out = pii.scan(df).select("doc_id", pii.joined(F.col("found")).alias("f")).collect()
    at = text.index("jane@localhost")
    assert sorted(r.f.endswith(f",id:{at}:{at + 14}") for r in out) == [False, False, True, True, True]


def test_bootstrapping_against_a_model(spark):
    rng = random.Random(6)
    before = [f"b{chr(97 + i)}" for i in range(12)]
    texts = []
    for i in range(300):
        w = before[i % 12]
        shown = f"10.{i % 250}.3.4" if rng.random() < (0.95 if i % 12 < 4 else 0.3) else f"AB{10000 + i}"
        texts.append(f"word {w} {shown} end")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.pattern: r.confidence for r in pii.patterns(pii.tokens(pii.with_base(df, "text"), "text")).collect()}
    edges = {}
    for t in texts:
        _, w, x, after = t.split()
        for p in (f"<{w}", f">{after}"):
            edges.setdefault(p, {})[x] = x[0] == "1"
    score = {x: float(s) for own in edges.values() for x, s in own.items()}
    for k in range(pii.ROUNDS):
        conf = {p: sum(score[x] for x in own) / (len(own) + pii.PRIOR) for p, own in edges.items()}
        if k + 1 < pii.ROUNDS:
            for x in score:
                if x[0] != "1":
                    miss = 1.0
                    for p, own in edges.items():
                        miss *= 1 - min(conf[p], 0.999) if x in own else 1
                    score[x] = 1 - miss
    want = {p: c for p, c in conf.items() if c >= pii.CONFIDENT and sum(edges[p].values()) >= pii.LEAST_SEEDS}
    assert set(got) == set(want) and want and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_crowds_of_one_segment_at_the_real_limit(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(2**62))
    fps = {base ^ int(rng.integers(2**32)) for _ in range(60)} | {base ^ 1 << a ^ 1 << b for a in range(32) for b in range(a)}
    fps = sorted(fps)
    assert len(fps) > 4 * simhash.DENSE
    group = list(range(len(fps)))
    a = np.array(fps, dtype=np.uint64)
    far = np.unpackbits((a[:, None] ^ a[None, :]).view(np.uint8).reshape(len(a), len(a), 8), axis=2).sum(axis=2)
    for i, j in zip(*np.nonzero(far <= 3), strict=True):
        if group[i] != group[j]:
            lo, hi = sorted((group[i], group[j]))
            group = [lo if g == hi else g for g in group]
    labels = {r.node: r.label for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    assert [labels.get(x, x) for x in fps] == [fps[g] for g in group]


def test_common_cells_and_order(spark, monkeypatch):
    texts = [f"a{i} b{i} c{i} d{i} e{i} one two three four five six" for i in range(40)]
    df = spark.createDataFrame([((i, i), t) for i, t in enumerate(texts)], "key struct<id:long,node:long>, text string")
    want = np.unique(simhash.cells_of(np.unique(simhash.shingle_hashes("one two three four five six", 5))))
    assert simhash.common_cells(df, 5).tolist() == want.tolist()
    assert simhash.common_cells(df.limit(0), 5).tolist() == []
    monkeypatch.setattr(simhash, "CELLS", 1)  # every text is sent by itself
    assert simhash.common_cells(df, 5).tolist() == want.tolist()
    order = simhash.ordered(simhash.shingle_hashes(texts[0], 5), want)
    assert (order >> 62).tolist() == [0] * (len(order) - 2) + [1] * 2


def test_line_dedup_of_a_very_long_text(spark):
    text = "\n".join(["same line"] * 30_000 + ["", "", "", ""])
    df = spark.createDataFrame([(1, text), (1, text), (2, "   \n\n \n"), (3, " \n\n  ")], "doc_id long, text string").withColumn("n_lines_", F.lit(0))
    out = {(r.doc_id, len(r.text), r.n_removed) for r in line_dedup.dedup(df).collect()}
    # the first window stays, blank ones are never removed; but a window that is blank in part is a window
    assert {x[0] for x in out} == {1, 2, 3} and {x for x in out if x[0] != 1} == {(2, 7, 0), (3, 5, 0)}
    assert next(x[2] for x in out if x[0] == 1) > 29_990


def test_licenses_of_empty_tables_null_ids_and_very_many_words(spark):
    long = "word " * 100_000 + "under the mit license"
    df = spark.createDataFrame([(None, long), (1, long), (1, long)], "doc_id long, text string").withColumn("template", F.lit(1))
    out = license_scan.scan(df).collect()
    assert len(out) == 3 and all((r.n_base, r.first_word, r.n_words) == (1, 100_000, 100_004) for r in out)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_bpe_of_empty_tables_null_ids_and_long_pieces(spark):
    import base64

    import public_tokenizers
    import tiktoken

    raw = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdeinorstu", k=n)) for n in (60, 64, 65, 100, 128, 129, 200, 256, 257, 400, 3000)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, texts[0]), (1, texts[0])], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    out = bpe.encode_decode(df, raw, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert sorted(map(tuple, (r.ids for r in out))) == sorted(tuple(library.encode_ordinary(t)) for t in [*texts, texts[0], texts[0]])
    assert bpe.encode_decode(df.limit(0), raw, public_tokenizers.PATTERN).count() == 0


def test_language_of_long_texts_repeated_rows_and_tables_without_labels(spark):
    said = {"en": "the cat and the dog are in the house with this and that ", "de": "der hund und die katze sind nicht in dem haus und das "}
    rows = [(i, said[k] * (1 + i % 4), k, f"{k}.example") for i, k in enumerate(["en", "de"] * 20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = language_id.fit(train)
    long = spark.createDataFrame([(1, said["de"] * 50_000, None, None), (2, said["en"], "en", "en.example"), (2, said["en"], "en", "en.example")], train.schema)
    out = sorted((r.doc_id, r.language) for r in language_id.identify(long, model, F.col("text"), F.col("lang"), F.col("host")).collect())
    assert out == [(1, "de"), (2, "en"), (2, "en")]
    none = language_id.fit(train.withColumn("lang", F.lit(None).cast("string")))
    assert {r.language for r in language_id.identify(train, none, F.col("text"), F.col("lang"), F.col("host")).collect()} == {"und"}
    assert not language_id.fit(train.limit(0)).languages


@pytest.mark.parametrize("rows", [[], [(1, "some words of a text without a label", None, None, 1), (None, None, None, None, None)]])
def test_pipeline_of_empty_and_unlabelled_documents(spark, tmp_path, rows):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("node", F.lit("own")).withColumn("label", F.lit(1))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == len(rows), name
