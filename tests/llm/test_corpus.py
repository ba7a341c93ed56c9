"""Operators across rows against brute force: SimHash, line dedup, leaks, top-k, and the pipeline."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandwise.llm import decontaminate, line_dedup, simhash, topk


def test_fingerprint_is_the_contract():
    for text in ("", "One", "a b", "A b\tc d", "É é x " * 9):
        w = text.encode().lower().split()
        parts = ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]) if w else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) % 2**64 == want


def brute(fps):
    label = {i: i for i in range(len(fps))}
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin((a ^ b) % 2**64).count("1") <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    return [label[i] for i in range(len(fps))]


def test_links_find_every_component(spark, monkeypatch):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(12)]
    for base in list(fps[:4]):
        for _ in range(14):
            x = base
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = brute(fps)
    for dense in (64, 3):  # pairs, and stars for crowded segments
        monkeypatch.setattr(simhash, "DENSE", dense)
        labels = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
        assert [labels.get(x, x) for x in fps] == [fps[k] for k in want]


def test_near_duplicates_and_representatives(spark):
    text = " ".join(f"word{i} the of" for i in range(300))
    rows = [(5, text, "a"), (3, text, "b"), (9, text.replace("word7 ", "Word7  "), "c"), (4, None, "d"), (2, "", "e"), (None, text, "f"), (7, "something else", "g"), (7, "something else", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = sorted(((r.id is None, r.id, r.component) for r in simhash.near_duplicates(df).collect()), key=str)
    assert sorted(out, key=str) == sorted([(False, 5, 3), (False, 3, 3), (False, 9, 3), (False, 4, 2), (False, 2, 2), (True, None, 3), (False, 7, 7), (False, 7, 7)], key=str)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.key for r in kept.collect()) == ["e", "f", "g", "g"] or sorted(r.key for r in kept.collect()) == ["d", "f", "g", "g"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_line_dedup(spark):
    texts = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd"), (4, "a\na\na\na\na"), (5, None), (6, ""), (7, "a\nb"), (8, "\n\n\n\n"), (9, "b\nc\nd\nb\nc\nd"), (None, "a\nb\nc"), (7, "q\nr\ns"), (7, "q\nr\ns")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("pos", F.lit("x"))
    out = line_dedup.dedup(df)
    seen, want = set(), []
    order = sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0))
    for key, t in order:
        lines = t.split("\n") if t is not None else []
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if "".join(w):
                gone |= {i, i + 1, i + 2} if w in seen else set()
                seen.add(w)
        want.append((key, "\n".join(x for i, x in enumerate(lines) if i not in gone) if t is not None else None, len(lines), len(gone)))
    found = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert found == set(want)
    assert out.count() == len(texts) and out.columns[:3] == df.columns
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    items = [" ".join(rng.choices(vocab, k=n)) for n in (30, 16, 9, 4, 60)] + [None, ""]
    fill = lambda n: " ".join(rng.choices(vocab, k=n))
    changed = items[0].split()
    for i in (5, 15, 25):
        changed[i] = "other"
    docs = [(1, fill(50) + " " + items[0] + " " + fill(9)), (2, " ".join(changed).upper()), (3, fill(200)), (4, items[3]), (5, None), (6, ""), (7, items[2] + "! " + items[1]), (None, items[4]), (8, " ".join(items[4].split()[:20])), (9, " ".join(items[4].split()[:6]) + " " + fill(80))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = {(r.id, r.item): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(out) == {(1, 0), (2, 0), (4, 3), (7, 2), (7, 1), (8, 4)}
    assert (out[1, 0].first_word, out[1, 0].n_equal, out[1, 0].score) == (50, 30, 1.0)
    assert out[2, 0].n_equal == 27
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.leaks(df.limit(0), bench).count() == 0


def test_topk_is_exhaustive(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(240, 6)).round(2)
    vectors[100:130] = vectors[50]
    vectors[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    m = np.floor(256 * vectors.astype(np.float32).astype(float)).astype(int)
    want = set()
    for q in range(0, 240, 50):
        s = m @ m[q]
        want |= {(q, k + 1, j, int(-x)) for k, (x, j) in enumerate(sorted((-s[j], j) for j in range(240) if j != q)[:5])}
    for block in (8192, 2):
        assert {tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, query_block=block).collect()} == want
    few = df.where("vec_id in (50, 51)")
    assert topk.search(few, F.col("vec_id") % 50 == 0).count() == 1
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    words = {"en": "the of and that with this from have they were been which".split(), "fr": "le la les des une dans pour avec sont cette mais nous".split()}
    say = lambda k, n: " ".join(rng.choices(words[k], k=n))
    leak = " ".join(f"item{i}" for i in range(30))
    copy = say("en", 200)
    texts = [(0, copy, "en"), (1, copy, "en"), (2, say("fr", 100), "fr"), (3, "%%% 123", "en"), (4, say("en", 50) + " " + leak, "en"), (5, "\n".join(["aa the", "bb of", "cc and", say("en", 60)]), "en"), (6, "\n".join(["aa the", "bb of", "cc and", say("en", 70)]), "en"), (7, None, None)]
    spark.createDataFrame([(i, t, k, "src0", len(t or "")) for i, t, k in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted(r.doc_id for r in docs.collect()))
        if name == "line_dedup":
            six = docs.where("doc_id = 6").collect()[0]
            assert "\n" not in six.text and six.n_chars == len(six.text)
        if name != "bpe":
            assert docs.columns == columns
    assert kept == [[0, 1, 2, 4, 5, 6], [0, 1, 2, 4, 5, 6], [0, 2, 4, 5, 6], [0, 2, 5, 6], [0, 2, 5, 6]]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 2, 5, 6}


def test_similar_representatives_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(80, 300))
        texts.append(base)
        for _ in range(3):
            own = list(base)
            own[rng.randrange(len(own))] = "changed"
            texts.append(own)
    hot = rng.choices(vocabulary, k=200)
    for _ in range(60):  # a crowd of near copies of one text
        own = list(hot)
        own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(own)
    rows = [(i, " ".join(w), i) for i, w in enumerate(texts)]
    rows += [(900, rows[0][1], 1), (901, "", 1), (902, None, 1), (903, "two words", 1), (None, "no id here at all", 1), (904, "two other", 1)]

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = {min((rows[i][0] is not None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in group}
    df = spark.createDataFrame(rows, "doc_id long, text string, node long")
    kept = simhash.similar_representatives(df)
    assert kept.columns == df.columns
    assert {(r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()} == want
    assert simhash.similar_representatives(df.limit(0)).isEmpty()


def test_similar_representatives_of_an_original_and_its_copies(spark):
    rng = random.Random(11)
    original = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(200):  # each like the original (0.85), no two of them alike (0.73)
        own = list(original)
        for i in rng.sample(range(2, 298, 5), 5):
            own[i] = f"x{rng.randrange(10**9)}"
        texts.append(own)
    texts.insert(100, original)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert all(jaccard(sets[100], x) >= 0.8 for x in sets)
    assert max(jaccard(sets[i], sets[i + 1]) for i in (*range(99), *range(101, 200))) < 0.8
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.similar_representatives(df).collect()] == [0]


def test_similar_representatives_compare_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    test_similar_representatives_of_an_original_and_its_copies(spark)


def test_similar_representatives_find_appended_and_cut_passages(spark):
    rng = random.Random(12)
    texts = []
    for i in range(150):  # 300 words of a text of 300 + 15..74: a similarity of 0.80 to 0.95
        text = [f"w{rng.randrange(10**6)}" for _ in range(300 + 15 + 59 * i // 149)]
        texts += [text, text[:300] if i % 2 else text[-300:]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.similar_representatives(df).collect()) == list(range(0, 300, 2))
