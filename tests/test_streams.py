"""Operators that pass by the reads of a chunk once, against plain Python."""

import random

from strandwise.operators import columns, stats, streams


def test_chunks_are_passed_by_once(spark):
    rng = random.Random(3)
    rows = [(i, i % 7, "".join(rng.choices("ACGTN", k=rng.choice((0, 1, 12, 40)))), i) for i in range(90)]
    df = spark.createDataFrame(rows, "ord long, chunk long, seq string, x long").repartition(5)
    own = {c: [r[2] for r in rows if r[1] == c] for c in range(7)}
    cols = {(r.chunk, r.pos): r["col"] for r in streams.transposed(df).collect()}
    assert cols == {(c, p): "".join(s[p] for s in v if len(s) > p) for c, v in own.items() for p in range(max(map(len, v)))}
    best = {(r.chunk, r.pos): (r.base, r.n) for r in streams.consensus(df, "ACGTN").collect()}
    assert best == {k: max(((b, v.count(b)) for b in "ACGTN"), key=lambda x: (x[1], "ACGTN".index(x[0]))) for k, v in cols.items()}
    assert {tuple(r) for r in columns.undo_read_deltas(columns.read_deltas(df)).collect()} == {(r[0], r[2]) for r in rows}


def test_shifts_below_zero(spark):
    rng = random.Random(5)
    whole = "".join(rng.choices("ACGT", k=80))
    df = spark.createDataFrame([(0, 1, whole[20:60]), (1, 1, whole[:50]), (2, 1, whole[30:]), (3, 1, "ACGT")], "ord long, chunk long, seq string")
    assert {(r.ord, r["shift"]) for r in columns.best_shifts(df, 11).collect()} == {(0, 0), (1, -20), (2, 10)}
    got = sorted((r.place, r.base) for r in streams.shifted_consensus(df, 11, "ACGTN").collect())
    assert "".join(b for _, b in got) == whole and got[0][0] == -20


def test_no_row_for_each_base_is_shuffled(spark, tmp_path):
    from strandwise.plans import catalog

    spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("transposed_columns", "shifted_consensus", "column_consensus", "best_shifts", "reads_from_deltas", "qualities_from_deltas"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1, name  # the reads of a text


def test_long_chunks_of_the_rescaled_model(spark):
    df = spark.createDataFrame([(0, i, "ab" * 50 + "a" * 100) for i in range(3)], "chunk long, ord long, s string")
    (r,) = stats.rescaled_bits(df, "chunk", "ord", "s", "ab", 64).collect()
    import math

    state, bits = [1, 1], 0.0
    for c in ("ab" * 50 + "a" * 100) * 3:
        k = "ab".index(c)
        bits -= math.log2(state[k] / sum(state))
        state[k] += 1
        if sum(state) > 64:
            state = [(x + 1) // 2 for x in state]
    assert r.n == 600 and abs(r.bits - bits) < 1e-6
