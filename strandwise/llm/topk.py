"""Exact top-k search by term-at-a-time accumulation.

A block of query rows (bounded, so it may be broadcast) meets every batch of candidates: each query scatters its
weights, one non-zero dimension after the other, over that dimension's postings into a dense array of scores. A task
keeps the k best of each query between its batches (selection by partition), and the tasks' lists are merged by a
window. Queries beyond one block take further passes over the candidates, so memory doesn't grow with the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import ship

#: Query rows of one pass, and candidates of one dense score array.
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 8192


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector is null or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list array, as views of its values."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def accumulate(queries: list[tuple[int, np.ndarray]], ids: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], k: int, kept: dict[int, list[tuple[int, int]]]) -> None:
    """Score every query against one block of candidates and fold its k best (score, id) into `kept`.

    A dimension's postings are (rows, weights); rows is None where every candidate has a weight there.
    """
    n = len(ids)
    scores = np.empty(n, dtype=np.int64)
    for q, weights in queries:
        scores[:] = 0
        for d in np.nonzero(weights)[0].tolist():
            if d < len(postings):
                rows, w = postings[d]
                if rows is None:
                    scores += weights[d] * w
                else:
                    scores[rows] += weights[d] * w
        take = np.arange(n)
        if n > k + 1:  # one more, as the query itself may be among them
            least = np.partition(scores, n - k - 1)[n - k - 1]
            take = np.nonzero(scores >= least)[0]  # all ties at the border
        best = sorted(((-int(s), int(i)) for s, i in zip(scores[take], ids[take], strict=True) if i != q))[:k]
        kept[q] = sorted([*kept.get(q, []), *best])[:k]


def inverted(vectors: list[np.ndarray]) -> list[tuple[np.ndarray | None, np.ndarray]]:
    width = max((len(v) for v in vectors), default=0)
    dense = np.zeros((width, len(vectors)), dtype=np.int64)
    for i, v in enumerate(vectors):
        dense[: len(v), i] = v
    out: list[tuple[np.ndarray | None, np.ndarray]] = []
    for column in dense:
        rows = np.nonzero(column)[0]
        out.append((None, column) if len(rows) > 0.5 * len(column) else (rows, column[rows]))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k largest integer inner products of each query, ties to the smaller id.

    Queries are the rows where `is_query` holds; candidates are all rows but those with the query's own id. Vectors that
    are null or hold null or non-finite components, and rows without an id, take no part. Missing components of shorter
    vectors count as 0. Candidates of equal id are candidates each; of queries with equal id the least vector asks.
    Scores are exact while they fit a long. An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    asking = usable.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asking.count() // query_block))
    passes: DataFrame | None = None
    for block in range(blocks):
        rows = asking.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else asking
        own = rows.toArrow()
        shared = spark.sparkContext.broadcast(list(zip(own.column(0).to_pylist(), rows_of(own.column(1).combine_chunks()), strict=True)) if own.num_rows else [])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries, kept = shared.value, {}
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                every = rows_of(batch.column(1))
                for at in range(0, len(ids), CANDIDATE_BLOCK):
                    accumulate(queries, ids[at : at + CANDIDATE_BLOCK], inverted(every[at : at + CANDIDATE_BLOCK]), k, kept)
            out = [(q, i, -s) for q, best in kept.items() for s, i in best]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "id", "score"])

        part = usable.select("id", "v").mapInArrow(run, "query_id long, id long, score long")
        passes = part if passes is None else passes.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return passes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
