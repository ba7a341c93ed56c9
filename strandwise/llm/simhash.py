"""SimHash near-duplicates, found by multi-index hashing over fingerprint halves.

A fingerprint has 64 bits: a bit is set if it is set in more than half of the XXH64 hashes of a text's word shingles.
Two fingerprints within 3 bits agree within 1 bit in one of their halves (two segments of 32 bits). The table has each
distinct fingerprint under both segments; a fingerprint probes with the Hamming ball of radius 1 about each segment.
Of a pair that differs in one bit of the segment only one has a zero there, so a probe that turns zeros into ones
meets it from one side, and the ball needs half its members. Matches are verified on all 64 bits.

Copies share a fingerprint, so pairs are formed between distinct fingerprints only. Where more than DENSE fingerprints
share a segment, pairs of them aren't formed: every member emits all points within 2 bits of itself, and the members
that meet in a point are linked to the least of them if one of them is within 1 bit of it. Two fingerprints within 3
bits always meet so, and any that are linked so are joined by links of 3 bits or fewer: the components are the same,
and the rows grow with the number of members and not with its square.

`similar_representatives` keeps one document of each group of near copies by five-word shingles. Its links are those of
the multi-index hashing above and, as 3 of 64 bits miss most pairs of a similarity of 0.8, all pairs whose Jaccard
similarity is `similar` or more. Of two such sets the first n - ceil(similar * n) + 1 members of each, in one order of
all hashes, have a hash in common (prefix filter), so no such pair is missed. In that order the hashes that more than
CROWD texts share come last, so that common passages bring few texts together; the order decides the work and never
the result. What meets makes clusters, and within a cluster all pairs that aren't linked yet are compared by their sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.llm.common import checkpoint, ship, size_checked
from strandwise.operators.graph import components

#: Words of a shingle, the seed of its hash, the most differing bits, and the segment size from which pairs aren't formed.
SHINGLE, SEED, BITS, DENSE = 3, 42, 3, 64

#: Similarity search: least Jaccard similarity, the most nodes of a prefix hash that are counted in pairs, nodes and
#: values of a block that is compared in one task, and values that a Python worker sends at once.
SIMILAR, CROWD, BLOCK, VALUES, FLUSH = 0.8, 8, 256, 1 << 19, 1 << 18

#: Bits of the cells in which shingles are counted, cells that a worker counts at once, and the most cells that are known
#: as common (64 MB; the most frequent ones, if there are more).
CELL_BITS, CELLS, COMMON = 30, 1 << 22, 1 << 24


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included. Words are cut by ASCII white space; no words: none."""
    words = text.encode("utf-8").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, dtype=np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(seed))), dtype=">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of `hashes`, as a signed 64-bit integer."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct shingle hashes; a text without words has one of its own."""
    hashes = np.unique(shingle_hashes(text, shingle))
    return hashes.view(np.int64) if len(hashes) else np.zeros(1, dtype=np.int64)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text, as a signed 64-bit integer."""
    return majority(shingle_hashes(text, shingle, seed))


def ordered(every: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The places of the distinct ones of `every` shingle hash, sorted: a 62-bit hash, behind a bit that is set if its cell is in `common`."""
    hashes = np.unique(every) if len(every) else np.zeros(1, dtype=np.uint64)
    cells = cells_of(hashes)
    late = common[np.minimum(np.searchsorted(common, cells), len(common) - 1)] == cells if len(common) else np.zeros(len(cells), dtype=bool)
    return np.sort((hashes >> np.uint64(2) | late.astype(np.uint64) << np.uint64(62)).view(np.int64))


def prefix(text: str, shingle: int, similar: float, common: np.ndarray) -> np.ndarray:
    """The number of distinct shingles, the fingerprint, then the shingles that come first: as many as can't all be missing in a set that is alike."""
    every = shingle_hashes(text, shingle)
    order = ordered(every, common)
    return np.concatenate([[len(order), majority(every)], order[: len(order) - math.ceil(similar * len(order) - 1e-9) + 1]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row, in the order of the rows. A null text is empty; an empty text has fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(x or "", shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(run, schema)


def ball_of_one() -> Column:
    """What turns the 32-bit segment `seg` into itself and into those with one more bit set."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.concat(F.array(F.lit(0).cast("long")), F.filter(bits, lambda m: F.col("seg").bitwiseAND(m) == 0))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within 3 bits."""
    half = F.array(F.struct(F.shiftrightunsigned("fp", 32).alias("seg"), F.lit(0).alias("k")), F.struct(F.col("fp").bitwiseAND(0xFFFFFFFF).alias("seg"), F.lit(1).alias("k")))
    segments = distinct.select("fp", F.explode(half).alias("s")).select("fp", F.col("s.seg").alias("seg"), (F.col("s.seg") + F.shiftleft(F.col("s.k").cast("long"), 32)).alias("key"))
    table = segments.select(F.col("fp").alias("other"), "key")
    buckets = table.groupBy("key").agg(F.count("*").alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    probes = segments.select("fp", F.explode(ball_of_one()).alias("m"), "key").select("fp", (F.col("key") + F.col("m")).alias("key"))
    met = checkpoint(probes.join(buckets, "key").where("lo <> fp or hi <> fp").select("fp", "key", "n"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= BITS
    few = met.where(F.col("n") <= DENSE)
    pairs = few.join(table, (few["key"] == table["key"]) & (few["fp"] != table["other"]) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))

    many = met.where(F.col("n") > DENSE)
    keys = many.select("key").distinct()
    crowd = many.select("fp").unionByName(table.join(keys, "key", "left_semi").select(F.col("other").alias("fp"))).distinct()
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.sequence(i + 1, F.lit(63)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))))
    flips = F.concat(F.array(F.lit(0).cast("long")), one, two)
    points = crowd.select("fp", F.explode(flips).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"), (F.bit_count("m") <= 1).alias("close"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.max("fp").alias("last"), F.max("close").alias("any_close")).where("any_close and hub <> last").select("point", "hub")
    stars = points.join(hubs, "point").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return pairs.unionByName(stars.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component): for every row its fingerprint and the least id that links reach from it, itself included.

    Empty and null texts have fingerprint 0 and are linked like any other. Rows with equal ids and repeated rows each
    get a row. A null id is no candidate for the least id; a component without ids has a null component. An empty
    table gives no rows.
    """
    fps = checkpoint(fingerprints(docs, id_col, text, shingle))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("id").alias("first")))
    labels = components(links(distinct))
    merged = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = merged.groupBy("label").agg(F.min("first").alias("component"))
    of_fp = merged.join(least, "label").select("fp", "component")
    return fps.join(of_fp, "fp").select("id", "fp", "component")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs` without near-duplicates: of each component the document of the least id (then text hash) stays.

    Rows of equal id and text are one document and stay together. All columns stay.
    """
    one, two = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), one.alias("one"), two.alias("two")).alias("key"), F.col(text).alias("text"))
    kept = near_duplicates(keyed, "key", "text", shingle).where(F.col("id").eqNullSafe(F.col("component"))).select("id.*").withColumnsRenamed({"id": "_id", "one": "_one", "two": "_two"})
    own = docs.withColumns({"_own_one": one, "_own_two": two})
    same = (F.col("_own_one") == F.col("_one")) & (F.col("_own_two") == F.col("_two")) & F.col(id_col).eqNullSafe(F.col("_id"))
    return own.join(kept, same, "left_semi").drop("_own_one", "_own_two")


def mapped(rows: DataFrame, of: Callable[[str], np.ndarray], out: str) -> DataFrame:
    """(key, `out`: array<long>) of `rows` (key, text): `of` applied to every whole text.

    Results leave in batches of about FLUSH values, so a worker holds one input batch and little more.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, values, start, held = batch.column(0), batch.column(1), [], 0, 0
            for i in range(len(texts)):
                values.append(of(texts[i].as_py()))
                held += len(values[-1])
                if i + 1 == len(texts) or held >= FLUSH:
                    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(values)), lists], names=["key", out])
                    start, values, held = i + 1, [], 0

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField(out, T.ArrayType(T.LongType()))])
    return rows.select("key", "text").mapInArrow(run, schema)


def packed(cells: np.ndarray) -> bytes:
    """Sorted cells as compressed differences, one plane of bytes after the other (1 to 2 bytes a cell)."""
    steps = np.diff(cells, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def common_cells(texts: DataFrame, shingle: int, crowd: int = CROWD, most: int = COMMON) -> np.ndarray:
    """The sorted cells that more than `crowd` of all `texts` (key, text) have a shingle in, the `most` frequent of them.

    Every shingle of every text is counted in one of 2 ** CELL_BITS cells. Workers send their cells compressed, by
    ranges, so a range is a small part of all cells however many texts there are.
    """
    ship(texts.sparkSession)
    ranges = min(14, 1 + max(1, texts.rdd.getNumPartitions()).bit_length())
    width = CELL_BITS - ranges

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            part = cells >> np.uint32(width)
            at = [*np.flatnonzero(np.diff(part, prepend=part[0] + 1)), len(cells)]
            return pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int32)), pa.array([packed(cells[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["part", "cells"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(cells_of(np.unique(shingle_hashes(text, shingle))))
                n += len(held[-1])
                if n >= CELLS:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    def merge(rows: pa.Table) -> pa.Table:
        cells, n = np.unique(np.concatenate([unpacked(x) for x in rows.column("cells").to_pylist()]), return_counts=True)
        kept = n > crowd
        return pa.table({"cell": pa.array(cells[kept].astype(np.int64)), "n": pa.array(n[kept].astype(np.int64))})

    counted = checkpoint(texts.select("text").mapInArrow(count, "part int, cells binary").groupBy("part").applyInArrow(merge, "cell long, n long"))
    least = 0
    if counted.count() > most:
        size = F.floor(F.log2("n") * 8)
        over, left = counted.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect(), most
        for r in over:
            left -= r["count"]
            if left < 0:
                break
            least = r["size"]
        counted = counted.where(size >= least) if least else counted.limit(0)
    return np.sort(counted.select("cell").toArrow().column(0).to_numpy().astype(np.uint32))


def forest(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Edges between nodes of different labels that are alike: a spanning forest of all of them, labels taken as linked."""
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    counts = np.bincount(ids)
    first, ends, group, out = np.cumsum(counts) - counts, np.cumsum(sizes), np.unique(labels, return_inverse=True)[1], []
    for i in range(len(sets)):
        if (group == group[i]).all():
            break
        own = ids[ends[i] - sizes[i] : ends[i]]
        n = counts[own]
        shared = np.bincount(holders[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        alike = np.flatnonzero(shared / (sizes[i] + sizes - shared) >= similar)
        for j in alike[group[alike] != group[i]]:
            if group[j] != group[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                group[group == group[j]] = group[i]
    return out


def compared(dealt: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The edges (a, b) of `forest` for every cluster in every task of `dealt` (task, i, j, cluster, node, label), checkpointed."""

    def run(rows: pa.Table) -> pa.Table:
        rows, out = rows.combine_chunks().sort_by("cluster"), []
        cluster, nodes, labels = (rows.column(k).to_numpy() for k in ("cluster", "node", "label"))
        lists = rows.column("s").combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        starts = [*np.flatnonzero(np.diff(cluster, prepend=cluster[0] + 1)), len(cluster)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            out += forest(nodes[lo:hi], labels[lo:hi], [values[ends[k] : ends[k + 1]] for k in range(lo, hi)], similar)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return checkpoint(dealt.join(sets, "node").groupBy("task", "i", "j").applyInArrow(run, "a long, b long"))


def simhash_links(wide: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of `wide` (node, fp): equal fingerprints, and the links of multi-index hashing."""
    first = checkpoint(wide.groupBy("fp").agg(F.min("node").alias("first")))
    near = links(first.select("fp"))
    a, b = first.select(F.col("fp").alias("a"), F.col("first").alias("fa")), first.select(F.col("fp").alias("b"), F.col("first").alias("fb"))
    between = near.join(a, "a").join(b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    equal = wide.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return checkpoint(equal.unionByName(between))


def candidates(wide: DataFrame, similar: float) -> DataFrame:
    """Edges (a, b, crowd) whose components hold every pair of `wide` (node, key, label, size, prefix) that is alike but not of one label.

    Nodes that share a hash of up to CROWD nodes are counted in pairs: shared hashes, those of larger crowds, and all
    that lie beyond the prefix that ends first bound what the sets share. In a larger crowd each member is linked to
    the least one (crowd is true), as its pairs are compared later.
    """
    hashes = wide.select("node", F.explode("prefix").alias("hash"))
    met = hashes.withColumn("n", F.count("*").over(Window.partitionBy("hash"))).where("n > 1")
    met = checkpoint(met.join(wide.select("node", "label"), "node"))
    few, many = met.where(F.col("n") <= CROWD).select("hash", "node", "label"), met.where(F.col("n") > CROWD).select("hash", "node", "label")
    parted = many.groupBy("hash").agg(F.min("node").alias("b"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("hash", "b")
    many = checkpoint(many.join(parted, "hash").select("node", "b"))
    pairs = few.withColumnsRenamed({"node": "a", "label": "la"}).join(few.withColumnsRenamed({"node": "b", "label": "lb"}), "hash").where("a < b and la <> lb").groupBy("a", "b").agg(F.count("*").alias("n"))
    crowded = many.groupBy("node").agg(F.count("*").alias("crowded"))
    about = wide.join(crowded, "node", "left").select("node", F.struct("size", (F.col("size") - F.size("prefix")).alias("rest"), F.element_at("prefix", -1).alias("last"), F.coalesce("crowded", F.lit(0)).alias("crowded")).alias("x"))
    both = pairs.join(about.toDF("a", "xa"), "a").join(about.toDF("b", "xb"), "b").where(F.least("xa.size", "xb.size") >= F.greatest("xa.size", "xb.size") * similar - 1e-6)
    most = F.col("n") + F.least("xa.crowded", "xb.crowded") + F.when(F.col("xa.last") <= F.col("xb.last"), F.col("xa.rest")).otherwise(F.col("xb.rest"))
    pairs = both.where(most >= (F.col("xa.size") + F.col("xb.size")) * similar / (1 + similar) - 1e-6)
    stars = many.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return checkpoint(pairs.select("a", "b", F.lit(False).alias("crowd")).unionByName(stars.withColumn("crowd", F.lit(True))))


def of_nodes(texts: DataFrame, nodes: DataFrame, of: Callable[[str], np.ndarray], out: str) -> DataFrame:
    """(node, `out`) of `nodes` (node, key): `of` applied to the text of the key, checkpointed."""
    wanted = checkpoint(nodes.select(F.col("key").alias("_key")))
    read = texts.join(size_checked(wanted, wanted.count()), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    return checkpoint(mapped(read, of, out).select(F.col("key.node").alias("node"), out).dropDuplicates(["node"]))


def similar_links(texts: DataFrame, wide: DataFrame, shingle: int = 5, similar: float = SIMILAR) -> DataFrame:
    """Edges (a, b) between nodes of `wide` (node, key, label, size, prefix) of different labels whose sets of word shingles have a Jaccard similarity of `similar` or more.

    With the labels, their components are those of all such pairs. `texts` (key, text) has the text of every node's
    key. Clusters of up to a block are compared in one task, many of them together. A larger one is dealt into blocks,
    each of which is compared with itself and the member that most crowds have in common (the original of a crowd of
    copies); then every two blocks are, but for those of one and the same group.
    """
    edges = candidates(wide, similar)
    clusters = components(edges).withColumnRenamed("label", "cluster")
    crowds = edges.where("crowd").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    members = checkpoint(clusters.join(wide.select("node", "key", "label", "size"), "node").join(crowds, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    sets = of_nodes(texts, members, lambda t: shingle_set(t, shingle), "s")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / VALUES)).alias("blocks")
    sizes = members.groupBy("cluster").agg(blocks, F.max_by("node", F.struct("degree", "node")).alias("hub"))
    bins = 1 + (members.agg(F.sum("size")).first()[0] or 0) // VALUES
    placed = checkpoint(members.join(sizes, "cluster").select("cluster", "node", "label", "size", "blocks", "hub", F.pmod(F.xxhash64("node"), "blocks").alias("i")))
    small, large = placed.where("blocks = 1"), placed.where("blocks > 1")
    own = small.select(F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("task"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "cluster", "node", "label")
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    hubs = large.where("node = hub").select("cluster", "node", "label", "i", F.explode(every).alias("at")).where("at <> i").select("cluster", "node", "label", F.col("at").alias("i"))
    within = large.select("cluster", "node", "label", "i").unionByName(hubs).select(F.col("cluster").alias("task"), "i", F.col("i").alias("j"), "cluster", "node", "label")
    found = compared(own.unionByName(within), sets, similar)
    if large.isEmpty():
        return found
    return found.unionByName(between_blocks(large, found, sets, similar))


def between_blocks(large: DataFrame, found: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Edges (a, b) between different groups of each cluster of `large` (cluster, node, label, size), all pairs of blocks compared.

    A group is what labels and the links `found` so far connect. Groups of a block and more have blocks of their own,
    which aren't compared with each other; smaller groups share blocks.
    """
    known = large.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
    there = large.select(F.col("node").alias("a"))
    groups = components(known.unionByName(found.join(there, "a", "left_semi")))
    grouped = checkpoint(large.select("cluster", "node", "label", "size").join(groups.withColumnRenamed("label", "group"), "node", "left").withColumn("group", F.coalesce("group", "label")))
    held = grouped.groupBy("cluster", "group").agg(F.count("*").alias("n"), F.sum("size").alias("values"))
    alone = (F.col("n") >= BLOCK) | (F.col("values") >= VALUES)
    parts = checkpoint(held.withColumn("part", F.when(alone, F.col("group"))).groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("values").alias("values"), F.count("*").alias("groups")))
    # (cluster, part, k): the blocks of each cluster; part is null where groups share them
    blocks = parts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("values") / VALUES)) - 1))).select("cluster", "part", "k", F.xxhash64("part", "k").alias("block"))
    left, right = blocks.toDF("cluster", "p", "k", "i"), blocks.toDF("cluster", "q", "l", "j")
    pairs = left.join(right, "cluster").where("i < j and not (p is not null and q is not null and p = q) or i = j and p is null").select("cluster", "i", "j")
    ends = pairs.select("cluster", F.col("i").alias("block"), "i", "j").unionByName(pairs.where("i <> j").select("cluster", F.col("j").alias("block"), "i", "j"))
    whole = parts.select("cluster", F.col("part").alias("_part"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("values") / VALUES)).alias("of")).withColumnRenamed("cluster", "_cluster")
    own = grouped.join(held.select("cluster", "group", F.when(alone, F.col("group")).alias("part")), ["cluster", "group"])
    own = own.join(whole, (F.col("cluster") == F.col("_cluster")) & F.col("part").eqNullSafe(F.col("_part"))).select("cluster", "node", "group", F.xxhash64("part", F.pmod(F.xxhash64("node"), "of")).alias("block"))
    dealt = own.join(ends, ["cluster", "block"]).select(F.col("cluster").alias("task"), "i", "j", "cluster", "node", F.col("group").alias("label"))
    return compared(dealt, sets, similar)


def similar_representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similar: float = SIMILAR) -> DataFrame:
    """`docs` with one document of each group of near copies, that of the least id (then text hash).

    Groups are components of the links of `simhash_links` and `similar_links`. Texts are known by a 64-bit hash. Null
    texts and texts without words are alike. Rows of equal id and text are one document and stay together; null ids
    count as least. All columns stay, also such as `node` or `label`. An empty table gives no rows. Whole texts are
    hashed twice (to count cells, then for prefixes), those with candidates a third time; they are shuffled only where
    more documents have candidates, or go, than a broadcast takes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(body).alias("node"))
    texts = docs.select(key.alias("key"), body.alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_cells(texts, shingle))
    read = mapped(texts, lambda t: prefix(t, shingle, similar, common.value), "x")
    wide = read.groupBy(F.col("key.node").alias("node")).agg(F.min("key").alias("key"), F.min("x").alias("x"))
    wide = checkpoint(wide.select("node", "key", F.col("x")[0].alias("size"), F.col("x")[1].alias("fp"), F.slice("x", 3, F.size("x") - 2).alias("prefix")))
    near = simhash_links(wide)
    labels = components(near)
    labelled = wide.join(labels, "node", "left").select("node", "key", F.coalesce("label", "node").alias("label"), "size", "prefix")
    found = similar_links(texts, labelled, shingle, similar)
    groups = components(near.unionByName(found))
    merged = wide.select("node", "key").join(groups, "node", "left").select("node", "key", F.coalesce("label", "node").alias("label"))
    kept = merged.groupBy("label").agg(F.min("key").alias("kept"))
    of_node = merged.join(kept, "label").select("node", "kept")
    rows = docs.select(key.alias("key")).withColumn("node", F.col("key.node"))
    gone = checkpoint(rows.join(of_node, "node").where(~F.col("key").eqNullSafe(F.col("kept"))).select(F.col("key.id").alias("_id"), F.col("key.node").alias("_node")).distinct())
    marked = docs.withColumn("_own_node", F.xxhash64(body))
    match = (F.col("_own_node") == F.col("_node")) & F.col(id_col).eqNullSafe(F.col("_id"))
    return marked.join(size_checked(gone, gone.count()), match, "left_anti").drop("_own_node")
