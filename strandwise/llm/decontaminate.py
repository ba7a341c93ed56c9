"""Benchmark decontamination with spaced seeds.

A mask is a row of kept and ignored word positions. The kept words at every position of every text are hashed and join
the same hashes of the benchmark items, so a changed word at an ignored position does not hide a passage. Each hit
gives a place where the item would lie in the text; there the words are compared one to one, and the place counts if
some WINDOW consecutive words of the item (all, if it has fewer) agree in SIMILAR or more.

Items of a window or more use MASKS. A shorter one uses the masks that `short_masks` finds for its length: every choice
of changed words that SIMILAR allows leaves a seed, so no changed copy of it is missed. For a window of 13 words 77 of
the 78 choices of two changed words leave a seed.

The benchmark's seeds and words are counted and broadcast up to a limit; beyond it both sides are shuffled. The places
found are few, and the texts are read again for them alone. Everything is a DataFrame expression.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import checkpoint, size_checked, words

#: Kept (1) and ignored (0) words, for items of WINDOW words or more.
MASKS = ("110101101", "101100111")
#: Words that are compared, the share that agrees, the most masks for one length, and the words from which on an item
#: counts within a longer text; a shorter one counts only where it is the whole text.
WINDOW, SIMILAR, FEW, LEAST_WORDS = 13, 0.8, 4, 5


@lru_cache
def short_masks(n: int, similar: float = SIMILAR, few: int = FEW) -> tuple[str, ...]:
    """Masks that leave a seed for every choice of changed words of an item of `n` words that `similar` allows.

    They keep as many words as `few` masks can; each next mask is the one that covers most of what is left.
    """
    changed = [set(c) for c in combinations(range(n), n - ceil(similar * n - 1e-9))]
    for weight in range(n, 0, -1):
        # the words that are kept, from the mask's first to its last
        kept = {tuple(x - c[0] for x in c) for c in combinations(range(n), weight)}
        covers = {k: {i for i, c in enumerate(changed) if any(c.isdisjoint(at + x for x in k) for at in range(n - k[-1]))} for k in sorted(kept)}
        left, chosen = set(range(len(changed))), []
        while left and len(chosen) < few:
            chosen.append(max(covers, key=lambda k: (len(covers[k] & left), [-x for x in k])))
            left -= covers[chosen[-1]]
        if not left:
            return tuple("".join("1" if x in k else "0" for x in range(k[-1] + 1)) for k in chosen)
    return ()


def seeds(hashes: Column, mask: str) -> Column:
    """array<struct<pos, seed>> of the masked word hashes at every position."""
    kept = [k for k, c in enumerate(mask) if c == "1"]
    starts = F.when(F.size(hashes) >= len(mask), F.sequence(F.lit(0), F.size(hashes) - len(mask)))
    every = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(mask), *[F.get(hashes, i + k) for k in kept]).alias("seed")))
    return F.coalesce(every, F.expr("cast(array() as array<struct<pos:int, seed:bigint>>)"))


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similar: float = SIMILAR) -> tuple[DataFrame, tuple[str, ...]]:
    """(item, ipos, seed) of `items` (item, w), and all masks that the texts need."""
    short = sorted(r["n"] for r in items.select(F.size("w").alias("n")).where(f"n > 0 and n < {window}").distinct().collect())
    own = items.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    long = own.where(F.size("w") >= window).select("item", F.explode(F.concat(*[seeds(F.col("h"), m) for m in masks])).alias("s"))
    used = list(masks)
    for n in short:  # fewer than `window` lengths
        of_n = short_masks(n, similar)
        long = long.unionByName(own.where(F.size("w") == n).select("item", F.explode(F.concat(*[seeds(F.col("h"), m) for m in of_n])).alias("s")))
        used += of_n
    return long.select("item", F.col("s.pos").alias("ipos"), "s.seed"), tuple(dict.fromkeys(used))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, similar: float = SIMILAR) -> DataFrame:
    """(id, item, first_word, n_words, n_equal, score): the best place of each item in each document that has one.

    first_word is where the item's first word lies (negative if the text begins inside the item), n_equal the words
    that agree over all n_words of the item, score the best share within the window. Words are runs of letters and
    digits in lower case. Null and empty texts and items have no words and no hit; an item of fewer than LEAST_WORDS
    words hits only a text that has no other words. Rows with a null id can't be named and are left out. Rows of one id
    are one document, repeated rows too. Ties go to the least first_word. Other columns of `docs` are not read, so
    their names don't matter. Empty tables give no rows.
    """
    items = checkpoint(benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text)).alias("w")).where("item is not null and size(w) > 0").distinct())
    (many,) = items.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("n")).collect()
    bench, used = benchmark_seeds(items, masks, window, similar)
    bench = checkpoint(bench.join(size_checked(items.select("item", F.size("w").alias("n")), many.n), "item").distinct())
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("h"))
    rolling = texts.select("id", F.explode(F.concat(*[seeds(F.col("h"), m) for m in used])).alias("s")).select("id", F.col("s.pos").alias("pos"), "s.seed")
    hits = checkpoint(rolling.join(size_checked(bench, bench.count()), "seed").select("id", "item", "n", (F.col("pos") - F.col("ipos")).alias("at")).distinct())
    # a document's places are numbers, no more than its words times the items that begin with one seed
    places = hits.groupBy("id").agg(F.collect_list(F.struct("item", "at", "n")).alias("places"))
    found = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(size_checked(places, hits.count()), "id")
    read = found.select("id", words(F.col("t")).alias("own"), "places").select("id", F.size("own").alias("words"), F.explode(F.transform("places", lambda p: F.struct(p["item"].alias("item"), p["at"].alias("at"), F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda j: F.get(F.col("own"), p["at"] + j)).alias("there")))).alias("p"))
    # items of one id may have several texts
    both = read.select("id", "words", "p.*").join(size_checked(items, many.n), "item").where(F.size("w") == F.size("there"))
    scored = both.where((F.size("w") >= LEAST_WORDS) | (F.size("w") == F.col("words"))).select("id", "item", "at", F.size("w").alias("n_words"), F.zip_with("w", "there", lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))).alias("equal"))
    width = F.least(F.lit(window), F.size("equal"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("equal") - width), lambda k: F.aggregate(F.slice(F.col("equal"), k + 1, width), F.lit(0), lambda a, b: a + b))) / width
    scored = scored.select("id", "item", F.col("at").alias("first_word"), "n_words", F.aggregate("equal", F.lit(0), lambda a, b: a + b).alias("n_equal"), best.alias("score"))
    one = F.max(F.struct("score", "n_equal", (-F.col("first_word")).alias("minus"), "n_words")).alias("x")
    return scored.where(F.col("score") >= similar).groupBy("id", "item").agg(one).select("id", "item", (-F.col("x.minus")).alias("first_word"), "x.n_words", "x.n_equal", "x.score")
