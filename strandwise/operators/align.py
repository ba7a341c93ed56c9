"""Alignment records: operation walks, consensus, differences to it, mates and the way back to reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import dna

#: Codes of alignment operations: a fixed value of the format. M I D N S H P = X.
M, I, D, N, S, H, P, EQ, X = range(9)
GAP = 50_000


def walk(records: DataFrame) -> DataFrame:
    """(ord, ref_id, op, query_pos, ref_pos, base, nibble): one row per base of a record that has operations.

    Bases of M, = and X have a reference position; those of I and S have none. Records without operations, and
    unmapped ones, have no rows.
    """
    length = lambda *kinds: dna.running(F.transform("cigar", lambda o: F.when(o["op"].isin(*kinds), o["len"]).otherwise(0)))
    ops = records.where("ref_id >= 0").select("ord", "ref_id", "pos", "seq", F.explode(F.arrays_zip(F.col("cigar").alias("o"), length(M, I, S, EQ, X).alias("q"), length(M, D, N, EQ, X).alias("r"))).alias("x"))
    placed = ops.select("ord", "ref_id", "seq", F.col("x.o.op").alias("op"), F.col("x.o.len").alias("n"), F.col("x.q").cast("long").alias("q0"), (F.col("pos") + F.col("x.r")).alias("r0")).where(F.col("op").isin(M, I, S, EQ, X) & (F.col("n") > 0))
    steps = placed.select("ord", "ref_id", "seq", "op", "q0", "r0", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    base = F.substr("seq", (F.col("q0") + F.col("i") + 1).cast("int"), F.lit(1))
    rows = steps.select("ord", "ref_id", "op", (F.col("q0") + F.col("i")).alias("query_pos"), F.when(F.col("op").isin(M, EQ, X), F.col("r0") + F.col("i")).alias("ref_pos"), base.alias("base")).where("base != ''")
    return rows.withColumn("nibble", nibble(F.col("base")))


def nibble(base: Column) -> Column:
    """4-bit code of a base; letters outside the table are N (15)."""
    at = F.call_function("instr", F.lit(dna.NIBBLES), base)
    return F.when(at > 0, at - 1).otherwise(15)


def consensus(steps: DataFrame) -> DataFrame:
    """(ref_id, ref_pos, nibble, n): the most frequent code at each covered position; ties go to the lower, 0 never wins."""
    counted = steps.where("ref_pos is not null and nibble > 0").groupBy("ref_id", "ref_pos", "nibble").agg(F.count("*").alias("n"))
    return most(counted)


def most(counted: DataFrame) -> DataFrame:
    """(ref_id, ref_pos, nibble, n): of counted codes the most frequent at each position, the lower of equals."""
    best = counted.groupBy("ref_id", "ref_pos").agg(F.max(F.struct("n", (-F.col("nibble")).alias("minus"))).alias("x"))
    return best.select("ref_id", "ref_pos", (-F.col("x.minus")).alias("nibble"), "x.n")


def segments(records: DataFrame, gap: int = GAP) -> DataFrame:
    """(ref_id, segment, first, last, n): runs of records where each begins within `gap` of what is covered so far."""
    span = F.aggregate("cigar", F.lit(0), lambda a, o: a + F.when(o["op"].isin(M, D, N, EQ, X), o["len"]).otherwise(0))
    own = records.where("ref_id >= 0 and size(cigar) > 0").select("ord", "ref_id", "pos", (F.col("pos") + span).alias("end"))
    # equal intervals are one before they meet in a window, so its rows don't grow with the depth
    own = own.groupBy("ref_id", "pos", "end").agg(F.count("*").alias("n"))
    by = Window.partitionBy("ref_id").orderBy("pos", "end")
    far = F.coalesce(F.col("pos") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)) + gap, F.lit(False))
    numbered = own.withColumn("far", far.cast("int")).withColumn("segment", F.sum("far").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("ref_id", "segment").agg(F.min("pos").alias("first"), F.max("end").alias("last"), F.sum("n").alias("n"))


def differences(steps: DataFrame, votes: DataFrame) -> DataFrame:
    """`steps` with `vote` and `diff`: the code XOR the consensus where aligned, the code itself in insertions and clips.

    Only aligned bases are joined; the others have no position, and so one key for all of a reference.
    """
    aligned = steps.where("ref_pos is not null").join(votes.select("ref_id", "ref_pos", F.col("nibble").alias("vote")), ["ref_id", "ref_pos"], "left")
    rest = steps.where("ref_pos is null").withColumn("vote", F.lit(None).cast(votes.schema["nibble"].dataType))
    return aligned.unionByName(rest).withColumn("diff", F.col("nibble").bitwiseXOR(F.coalesce("vote", F.lit(0))))


def rebuild(differences: DataFrame) -> DataFrame:
    """(ord, seq): the aligned, inserted and clipped bases of each record from `vote` and `diff`, in order."""
    code = F.when(F.col("ref_pos").isNotNull(), F.col("diff").bitwiseXOR(F.coalesce("vote", F.lit(0)))).otherwise(F.col("diff"))
    base = F.substr(F.lit(dna.NIBBLES), code.cast("int") + 1, F.lit(1))
    back = differences.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("query_pos", base.alias("base")))).alias("v"))
    return back.select("ord", F.array_join(F.transform("v", lambda x: x["base"]), "").alias("seq"))


def mates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (name, ord1, ord2) and the ord of records left single. Secondary and supplementary records are skipped.

    Of several records in one slot of a name the last by ord counts.
    """
    own = records.where("(flag & 2304) = 0")
    paired = own.where("(flag & 1) = 1 and (flag & 192) in (64, 128)")
    slots = paired.groupBy("name").agg(F.max(F.when(F.col("flag").bitwiseAND(64) > 0, F.col("ord"))).alias("ord1"), F.max(F.when(F.col("flag").bitwiseAND(128) > 0, F.col("ord"))).alias("ord2"))
    pairs = slots.where("ord1 is not null and ord2 is not null")
    single = own.where("not ((flag & 1) = 1 and (flag & 192) in (64, 128))").select("ord").unionByName(slots.where("ord1 is null or ord2 is null").select(F.coalesce("ord1", "ord2").alias("ord")))
    return pairs, single


def to_reads(records: DataFrame) -> DataFrame:
    """(ord, id, seq, qual) of records; those of the reverse strand are complemented and reversed."""
    back = F.col("flag").bitwiseAND(16) > 0
    return records.select("ord", F.concat(F.lit("@"), "name").alias("id"), F.when(back, F.reverse(F.translate("seq", dna.NIBBLES, dna.NIBBLE_COMPLEMENTS))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def deltas(records: DataFrame, by: str = "chunk") -> DataFrame:
    """`records` with d_ref and d_pos to the record before in (ref_id, pos, ord) order of its chunk.

    The first record and the first of a reference have the position itself.
    """
    w = Window.partitionBy(by).orderBy("ref_id", "pos", "ord")
    last_ref, last_pos = F.lag("ref_id", 1, 0).over(w), F.lag("pos", 1, 0).over(w)
    return records.withColumns({"d_ref": F.col("ref_id") - last_ref, "d_pos": F.when(F.col("ref_id") == last_ref, F.col("pos") - last_pos).otherwise(F.col("pos"))})


def undo_deltas(deltas: DataFrame, by: str = "chunk") -> DataFrame:
    """`deltas` with back_ref and back_pos, running sums that restart where the reference changes."""
    w = Window.partitionBy(by).orderBy("ref_id", "pos", "ord")
    numbered = deltas.withColumn("back_ref", F.sum("d_ref").over(w)).withColumn("island", F.sum(F.when(F.col("d_ref") != 0, 1).otherwise(0)).over(w))
    return numbered.withColumn("back_pos", F.sum("d_pos").over(Window.partitionBy(by, "island").orderBy("ref_id", "pos", "ord")))
