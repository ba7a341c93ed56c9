"""Chat formatting: sorted turns become one marked string, and the string reads back without loss.

The template of a conversation is a sequence of blocks, one for each run of adjacent turns of one role::

    <turn ROLE|>TEXT<part>TEXT</turn>\\n

`<part>` stands between turns that were merged into a block. Control strings all begin with `<`, and an escaped
text has no `<`: a backslash becomes `\\b`, `<` becomes `\\l` and, in roles, `|` becomes `\\p`. Every backslash of an
escaped text therefore begins an escape, and replacing `\\l` and then `\\b` restores the text.

Everything is a Spark expression. Rows are escaped before they are collected, and a conversation is collected whole:
its result is one string, so its size is that of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.dna import running

OPEN, CLOSE, PART, BAR = "<turn ", "</turn>", "<part>", "|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, `formatted`, `loss_mask`.

    loss_mask is an array of (start, end) in code points of `formatted`, end exclusive, of the texts of `loss_role`.

    Turns are sorted by turn, then role, then text; a null turn sorts first. Null texts and roles are empty. Rows of a
    null conversation form one conversation. Repeated rows are turns of their own. An empty table gives no rows.
    """
    made = rows.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            escape_role(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("x"),
    )
    turns = made.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        """Marks before the turn, and its text: a turn of the same role as the one before it joins that block."""
        before = F.get(F.col("turns"), i - 1)
        opened = F.concat(F.lit(OPEN), x["role"], F.lit(BAR))
        mark = F.when(i == 0, opened).when(before["role"] == x["role"], F.lit(PART)).otherwise(F.concat(F.lit(f"{CLOSE}\n"), opened))
        return F.struct(mark.alias("mark"), x["text"].alias("text"), (x["role"] == escape_role(F.lit(loss_role))).alias("loss"))

    merged = turns.select("conv", F.transform("turns", piece).alias("pieces"))
    whole = merged.select(
        "conv",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(f"{CLOSE}\n")).alias("formatted"),
        F.transform("pieces", lambda p: F.struct(F.length(p["mark"]).alias("m"), F.length(p["text"]).alias("n"), p["loss"].alias("loss"))).alias("lengths"),
    )
    # starts of the pieces are running sums of their lengths
    starts = running(F.transform("lengths", lambda p: p["m"] + p["n"]))
    spans = F.zip_with("lengths", starts, lambda p, at: F.struct((at + p["m"]).alias("start"), (at + p["m"] + p["n"]).alias("end"), p["loss"].alias("loss")))
    mask = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return whole.select(F.col("conv").alias(conv), "formatted", mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role:string, text:string>> of a formatted conversation, one per original turn."""
    blocks = F.split(formatted, f"{CLOSE}\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, BAR, 1)
        body = F.substr(block, F.length(head) + F.lit(len(BAR) + 1))
        who = unescape_role(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(body, PART, -1), lambda t: F.struct(who.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda x: unescape(F.substr(formatted, x["start"] + 1, x["end"] - x["start"]))), "")
