"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn (ties by role, then text); runs of
turns by one role are merged into one block that holds the texts as segments; blocks are concatenated:

    ### role ###
    text<seg>text</turn>

In roles and texts the signs that the template uses are replaced, reversibly: backslash, < and # become
\\s, \\l and \\h, so the template's own marks cannot occur inside them. The loss mask has one flag per block,
true for the assistant's.

Cases: null texts and roles are empty; a null turn sorts first; a null conversation id is a conversation;
repeated rows are repeated turns; an empty table gives no rows; other columns are not looked at. A
conversation is one output string, so its turns meet in one task, with only the turn, role and text of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks, and the signs they are made of with their replacements.
OPEN, HEAD_END, SEGMENT, CLOSE = "### ", " ###\n", "<seg>", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"))
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted (the whole conversation), loss_mask (a flag per block)."""
    one = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    places = F.sequence(F.lit(1), F.size("turns"))
    role = lambda i: F.element_at("turns", i)["role"]
    # first places of the runs of one role, with the place after the last as end
    starts = F.filter(places, lambda i: (i == 1) | (role(i) != role(F.greatest(i - 1, F.lit(1)))))
    runs = grouped.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("turns") + 1)))

    def block(start: Column, end: Column) -> Column:
        texts = F.transform(F.slice("turns", start, end - start), lambda t: escape(t["text"]))
        return F.concat(F.lit(OPEN), escape(role(start)), F.lit(HEAD_END), F.array_join(texts, SEGMENT), F.lit(CLOSE))

    return runs.select(
        "conv_id",
        F.array_join(F.zip_with("starts", "ends", block), "").alias("formatted"),
        F.transform("starts", lambda i: role(i) == loss_role).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add turns (array of role, text) and loss_text, both read from the formatted string and its mask."""
    whole = F.split(F.col("formatted"), CLOSE)
    blocks = F.slice(whole, 1, F.size(whole) - 1)
    parts = F.transform(blocks, lambda b: F.split(b, HEAD_END, 2))
    cut = F.transform(parts, lambda p: F.struct(unescape(F.substring(p[0], len(OPEN) + 1, 2**30)).alias("role"), F.split(p[1], SEGMENT).alias("segments")))
    rows = formatted.withColumn("__blocks", cut)
    turns = F.flatten(F.transform("__blocks", lambda b: F.transform(b["segments"], lambda s: F.struct(b["role"].alias("role"), unescape(s).alias("text")))))
    masked = F.filter("__blocks", lambda b, i: F.element_at("loss_mask", i + 1))
    loss = F.array_join(F.flatten(F.transform(masked, lambda b: F.transform(b["segments"], unescape))), "")
    return rows.withColumn("turns", turns).withColumn("loss_text", loss).drop("__blocks")


def digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what was read back."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
