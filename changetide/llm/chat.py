"""Chat formatting with one example for each assistant turn.

A turn is written as <|role|>text<|end|>; control strings inside roles and texts are broken up by a
backslash, and backslashes are doubled, so the writing can be undone. The example of an assistant turn
is the text of all turns before it, its context, followed by its reply; only the reply is under the loss
mask. Turns after the last reply, or of a conversation without one, are in no example; they are kept as a
row of their own without example number and mask, so that everything can be read back.

Turns are ordered by turn, then role and text, nulls first. A null text or role is empty. Repeated
rows are turns of their own. A null conversation id is a conversation. Everything is DataFrame
functions. The last example of a conversation is as long as all of it, so a conversation is a row by the
method itself, below 2 GB, and its examples grow with the square of its turns. Conversations with many
replies are dealt to several tasks, each of which writes a block of the examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetide.llm.scratch import stored

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
# Control strings of other templates, which are broken up as well.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CONTROL = r"[<|\[](?=(?<=<)\||(?<=\|)>|(?<=<)/?s>|(?<=\[)/?INST\]|(?<=<)</?SYS>>)"
TARGET = "assistant"
#: Examples of one conversation that one task writes.
BLOCK = 64


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expanded(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last) from (conv_id, turn, role, text).

    example counts from 0; text: the context and the reply, written out; loss_start, loss_end: the reply
    within text, in code points; last: no later example of the conversation holds more. Turns after the
    last reply are a row whose example, loss_start and loss_end are null."""
    body = escaped(F.col("text"))
    turn = F.struct(
        "turn",
        "role",
        "text",
        F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE), body, F.lit(END)).alias("segment"),
        F.char_length(body).alias("size"),
    )
    rows = conversations.select("conv_id", "turn", "role", "text")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    replies = F.filter(
        F.transform("turns", lambda t, i: F.when(t["role"] == TARGET, i + 1)), lambda place: place.isNotNull()
    )
    whole = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["segment"]).alias("segments"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
        replies.alias("replies"),
    )
    # so many rows as there are blocks of examples; one at least, for the turns after the last reply
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size("replies") - 1, F.lit(0)) / BLOCK).cast("int"))
    whole = whole.withColumn("block", F.explode(blocks))
    whole = whole.repartition("conv_id", "block")
    own = F.slice("replies", F.col("block") * BLOCK + 1, F.lit(BLOCK))
    end = F.coalesce(F.array_max("replies"), F.lit(0))
    rest = F.array(F.struct(F.lit(None).cast("int").alias("example"), end.alias("place")))
    after = F.when((F.col("block") == 0) & (end < F.size("segments")), rest)
    numbered = F.transform(
        own, lambda p, i: F.struct((i + F.col("block") * BLOCK).cast("int").alias("example"), p.alias("place"))
    )
    entries = F.concat(numbered, F.coalesce(after, F.array().cast("array<struct<example:int,place:int>>")))
    laid = whole.select("conv_id", "segments", "sizes", end.alias("end"), F.inline(entries))
    is_example = F.col("example").isNotNull()
    joined = F.array_join(
        F.when(is_example, F.slice("segments", 1, F.col("place"))).otherwise(
            F.slice("segments", F.col("place") + 1, F.size("segments") - F.col("place"))
        ),
        "",
    )
    laid = laid.withColumn("text", joined)
    loss_end = F.when(is_example, F.char_length("text") - len(END)).cast("long")
    return laid.select(
        "conv_id",
        "example",
        "text",
        (loss_end - F.get("sizes", F.col("place") - 1)).alias("loss_start"),
        loss_end.alias("loss_end"),
        (is_example & (F.col("place") == F.col("end"))).alias("last"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples: n_turns and a digest of all turns, size and digest of what
    is under the loss mask, and the code points of all its examples."""
    is_example = F.col("example").isNotNull()
    masked = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = examples.select(
        "conv_id",
        F.struct(
            F.coalesce("example", F.lit(2**31 - 1)).alias("example"),  # the turns after the last reply come last
            F.when(is_example, unescaped(masked)).otherwise("").alias("loss"),
            F.when(F.col("last") | ~is_example, F.col("text")).otherwise("").alias("row"),
        ).alias("e"),
        F.when(is_example, F.char_length("text")).otherwise(0).cast("long").alias("chars"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("e")).alias("es"), F.sum("chars").alias("formatted_chars"))
    grouped = grouped.select(
        "conv_id",
        "formatted_chars",
        F.array_join(F.transform("es", lambda e: e["row"]), "").alias("whole"),
        F.array_join(F.transform("es", lambda e: e["loss"]), "").alias("loss"),
    )
    turns = F.split("whole", r"<\|end\|>", -1)
    grouped = grouped.withColumn("turns", F.slice(turns, 1, F.size(turns) - 1))
    shape = r"(?s)^<\|(.*?)\|>(.*)$"
    read = F.transform(
        "turns",
        lambda t: F.concat(
            unescaped(F.regexp_extract(t, shape, 1)), F.lit("\n"), unescaped(F.regexp_extract(t, shape, 2)), F.lit("\n")
        ),
    )
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(read, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """Write all examples, store them, and read them back."""
    return read_back(stored(expanded(conversations)))
