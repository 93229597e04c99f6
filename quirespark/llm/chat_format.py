r"""Chat formatting: conversations as training examples by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are the context, its reply alone is trainable.
A conversation that does not end in an assistant turn gets one more example without anything trainable, so that the
output holds every turn and can be read back.

A turn is written as <|start|>role<|message|>text<|end|>. Control strings inside roles and texts, those of this template
and of common others, get a backslash behind their first character; one that has backslashes there already gets one more.
So no text holds a control string afterwards, and taking one backslash away restores it exactly.

Edge cases: null texts and roles are empty; turns go by turn, role and text, nulls first, so ties and repeated rows are
kept in a settled order; a null conv_id is a conversation of its own; an empty table gives no rows; other columns never
matter. The examples of a conversation repeat its earlier turns, so their size grows with the square of its turns, one
row at a time: only the last example of a conversation, which holds all of it, and the replies are ever shuffled or kept
together. A conversation has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks.
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: What makes a control string of `<` or `[`: the marks of this template and of others. None has `<` or `[` inside, so
#: control strings never overlap.
TAILS = r"\|\w{1,40}\|>|/?s>|/?INST\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*+)(?={TAILS})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*+)(?={TAILS})", "$1$2")


def chat_examples(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, place, text, loss_start, loss_chars, whole) from (conv_id, turn, role, text).

    `place` is the target's place among its conversation's turns, from 0. The loss mask covers loss_chars code points of
    text from loss_start, counted from 0. `whole` marks the example that holds all turns.
    """
    or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.struct(F.col("turn").cast("long").alias("turn"), or_empty("role").alias("role"), or_empty("text").alias("text"))
    by_conversation = turns.select(F.col("conv_id").cast("long").alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    opened = lambda s: F.concat(F.lit(START), escaped(s["role"]), F.lit(MESSAGE))
    marked = F.transform("said", lambda s: F.struct(s["role"].alias("role"), opened(s).alias("opening"), escaped(s["text"]).alias("body")))
    shown = by_conversation.select("conv_id", marked.alias("said"))
    # the generator keeps the array, so a target's row has its context at hand without a join
    targets = shown.select("conv_id", "said", F.posexplode("said").alias("place", "own")).withColumn("whole", F.col("place") == F.size("said") - 1)
    targets = targets.where((F.col("own.role") == "assistant") | F.col("whole"))
    context = F.array_join(F.transform(F.slice("said", F.lit(1), F.col("place")), lambda s: F.concat(s["opening"], s["body"], F.lit(END))), "")
    begun = targets.select("conv_id", "place", "own", "whole", F.concat(context, F.col("own.opening")).alias("begun"))
    trained = F.col("own.role") == "assistant"
    return begun.select(
        "conv_id", F.col("place").cast("long").alias("place"), F.concat("begun", "own.body", F.lit(END)).alias("text"), F.length("begun").cast("long").alias("loss_start"),
        F.when(trained, F.length("own.body")).otherwise(0).cast("long").alias("loss_chars"), "whole",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples' text and masks alone: (conv_id, turns, losses, formatted_chars).

    `turns` are (role, text) in order, `losses` the unescaped texts under the masks of the trainable examples in order.
    """
    loss = F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))
    row = F.struct(
        F.when(F.col("whole"), F.col("text")).alias("all"), F.length("text").cast("long").alias("chars"),
        F.struct("place", unescaped(loss).alias("text")).alias("loss"),
    )
    # through a generator of one element, behind which only these short columns are left to sort and group
    short = examples.select("conv_id", F.inline(F.array(row)))
    merged = short.groupBy("conv_id").agg(F.collect_list("all").alias("all"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("loss")).alias("losses"))
    written = F.filter(F.split(F.element_at("all", 1), r"<\|end\|>"), lambda t: t != "")
    parts = F.transform(written, lambda t: F.split(F.substring(t, len(START) + 1, 2**31 - 1), r"<\|message\|>", 2))
    turns = F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))
    return merged.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: x["text"]).alias("losses"), "formatted_chars")


def digests(read: DataFrame) -> DataFrame:
    """What a conversation's turns and trained texts come to, from read_back's rows."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = read.select("*", F.array_join("losses", "").alias("trained"))
    return trained.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )
