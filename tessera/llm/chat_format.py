"""Chat formatting: one training example for each assistant turn, with DataFrame functions only.

A turn is written as

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

An example holds all turns up to and including one assistant turn; the loss mask
covers only the text of that turn, as a span of code points. A conversation whose
last turn is not the assistant's gets one more example with an empty mask, so that
no turn is lost.

Control strings inside roles and texts are escaped reversibly: a backslash is
doubled, `<|` becomes `<\\|`, and in roles a newline becomes `\\n`. So `<|` occurs in
the output only where the template writes it.

Null text and null roles count as empty; turns are ordered by turn (nulls first),
then role and text, so repeated turns all stay. Rows of a null conv_id form one
conversation. Empty input gives no examples. Other columns are not read.

A conversation is one record here: its prefixes are its output, so its size bounds
what one task holds. Conversations are spread by id; many conversations with the
same texts are not a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undoes escape and escape_role: pairs of backslashes are cut out first, then single ones mean their escapes."""
    plain = lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_chat(conversations: DataFrame) -> DataFrame:
    """Examples (conv_id, example, n_turns, text, loss_begin, loss_end): the mask is [loss_begin, loss_end) of text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    body = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))
    last = F.size("turns")
    talks = talks.select("conv_id", "turns", F.transform("turns", body).alias("parts"))
    talks = talks.withColumn("ends", F.filter(F.sequence(F.lit(1), last), lambda i: (F.get("turns", i - 1)["role"] == TARGET) | (i == last)))
    each = talks.select("conv_id", "turns", "parts", F.posexplode("ends").alias("example", "n_turns"))
    target = F.get("turns", F.col("n_turns") - 1)
    each = each.select(
        "conv_id", "example", "n_turns",
        F.array_join(F.slice("parts", 1, F.col("n_turns")), "").alias("text"),
        F.when(target["role"] == TARGET, F.length(escape(target["text"]))).otherwise(0).alias("size"),
    )
    end = F.length("text") - len(END)
    return each.select("conv_id", "example", "n_turns", "text", (end - F.col("size")).alias("loss_begin"), end.alias("loss_end"))


def digest(examples: DataFrame) -> DataFrame:
    """What a reader of the examples finds in each conversation.

    turns_sha256 is over role, newline, text, newline of every turn; loss_sha256
    over all text under the masks, unescaped, example by example; formatted_chars
    counts the code points of all examples.
    """
    masked = unescape(F.substring("text", F.col("loss_begin") + 1, F.col("loss_end") - F.col("loss_begin")))
    read = examples.select("conv_id", "example", "n_turns", "text", masked.alias("loss"))
    talks = read.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    turns = F.slice(F.split("whole", r"<\|im_start\|>"), 2, 2**31 - 1)
    role = lambda t: unescape(F.substring_index(t, "\n", 1))
    text = lambda t: unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t) - F.instr(t, "\n") - len(END)))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    talks = talks.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars")
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
