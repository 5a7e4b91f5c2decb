"""Chat formatting by prefix-target expansion, by built-in functions only.

Every assistant turn becomes one training example: all turns before it as
context, and only that reply under the loss mask.  A conversation that does
not end with a reply gets one more example without a target, so that no turn
is lost and the conversation can be read back.

Turns are written ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.  Inside
roles and texts a backslash is doubled and ``<|`` becomes ``<\\|`` (a line end
in a role becomes ``\\/``), so control strings stay text and the writing can be
undone.  Offsets count code points.

A conversation is laid out once, as one string with running offsets from a
window over its turns; an example is a prefix of that string, cut when it is
read, so no task holds all prefixes of a conversation at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\/"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\/", "$1\n"))


def layout(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, stream (all turns as formatted) and examples (array of spans).

    Turns are ordered by turn, role and text (nulls first); null roles and
    texts are empty; rows without conv_id form one conversation; repeated
    rows are turns of their own.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.select(
        "conv_id", "role", "piece", F.length("head").alias("head_chars"), F.length("body").alias("body_chars"),
        F.row_number().over(in_order).alias("n"),
        F.sum(F.length("piece")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    start = F.col("stop") - F.length("piece") + F.col("head_chars")
    is_target = F.col("role") == TARGET
    span = F.struct(F.col("n").alias("n_turns"), F.col("stop").alias("stop"), start.alias("loss_start"),
                    (start + F.col("body_chars")).alias("loss_end"))
    rest = F.struct(F.col("n").alias("n_turns"), F.col("stop").alias("stop"), F.col("stop").alias("loss_start"),
                    F.col("stop").alias("loss_end"))
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("pieces"),
        F.collect_list(F.when(is_target, span)).alias("targets"),
        F.max(F.struct("n", is_target.alias("ends"), rest.alias("rest"))).alias("last"))
    return whole.select(
        "conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("stream"),
        F.concat(F.sort_array("targets"), F.when(F.col("last.ends"), F.array().cast(
            "array<struct<n_turns:int,stop:bigint,loss_start:bigint,loss_end:bigint>>")).otherwise(
                F.array("last.rest"))).alias("examples"))


def chat_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), text, loss_start, loss_end (of the mask, end exclusive).

    Tokens between the two offsets are trainable, all others are context.  An
    empty table gives no examples.
    """
    told = layout(conversations).select("conv_id", "stream", F.posexplode("examples").alias("example", "span"))
    return told.select("conv_id", "example", F.substr("stream", F.lit(1), F.col("span.stop").cast("int")).alias("text"),
                       F.col("span.loss_start").alias("loss_start"), F.col("span.loss_end").alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: the turns, what the mask covers, and the characters written."""
    masked = F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    parts = examples.select("conv_id", "example", unescape(masked).alias("loss"), F.length("text").alias("chars"), "text")
    whole = parts.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    turns = F.transform(F.filter(F.split("text", r"<\|im_end\|>\n", -1), lambda x: x != ""), lambda x: F.struct(
        _unescape_role(F.regexp_extract(x, r"(?s)^<\|im_start\|>([^\n]*)\n", 1)).alias("role"),
        unescape(F.regexp_extract(x, r"(?s)^<\|im_start\|>[^\n]*\n(.*)$", 1)).alias("text")))
    return whole.select("conv_id", turns.alias("turns"),
                        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(chat_examples(conversations))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long").alias("formatted_chars"))
