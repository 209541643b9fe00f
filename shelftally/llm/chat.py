"""
Chat formatting: one training example per assistant turn.

Each example holds all turns up to and including its reply, and only the reply is trainable.
Template of a turn: ``[INST] role [/INST] text</s>``. The three control strings cannot occur
in a formatted role or text: a backslash is put behind their first character, and backslashes
are doubled, which ``unescape`` undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
REPLY = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, CLOSE, END):
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(f"{OPEN} "), escape(role), F.lit(f" {CLOSE} "), escape(text), F.lit(END))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``; others are not read).

    ``conv_id``, ``example`` (from 1), ``turns`` in it, ``text``, the trainable span as
    ``loss_start`` (code points before it) and ``loss_chars``, and ``whole``: the example holds
    all turns. A conversation whose last turn is no reply gets one more example with an empty
    span, so that the output holds every turn. Null role or text: empty. Turns with equal
    numbers are ordered by role and text, null numbers last; a null id is a conversation too.
    A conversation becomes one string, as its examples do, so it has to fit into a row.
    """
    turn = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("piece", format_turn(F.col("role"), F.col("text")))
    order = [F.col("turn").asc_nulls_last(), "role", "text"]
    so_far = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turn.select(
        "conv_id",
        "role",
        "piece",
        F.length(escape(F.col("text"))).alias("chars"),
        F.count("*").over(so_far).alias("place"),
        F.sum(F.length("piece").cast("long")).over(so_far).alias("end"),
    )
    # one row per conversation: its formatted text, and where each reply ends in it
    reply = F.col("role") == REPLY
    whole = placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda t: t["piece"]), "").alias("all"),
        F.array_sort(F.collect_list(F.when(reply, F.struct("place", "end", "chars")))).alias("replies"),
        F.max("place").alias("n"),
        F.max("end").alias("length"),
    )
    tail = F.struct(F.col("n").alias("place"), F.col("length").alias("end"), F.lit(-len(END)).alias("chars"))
    ends_open = F.coalesce(F.element_at("replies", -1)["place"], F.lit(0)) < F.col("n")
    ends = F.when(F.size("replies") == 0, F.array(tail)).when(ends_open, F.array_append("replies", tail)).otherwise(F.col("replies"))
    shown = whole.select("conv_id", "all", "n", F.posexplode(ends).alias("at", "target"))
    chars = F.greatest(F.col("target.chars"), F.lit(0)).cast("long")
    return shown.select(
        "conv_id",
        (F.col("at") + 1).cast("long").alias("example"),
        F.col("target.place").cast("long").alias("turns"),
        F.substring("all", F.lit(1), F.col("target.end").cast("int")).alias("text"),
        (F.col("target.end") - len(END) - F.col("target.chars")).alias("loss_start"),
        chars.alias("loss_chars"),
        (F.col("target.place") == F.col("n")).alias("whole"),
    )


def turns_of(text: Column) -> Column:
    """The turns of a formatted text: an array of ``role`` and ``text``."""
    pieces = F.split(text, END, -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, F.lit(len(OPEN) + 2), F.length(piece)), f" {CLOSE} ", 1)
        start = F.lit(len(OPEN) + 1 + len(CLOSE) + 2 + 1) + F.length(role)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, start, F.length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from examples alone: digests of its turns and of the text under the loss."""
    spoken = F.transform(turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    reply = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int")))
    rows = examples.select(
        "conv_id",
        "example",
        reply.alias("reply"),
        F.length("text").cast("long").alias("chars"),
        F.when(F.col("whole"), F.size(spoken).cast("long")).alias("n"),
        F.when(F.col("whole"), F.sha2(F.array_join(spoken, ""), 256)).alias("turns"),
    )
    merged = rows.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("turns").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda r: r["reply"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return merged.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
