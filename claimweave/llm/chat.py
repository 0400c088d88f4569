"""Chat formatting with DataFrame expressions only.

Turns are collected as structs, sorted, and adjacent turns of one role are merged into a block; the
blocks are joined into one string. The template's control strings are

    <s> ... </s>          around each block
    [INST]  [/INST]       around a user's block
    <<SYS>> <</SYS>>      around a system block
    <<ROLE>> <</ROLE>>    around the name of any other role, before its texts
    <sep>                 between the merged turns of a block

An assistant's block has no inner marks. Inside texts and role names a backslash is doubled, and a
backslash is put after the first character of any control string, so that none survives; dropping one
backslash before each character undoes both. The loss mask covers the texts of assistant blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an escape has to break: a backslash, or the first character of a control string.
_ESCAPE = r"\\|\[(?=/?INST\])|<(?=/?s>|sep>|</?SYS>>|</?ROLE>>)"


def escape(text: Column) -> Column:
    """The text without control strings, reversibly."""
    return F.regexp_replace(text, f"({_ESCAPE})", "$1\\\\")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given: of each pair that escape made, the backslash goes."""
    return F.regexp_replace(text, r"(?s)(\\|\[|<)\\", "$1")


def conversation_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns as structs ``(turn, role, text)``, in order.

    Null texts and null roles count as empty; null turns come first; ties of turn go by role and
    text. Rows with a null conv_id are one conversation. Repeated rows are turns of their own.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def merge_adjacent(turns: Column) -> Column:
    """Blocks ``(role, texts)``: neighbours of one role put together, their texts kept apart.

    A turn starts a block where the one before has another role; a block takes the turns from its
    start up to the next block's.
    """
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, F.greatest(i - 2, F.lit(0)))["role"]))

    def block(i: Column, k: Column) -> Column:
        until = F.coalesce(F.get(starts, k + 1), F.size(turns) + 1)
        return F.struct(F.get(turns, i - 1)["role"].alias("role"), F.transform(F.slice(turns, i, until - i), lambda t: t["text"]).alias("texts"))

    return F.transform(starts, block)


def format_blocks(blocks: Column) -> Column:
    """One string of all blocks."""

    def one(b: Column) -> Column:
        body = F.array_join(F.transform(b["texts"], escape), "<sep>")
        role = b["role"]
        return (
            F.when(role == "user", F.concat(F.lit("<s>[INST] "), body, F.lit(" [/INST]</s>")))
            .when(role == "system", F.concat(F.lit("<s><<SYS>>"), body, F.lit("<</SYS>></s>")))
            .when(role == "assistant", F.concat(F.lit("<s>"), body, F.lit("</s>")))
            .otherwise(F.concat(F.lit("<s><<ROLE>>"), escape(role), F.lit("<</ROLE>>"), body, F.lit("</s>")))
        )

    return F.array_join(F.transform(blocks, one), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, n_blocks, formatted)``: each conversation as one string.

    Conversations are bounded by what one string holds; no rows give no conversations.
    """
    merged = conversation_turns(rows).select("conv_id", merge_adjacent(F.col("turns")).alias("blocks"))
    return merged.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), format_blocks(F.col("blocks")).alias("formatted"))


def parse_blocks(formatted: Column) -> Column:
    """Blocks ``(role, texts)`` read back from a formatted string alone."""

    def inner(block: Column, before: str, after: str) -> Column:
        return F.substring(block, F.lit(len(before) + 1), F.length(block) - len(before) - len(after))

    def texts(body: Column) -> Column:
        return F.transform(F.split(body, "<sep>", -1), unescape)

    def one(block: Column) -> Column:
        named = block.startswith("<s><<ROLE>>")
        rest = inner(block, "<s><<ROLE>>", "")
        role_end = F.instr(rest, "<</ROLE>>")
        role = F.when(block.startswith("<s>[INST] "), "user").when(block.startswith("<s><<SYS>>"), "system").when(named, unescape(F.substring(rest, F.lit(1), role_end - 1))).otherwise("assistant")
        body = (
            F.when(block.startswith("<s>[INST] "), inner(block, "<s>[INST] ", " [/INST]"))
            .when(block.startswith("<s><<SYS>>"), inner(block, "<s><<SYS>>", "<</SYS>>"))
            .when(named, F.substring(rest, role_end + len("<</ROLE>>"), F.length(rest)))
            .otherwise(inner(block, "<s>", ""))
        )
        return F.struct(role.alias("role"), texts(body).alias("texts"))

    pieces = F.split(formatted, "</s>", -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what the formatted string gives back: turns, loss texts and their hashes."""
    read = formatted.withColumn("blocks", parse_blocks(F.col("formatted")))
    lines = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n")))))
    loss = F.array_join(F.flatten(F.transform(F.filter("blocks", lambda b: b["role"] == "assistant"), lambda b: b["texts"])), "")
    read = read.select("conv_id", "n_blocks", "formatted", lines.alias("lines"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
