"""Operator 7, chat formatting by prefix-target expansion. DataFrame functions only.

A conversation is written once in a template that marks every turn::

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside texts are escaped so that the written form parses back to
the same turns: a backslash is doubled, then "<|" becomes "<\\|"; a line break in a
role becomes "<\\n". Every assistant turn is then exploded into an example of its
own: all text before the reply is context, and only the reply is trainable. The
context is a prefix of the conversation's formatted text, so an example carries the
prefix's length and the reply, not a copy of the prefix: output stays linear in the
input. `with_context` writes the prefixes out for those who want them.

Defined cases: null text or role is empty; a null turn sorts first; turns that tie
are ordered by role, then text; repeated rows are turns of their own; a null conv_id
is one conversation; a conversation without assistant turns has no example; an empty
table gives empty results. Other columns are ignored, whatever their names.
A conversation is the unit of output, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: "\n" follows, so that a turn ends with END and a line break.
_TAIL = END + "\n"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    single = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    return F.replace(single, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, replies: array of (start, end, reply) of the assistant turns, in order.

    start and end are code points in formatted, end exclusive; reply is the escaped
    text that stands there.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", "role", F.row_number().over(by).alias("ord"), head.alias("head"), body.alias("body"), F.sum(F.length(head) + F.length(body) + len(_TAIL)).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    end = F.col("upto") - len(_TAIL)
    turn = F.struct(
        "ord",
        F.concat("head", "body", F.lit(_TAIL)).alias("piece"),
        F.when(F.col("role") == "assistant", F.struct((end - F.length("body")).alias("start"), end.alias("end"), F.col("body").alias("reply"))).alias("reply"),
    )
    turns = F.array_sort(F.collect_list(turn))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select(
        "conv_id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.reply"), lambda r: r.isNotNull()).alias("replies"),
    )


def expand(formatted: DataFrame, *carry: str) -> DataFrame:
    """One row for each assistant turn: conv_id, example (from 0), context_chars, loss_start, loss_end, reply.

    The example's text is the first loss_end code points of formatted; its loss mask
    covers loss_start up to loss_end alone. carry: more columns of `formatted` to keep.
    Conversations without a reply keep one row with a null example.
    """
    out = formatted.select("conv_id", *carry, F.posexplode_outer("replies").alias("example", "r"))
    return out.select("conv_id", *carry, "example", F.col("r.start").alias("context_chars"), F.col("r.start").alias("loss_start"), F.col("r.end").alias("loss_end"), F.col("r.reply").alias("reply"))


def with_context(formatted: DataFrame) -> DataFrame:
    """conv_id, example, context, reply: the prefixes written out (quadratic in a conversation's turns)."""
    out = expand(formatted, "formatted").where("example is not null")
    return out.select("conv_id", "example", F.expr("substring(formatted, 1, int(context_chars))").alias("context"), "reply")


def parse(formatted: Column) -> Column:
    """The turns read back from a formatted text: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        bare = F.substring(p, F.lit(len(START) + 1), F.length(p))
        role = F.substring_index(bare, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(bare, F.length(role) + 2, F.length(bare))).alias("text"))

    return F.transform(pieces, turn)


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    turns = F.col("turns")
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = format_conversations(conversations).withColumn("turns", parse(F.col("formatted")))
    per = per.select("conv_id", "formatted", "replies", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    each = expand(per, "formatted", "n_turns", "turns_sha256", "formatted_chars")
    once = F.when(F.coalesce("example", F.lit(0)) == 0, F.col("formatted"))  # a copy a conversation, not one an example
    mask = F.when(F.col("example").isNotNull(), F.struct("example", F.col("loss_start").cast("int").alias("start"), F.col("loss_end").cast("int").alias("end")))
    each = each.select("conv_id", "n_turns", "turns_sha256", "formatted_chars", once.alias("formatted"), mask.alias("mask"))
    out = each.groupBy("conv_id").agg(*(F.first(c).alias(c) for c in ("n_turns", "turns_sha256", "formatted_chars")), F.first("formatted", ignorenulls=True).alias("formatted"), F.array_sort(F.collect_list("mask")).alias("masks"))
    cut = lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))
    out = out.withColumn("loss", F.array_join(F.transform("masks", cut), ""))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
