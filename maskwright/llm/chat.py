"""Chat formatting: reply trees to training conversations.

A message names its parent; a message without one (or whose parent doesn't exist) is a root.
Paths come from iterative self-joins by doubling: after k joins every message knows its
ancestor 2^k replies up and every leaf knows all ancestors less than 2^k replies up, so a
thread of n replies takes log2(n) joins. Each join's result is written to the shared folder.
Branches rank by the sum of their messages' scores, ties by the smaller leaf.

Template: `<|turn|>role<|text|>text<|end|>` for each message. In roles and texts a backslash
becomes `\\s` and a backslash and `e` go behind the first character of each control string;
undoing that gives the text back exactly, whatever it holds.

Defined results: rows without a conversation or message id are left out; null text, role and score count as empty, empty and 0; repeated
(conversation, message) rows keep one (the largest role, text, parent, score); messages on a
cycle have no root and are in no path; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: This template's marks and the markers of common chat templates.
CONTROLS = [TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\e{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\e"), F.lit("")), F.lit("\\s"), F.lit("\\"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, id, up): every message on the path from each leaf to its root; up is
    the number of replies between the message and the leaf. messages: conv_id, id, parent."""
    key = ["conv_id", "id"]
    known = messages.select("conv_id", F.col("id").alias("above"))
    step = table(messages.select(*key, F.col("parent").alias("above")).where("above is not null").join(known, ["conv_id", "above"], "left_semi"), "step")
    leaves = messages.select(*key).join(step.select("conv_id", F.col("above").alias("id")), key, "left_anti")
    found = table(leaves.select("conv_id", F.col("id").alias("leaf"), "id", F.lit(0).alias("up")), "paths")
    longest = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    k = 0
    while 2**k < longest and not step.isEmpty():
        further = found.join(step, key).select("conv_id", "leaf", F.col("above").alias("id"), (F.col("up") + 2**k).alias("up"))
        found = table(found.unionByName(further), "paths")
        next_ = step.select("conv_id", F.col("id").alias("above"), F.col("above").alias("top"))
        step = table(step.join(next_, ["conv_id", "above"]).select(*key, F.col("top").alias("above")), "step")
        k += 1
    return found


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """One row for each chosen root-to-leaf path: conv_id, leaf, rank, path_score, n_turns,
    formatted, loss (spans of the assistant's texts in formatted: start, length in code
    points). messages: conv_id, id, parent, role, text and, if wished, score. top: paths a
    conversation; None: all."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
    rows = messages.select("conv_id", "id", F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", score.alias("score")).alias("m"))
    rows = table(rows.groupBy("conv_id", "id").agg(F.max("m").alias("m")).select("conv_id", "id", "m.*"), "messages")
    steps = paths(rows).join(rows.select("conv_id", "id", "role", "text", "score"), ["conv_id", "id"])
    turn = F.struct((-F.col("up")).alias("at"), "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    by_path = steps.groupBy("conv_id", "leaf").agg(F.sum("score").alias("path_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    ranked = by_path.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    marks = len(TURN) + len(TEXT)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + marks + F.length(x["r"])
        span = F.struct(start.alias("start"), F.length(x["t"]).alias("length"))
        spans = F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + F.length(x["t"]) + len(END)).alias("at"), spans.alias("spans"))

    formatted = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(TURN), x["r"], F.lit(TEXT), x["t"], F.lit(END))), "")
    return ranked.select("conv_id", "leaf", "rank", "path_score", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), F.aggregate("turns", empty, add)["spans"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of (role, text)."""
    pieces = F.split(formatted, r"<\|turn\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        halves = F.split(x, r"<\|text\|>")
        return F.struct(unescape(halves[0]).alias("role"), unescape(F.split(halves[1], r"<\|end\|>")[0]).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each turn replies to the one before. Rows that share a
    turn follow one another in order of role and text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("id"))
    return rows.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text")
