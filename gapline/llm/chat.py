"""Chat formatting of reply trees.

Messages form trees (a message with no parent in its conversation is a root). Iterated self-joins enumerate the paths from root to
leaf: each round joins the ancestors 2**k levels up with themselves and adds them to what each leaf has reached, so a path of any depth takes
a logarithmic number of rounds and work in proportion to the paths; only ids are carried, and each round is written to the shared folder. Paths
of a conversation are ranked by their summed score (ties: by the path itself), and each chosen path is formatted as one
conversation with a loss mask over the assistant's texts. All of it is DataFrame operations.

The template is ``<|turn|>role<|text|>text<|end|>`` for each turn. Inside roles and texts a backslash becomes ``\\b`` and the first
character of each control string becomes ``\\l`` (for ``<``) or ``\\k`` (for ``[``), so that no control string is left and the
original can be restored exactly.

Null text or role counts as empty. Messages on a cycle have no root and are on no path. A null conv_id is a conversation of its
own. Each row of a plain table of turns is one message, also if rows repeat. An empty table gives an empty result; texts of any length
are formatted whole; columns besides those named aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.shared import materialise

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: fixed values: control strings of common chat templates, besides this one's
CONTROL = (
    TURN,
    TEXT,
    END,
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<s>",
    "</s>",
    "<<SYS>>",
    "<</SYS>>",
    "[INST]",
    "[/INST]",
)
FIRST = {"<": "\\l", "[": "\\k"}


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(FIRST[c[0]] + c[1:])), CONTROL, text)


def unescape(text: Column) -> Column:
    text = reduce(lambda t, kv: F.replace(t, F.lit(kv[1]), F.lit(kv[0])), FIRST.items(), text)
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def as_tree(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each the reply to the row before it (order: turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = turns.select("conv_id", F.row_number().over(w).cast("long").alias("node"), "role", "text")
    return out.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


def reply_paths(messages: DataFrame) -> DataFrame:
    """conv_id, path (array of nodes, root first), score: every path from a root to a leaf. ``messages`` has conv_id, node, parent, score; node is unique in its conversation."""
    m = messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = m.select(F.col("conv_id").alias("c"), F.col("node").alias("above"))
    above = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("above"))
    jump = materialise(m.join(known, above, "left_semi").select("conv_id", "node", F.col("parent").alias("up")), "jump")
    parents = jump.select(F.col("conv_id").alias("c"), F.col("up").alias("above")).distinct()
    leaf = m.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("above")), "left_anti")
    first = jump
    # pairs of a leaf and a message on its path, at a distance below 2**k after k rounds
    pairs = materialise(leaf.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist")), "pairs")
    longest = m.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < longest and not jump.isEmpty():
        step = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("at"), "up")
        on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("at"))
        more = materialise(
            pairs.join(step, on).select("conv_id", "leaf", F.col("up").alias("node"), (F.col("dist") + reach).alias("dist")),
            "pairs",
        )
        pairs = pairs.unionByName(more)
        again = jump.join(step.withColumnRenamed("up", "top"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("at")))
        jump = materialise(again.select("conv_id", "node", F.col("top").alias("up")), "jump")
        reach *= 2
    up = first.select(F.col("conv_id").alias("c"), F.col("node").alias("at"), F.lit(True).alias("has"))
    own = m.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), "score")
    full = pairs.join(own, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")))
    full = full.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("at")), "left")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("place"), "node")))
    out = full.groupBy("conv_id", "leaf").agg(
        steps.alias("steps"),
        F.sum("score").alias("score"),
        F.bool_or(F.col("has").isNull()).alias("rooted"),
    )
    return out.where("rooted").select("conv_id", F.transform("steps", lambda x: x.node).alias("path"), "score")


def format_paths(messages: DataFrame, paths: DataFrame, branches: int | None = None) -> DataFrame:
    """conv_id, branch (1 is the best), path, score, formatted, mask (array of code point ranges [start, end) of assistant texts, escaped)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "path")
    ranked = paths.withColumn("branch", F.row_number().over(w))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    steps = ranked.select("conv_id", "branch", "path", "score", F.posexplode("path").alias("pos", "at"))
    body = messages.select(
        F.col("conv_id").alias("c"),
        F.col("node").alias("n"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    one = steps.join(body, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("n")))
    one = one.withColumns(
        {
            "head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)),
            "inner": escape(F.col("text")),
            "loss": F.col("role") == "assistant",
        }
    )
    one = one.withColumn("piece", F.concat("head", "inner", F.lit(END)))
    before = Window.partitionBy("conv_id", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    mask = F.when(F.col("loss"), F.struct(F.col("start").alias("start"), (F.col("start") + F.length("inner")).alias("end")))
    out = one.groupBy("conv_id", "branch").agg(
        F.min("path").alias("path"),
        F.min("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(mask)).alias("mask"),
    )
    return out.select(
        "conv_id",
        "branch",
        "path",
        "score",
        F.array_join(F.transform("pieces", lambda x: x.piece), "").alias("formatted"),
        "mask",
    )


def read_turns(formatted: Column) -> Column:
    """array of (role, text), read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|turn\|>")

    def turn(x: Column) -> Column:
        text = F.substring_index(x, TEXT, -1)
        return F.struct(
            unescape(F.substring_index(x, TEXT, 1)).alias("role"),
            unescape(F.substring(text, F.lit(1), F.length(text) - len(END))).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(
        F.transform(mask, lambda m: unescape(F.substring(formatted, (m.start + 1).cast("int"), (m.end - m.start).cast("int")))),
        "",
    )
