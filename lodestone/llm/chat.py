"""Reply trees as training conversations.

Messages form trees (each names its parent). Root-to-leaf paths are enumerated by self-joins of pointer-doubling jump
tables, so that a chain of n turns takes log2(n) joins and as many rows as the paths have messages. Branches are ranked
by the sum of their scores, and each chosen path becomes one conversation in a template whose control strings are
escaped inside texts.

Edge cases: a null text or role counts as empty; a null score counts as 0; a message whose parent isn't in its tree is
a root; repeated (tree, message) rows keep the first by role and text; a null tree id is a tree of its own; messages on
a cycle have no root and are left out; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import materialize

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Reversible: a backslash becomes two, and <| becomes <\| so that no control string can appear."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    r"""As escape(), and a line break becomes \n, as the role ends at the first line break."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    r"""Pairs are read from the left: \\ first becomes a character that no escaped text holds between pairs."""
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")))
    return F.array_join(parts, "\\")


def linear_parents(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turn tables as trees: the parent of each row is the row before it. Columns tree, node, parent, role, text, score.

    Rows are numbered by turn (null ones last, as in SQL), role and text, so that rows with equal or null turns all count.
    """
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_last(), "role", "text")).cast("long")
    return rows.withColumn("_place", place).select(
        F.col(conv).alias("tree"),
        F.col("_place").alias("node"),
        F.when(F.col("_place") > 1, F.col("_place") - 1).alias("parent"),
        "role",
        "text",
        F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("double").alias("score"),
    )


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The top root-to-leaf paths of each tree: (tree, leaf, rank, path_score, depth, node, role, text), a row per message.

    messages has tree, node, parent, role, text, score. Ties between branches go to the smaller leaf.
    """
    first = Window.partitionBy("tree", "node").orderBy("role", "text")
    clean = messages.select(
        "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")
    ).withColumn("_n", F.row_number().over(first))
    clean = materialize(clean.filter("_n = 1").drop("_n"), "messages")
    ids = clean.select("tree", "node", "parent", "score")
    known = ids.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    at = ids.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")) & (F.col("p") != F.col("node")), "left")
    # up: the 2^k-th ancestor; total: scores from this node up to below it; steps: messages that total covers
    begun = materialize(at.select("tree", "node", F.col("p").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "jump")
    done, jumps = begun.filter("up is null"), [begun.filter("up is not null")]
    rounds = max(1, begun.count()).bit_length()
    while len(jumps) <= rounds and not jumps[-1].isEmpty():  # only nodes deeper than 2^k take part in round k
        above = done.unionByName(jumps[-1]).toDF("t", "n", "up2", "more", "further")
        further = jumps[-1].join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps")
        )
        further = materialize(further, "jump")
        done = done.unionByName(further.filter("up is null"))
        jumps.append(further.filter("up is not null"))
    parents = jumps[0].select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
    leaves = done.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("u")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node")))
    path = ranked.filter(F.col("rank") <= top).select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("path_score"), F.col("steps").alias("depth"), "node")
    for k in reversed(range(len(jumps))):  # each message of a path is reached by exactly one sum of powers of two
        step = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        further = path.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", "rank", "path_score", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("node")
        )
        path = materialize(path.unionByName(further), "path")
    texts = clean.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return path.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).drop("t", "n")


def format_paths(path: DataFrame) -> DataFrame:
    """One row per path: (tree, leaf, rank, path_score, formatted, loss_spans).

    loss_spans are the 1-based starts and lengths, in characters of formatted, of the (escaped) assistant texts.
    """
    key = ["tree", "leaf", "rank", "path_score"]
    said = path.select(*key, "depth", escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("learn"))
    head = F.concat(F.lit(START), "role", F.lit("\n"))
    said = said.withColumns({"whole": F.concat(head, "text", F.lit(f"{END}\n")), "head": F.char_length(head)})
    before = F.sum(F.char_length("whole")).over(Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    span = F.struct((F.coalesce(before, F.lit(0)) + F.col("head") + 1).cast("int").alias("start"), F.char_length("text").alias("len"))
    turn = F.struct("depth", "whole", span.alias("span"), "learn")
    one = said.withColumn("turn", turn).groupBy(*key).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"])
    return one.select(*key, F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed back from a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    body = F.lit(len(END) + 1)
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, "\n") + 1, F.char_length(x) - F.instr(x, "\n") - body)).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["len"]))), "")
