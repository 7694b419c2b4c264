"""Conversations from reply trees, with reversible escapes and loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No control string is left: a backslash is doubled, ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    """As texts; a line break, which would end the role, becomes a backslash and N."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\N"))


def _unescape_role(role: Column) -> Column:
    # The inverse in the order of writing: pairs of backslashes first set aside.
    held = F.replace(role, F.lit("\\\\"), F.lit("\\\x00"))
    held = F.replace(F.replace(held, F.lit("\\N"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.replace(held, F.lit("\\\x00"), F.lit("\\"))


def linear_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(tree, node, parent, role, text, score) of conversations whose turns follow each other.

    Turns are in the order of ``turn``, nulls first, ties by role and text; null roles and texts
    are empty. ``tree`` is a struct, so that a null conversation is one like others.
    """
    order = W.partitionBy("tree").orderBy("t", "role", "text")
    rows = turns.select(
        F.struct(F.col(conv).alias("id")).alias("tree"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("node", F.row_number().over(order).cast("bigint"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, depth, node) of the ``branches`` best root-to-leaf paths of each tree.

    ``nodes`` is (tree, node, parent, score); a null or unknown parent makes a root. Links are
    doubled: step k joins every node met so far with its ancestor 2**k above, so a chain of n
    turns takes log2(n) joins. Branches are ranked by the sum of their scores, then by
    their leaf. Nodes of a circle of parents have no root and are left out.
    """
    key = nodes.select("tree", "node", "parent", "score")
    known = key.select("tree", F.col("node").alias("parent")).withColumn("known", F.lit(True))
    links = materialise(
        key.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("score")),
        "links",
    )
    inner = links.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = links.join(inner, ["tree", "node"], "left_anti")
    # Every (leaf, node) met: its distance from the leaf, and the node's link 2**k up.
    met = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("above"))
    jump, k, most = links.where("up is not null").select("tree", "node", "up"), 0, links.count()
    while True:
        jump = materialise(jump, "jump")  # only of nodes that have an ancestor 2**k above
        if jump.isEmpty():
            break
        if 1 << k > most:
            met = met.join(jump.select("tree", F.col("node").alias("leaf")), ["tree", "leaf"], "left_anti")
            break
        reached = met.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + F.lit(1 << k)).alias("above"))
        met = materialise(met.unionByName(reached), "met")
        jump = (
            jump.alias("a")
            .join(jump.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
            .select("a.tree", "a.node", "b.up")
        )
        k += 1
    return _ranked(met, links, branches)


def _ranked(met: DataFrame, links: DataFrame, branches: int) -> DataFrame:
    scored = met.join(links.select("tree", "node", "score"), ["tree", "node"])
    paths = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("above").alias("length"))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    best = paths.withColumn("branch", rank).where(F.col("branch") <= branches)
    return met.join(best, ["tree", "leaf"]).select("tree", "branch", (F.col("length") - F.col("above")).alias("depth"), "node")


def format_paths(paths: DataFrame, nodes: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, branch, formatted, spans): each path as one text, and the spans under the loss mask.

    A span is (start, length) in code points of ``formatted`` and covers the escaped text of one
    turn whose role is in ``learn``. A conversation is one value, as large as its turns.
    """
    turns = paths.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turns = turns.withColumns({"head": head, "body": escape(F.col("text"))})
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = W.partitionBy("tree", "branch").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head")
    turn = F.struct("depth", "piece", start.alias("start"), F.char_length("body").alias("length"), F.col("role").isin(*learn).alias("learnt"))
    whole = turns.select("tree", "branch", turn.alias("turn")).groupBy("tree", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["learnt"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select("tree", "branch", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), spans.alias("spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    bare = F.transform(pieces, lambda x: F.left(x, F.char_length(x) - F.lit(len(END) + 1)))

    def turn(x: Column) -> Column:
        at = F.instr(x, "\n")
        return F.struct(
            _unescape_role(F.left(x, at - F.lit(1))).alias("role"),
            unescape(F.substr(x, at + F.lit(1))).alias("text"),
        )

    return F.transform(bare, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    parts = F.transform(spans, lambda x: F.substr(formatted, (x["start"] + F.lit(1)).cast("int"), x["length"].cast("int")))
    return unescape(F.array_join(parts, ""))
