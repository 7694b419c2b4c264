"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of those that end there;
sequences that are proper prefixes of others are dropped by an anti-join, which leaves the leaves;
the weighted sequences are summed by prefix. A prefix is known by its depth and four sums of 32-bit
pieces of SHA-256 over (depth, turn), so its identity is a running sum, which windows over blocks
of a conversation and one over their totals give however long the conversation is.

Sums over subtrees need no walk: of a node's subtree, the words weighted by members are those that
its members still have to come, and each node's own words are counted once, by the member with the
smallest id, whose own nodes are the tail of its path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.position import position_rows
from ..session import materialise
from .common import WORD
from .streams import id_pieces, piece_digests

# Nodes on so many prefix rows (or more than a thousandth of all) are looked up by broadcast.
FREQUENT = 1_000
BLOCK = 1_024
SUMS = ("s0", "s1", "s2", "s3")

# Fixed value: the digest of an empty text.
NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 0, by turn, nulls first), ``turn_id`` (digest of role and text), ``words``.

    Null roles and texts count as empty. Rows of one turn follow by role, then by the SHA-256 of
    their text. Rows without a conversation id are left out. Other columns are not looked at.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    placed = position_rows(rows, "conv_id", "turn", "role", "digest").with_position("pos")
    starts = placed.groupBy("conv_id").agg(F.min("pos").alias("start"))
    turn_id = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("digest")).cast("binary"), 256)
    return placed.join(starts, "conv_id").select("conv_id", (F.col("pos") - F.col("start")).alias("place"), turn_id.alias("turn_id"), "words")


def rebuilt(rows: DataFrame, every: int, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``taken`` turns of conversation ``conv_id - conv_id % every``.

    Then come their own turns after as many. ``rows`` as of ``turn_rows``. Returns sequences
    (``conv_id``, ``depth`` from 1, ``turn_id``, ``words``) and all ids.
    """
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), taken.cast("bigint").alias("h"))
    lent = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lent, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = rows.join(convs.select("conv_id", "h", "m"), "conv_id").where(F.col("place") >= F.col("h"))
    own = own.select("conv_id", (F.col("m") + F.col("place") - F.col("h") + 1).alias("depth"), "turn_id", "words")
    heads = rows.withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where(F.col("place") < F.col("h"))
    heads = heads.select("conv_id", (F.col("place") + 1).alias("depth"), "turn_id", "words")
    return own.unionByName(heads), convs.select("conv_id")


def _running(rows: DataFrame, by: str, at: str, sums: list[str], block: int) -> DataFrame:
    """Replace columns by their running sums; blocks of a long group are summed by themselves."""
    rows = rows.withColumn("block", F.floor(F.col(at) / block))
    before = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, "block").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select(by, "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(by, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({c: F.sum(c).over(inside) for c in sums}).join(offsets, [by, "block"])
    return run.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("block", *[f"_{c}" for c in sums])


def _looked_up(rows: DataFrame, key: str, values: DataFrame, rows_per_key: str, total: int) -> DataFrame:
    """Join by key, where few keys may have most rows: at most 1,000 of them, which are broadcast."""
    many = F.col(rows_per_key) >= max(FREQUENT, total // 1000 + 1)
    often, seldom = values.where(many).drop(rows_per_key), values.where(~many).drop(rows_per_key)
    met = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom, key)
    return met.unionByName(rest)


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row a node. ``ends``: ``key`` (the node's) and ``conv_id`` of all conversations."""

    nodes: DataFrame
    ends: DataFrame

    def end_digests(self) -> DataFrame:
        """``key`` and the SHA-256 (hex) of the ids that end there, ascending, joined by commas.

        Ids are sorted by range and joined in pieces, so a node where most conversations end
        is hashed from few rows, one piece at a time.
        """
        ids = self.ends.select("key", F.col("conv_id").alias("id"))
        sorted_ = ids.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
        pieces = sorted_.mapInArrow(id_pieces, "key string, first bigint, piece string")
        ordered = pieces.repartition("key").sortWithinPartitions("key", "first")
        return ordered.select("key", "piece").mapInArrow(piece_digests, "key string, digest string")


def prefix_trie(sequences: DataFrame, ids: DataFrame, block: int = BLOCK) -> Trie:
    """The trie of ``sequences`` (``conv_id``, ``depth`` from 1 without gaps, ``turn_id``, ``words``).

    ``ids`` lists every conversation once, also those without turns, which end at the root. Nodes:
    ``key``, ``depth``, ``conv_id`` (smallest member), ``parent_conv_id``, ``turn_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves`` (in the subtree, itself included),
    ``saved_tokens`` (over the subtree: words of the last turn, once for each member but one).
    Without conversations there is no node, not even a root.
    """
    tagged = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "turn_id").cast("binary"), 256)
    piece = lambda i: F.conv(F.substring(tagged, 1 + 8 * i, 8), 16, 10).cast("bigint")
    own = sequences.select("conv_id", "depth", "turn_id", "words", *[piece(i).alias(s) for i, s in enumerate(SUMS)])
    terms = {f"t{i}": F.col(s) for i, s in enumerate(SUMS)} | {"upto": F.col("words")}
    run = _running(own.withColumns(terms), "conv_id", "depth", [*SUMS, "upto"], block)
    key = F.concat_ws(".", "depth", *SUMS)
    parent = F.concat_ws(".", F.col("depth") - 1, *[F.col(s) - F.col(f"t{i}") for i, s in enumerate(SUMS)])
    paths = run.select("conv_id", "depth", key.alias("key"), parent.alias("parent"), "turn_id", "words", "upto")
    paths = materialise(paths, "paths")
    root = "0.0.0.0.0"

    # Whole sequences: one for each distinct path, under the smallest of its conversations.
    last = paths.join(paths.groupBy("conv_id").agg(F.max("depth").alias("depth")), ["conv_id", "depth"])
    whole = ids.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("key", F.lit(root)).alias("key"), F.coalesce("depth", F.lit(0)).alias("length"), F.coalesce("upto", F.lit(0)).alias("all_words")
    )
    whole = materialise(whole, "whole")
    groups = whole.groupBy("key", "length", "all_words").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    groups = materialise(groups, "sequences")
    empty = {"depth": F.lit(0), "parent": F.lit(None).cast("string"), "turn_id": F.lit(None).cast("string"), "words": F.lit(0), "upto": F.lit(0)}
    roots = groups.withColumns(empty).withColumn("node", F.lit(root))
    steps = paths.withColumnRenamed("key", "node").join(groups, "conv_id").unionByName(roots, allowMissingColumns=True)
    inner = steps.where(F.col("depth") < F.col("length")).select(F.col("node").alias("key")).distinct()
    leaves = groups.join(inner, "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    steps = steps.drop("key").join(leaves, "conv_id", "left").withColumns(
        {"leaf": F.coalesce("leaf", F.lit(0)), "before": F.col("upto") - F.col("words")}
    )
    steps = materialise(steps.withColumnRenamed("node", "key"), "steps")
    total = steps.count()

    # Depth, parent and turn follow from the key; as grouping columns they need no sort.
    sums = steps.groupBy("key", F.col("depth").cast("bigint").alias("depth"), "parent", "turn_id").agg(
        F.min("conv_id").alias("owner"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("all_words") - F.col("before"))).alias("said"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    sums = materialise(sums, "prefixes")

    # What a sequence counts of the distinct words: the nodes of which it is the smallest member.
    owned = _looked_up(steps.select("key", "conv_id", "before", "all_words"), "key", sums.select("key", "owner", "n_rows"), "n_rows", total)
    tails = owned.groupBy("conv_id").agg(F.min(F.when(F.col("owner") == F.col("conv_id"), F.col("before"))).alias("tail"))
    once = steps.join(tails.where(F.col("tail").isNotNull()), "conv_id").groupBy("key")
    once = once.agg(F.sum(F.col("all_words") - F.greatest("before", "tail")).alias("once"))

    children = sums.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = sums.join(once, "key", "left").join(children, "key", "left")
    nodes = materialise(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "nodes")
    above = nodes.where(F.col("n_children") > 0).select(F.col("key").alias("parent"), F.col("owner").alias("parent_conv_id"), "n_children")
    below = _looked_up(nodes.where(F.col("parent").isNotNull()), "parent", above.withColumnRenamed("n_children", "n"), "n", total)
    every = below.unionByName(nodes.where(F.col("parent").isNull()), allowMissingColumns=True)
    out = every.select(
        "key",
        "depth",
        F.col("owner").alias("conv_id"),
        "parent_conv_id",
        "turn_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("said") - F.coalesce("once", F.lit(0))).cast("bigint").alias("saved_tokens"),
    )
    return Trie(out, whole.select("key", "conv_id"))
