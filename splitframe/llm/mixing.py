"""Mixes of sources to target weights, drawn as fixed-length blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.position import free_name
from ..session import materialise
from .common import WORD

ROUNDS = 20
CHUNK = 1024


def _long(x) -> Column:
    return F.lit(x).cast("bigint")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by ``key``, sends ``x``.

    A swap-or-not shuffle: each round pairs the places by a keyed reflection and swaps a pair on
    a keyed bit, so any n will do and no table or sort is needed.
    """

    def step(at: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, i), n) - at, n)
        swap = F.xxhash64(*key, i, F.greatest(at, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, step)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, n, source_size, docs, target) for rows (source, size).

    Sources by code point, null last, take the weights in turn. Targets share ``share`` times all
    sizes by weight; none exceeds ``cap`` times its source, and what is over is shared by weight
    among the others until none is above: so all below their caps get one multiple of their
    weight. That multiple follows from running sums in the order in which caps are met. Windows
    run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("n", n).withColumns({"weight": weight, "most": F.lit(float(cap)) * F.col("source_size")})
    met = W.orderBy(F.col("most") / F.col("weight"), "n")
    capped = F.coalesce(F.sum("most").over(met.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(met.rowsBetween(0, W.unboundedFollowing))
    budget = F.lit(float(share)) * F.sum("source_size").over(W.partitionBy())
    multiple = (budget - capped) / open_weight
    per = per.withColumn("multiple", F.when(multiple <= F.col("most") / F.col("weight"), multiple))
    multiple = F.max("multiple").over(W.partitionBy())
    target = F.least(F.col("most"), F.coalesce(multiple * F.col("weight"), F.col("most")))
    return per.select("source", "n", "source_size", "docs", target.alias("target"))


@dataclass(frozen=True)
class Mix:
    """``documents``: (row, id, source, size). ``sources``: targets. ``slots``: one row for each
    block taken (n, slot, shard, pass, block, take). ``pieces``: the parts of documents in them
    (row, pass, shard, slot, first_word, words)."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """``documents`` with source_size, target and taken."""
        words = self.pieces.groupBy("row").agg(F.sum("words").alias("taken"))
        return (
            self.documents.join(words, "row", "left")
            .join(self.sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
            .select("row", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
        )

    def shard_counts(self) -> DataFrame:
        """Blocks of each source in each output shard."""
        return self.slots.groupBy("shard", "n").count()


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 1024,
    shards: int = 64,
    seed: int = 11,
) -> Mix:
    """Mix the sources of ``docs`` to their targets in words.

    The documents of a source, in a pseudorandom order, are one stream of words, packed into
    blocks of ``block`` words and a shorter last one. Each pass over a source maps its slots
    through a permutation of its full blocks, the last block closing the pass, so a word is
    taken once a pass at most. A source takes whole passes and the first slots of one more, the
    last of them in part, which gives its rounded target exactly. Every slot draws its output
    shard uniformly: the source counts of the shards are multinomial, given the source totals.

    Words are runs of other characters than ASCII white space; null and empty texts have none and
    are never taken. A null source is a source. Rows may repeat. An empty table gives an empty
    mix. ``docs`` should be a stored table: rows are told apart by their place in it.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    rows = materialise(rows, "sizes")
    sources = materialise(source_targets(rows, weights, share, cap), "sources")
    placed = _placed(rows, sources, seed)
    first = F.floor(F.col("at") / F.lit(block)).cast("bigint")
    last = F.floor((F.col("at") + F.col("size") - 1) / F.lit(block)).cast("bigint")
    parts = placed.select("row", "n", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    start, low = F.col("block") * block, F.greatest(F.col("at"), F.col("block") * block)
    high = F.least(F.col("at") + F.col("size"), start + block)
    parts = parts.select("row", "n", "block", (low - start).alias("low"), (high - low).alias("length"), (low - F.col("at")).alias("first_word"))
    slots = _slots(sources, block, shards, seed)
    pieces = (
        parts.join(slots.hint("merge"), ["n", "block"])  # the estimate of unfolded rows is far too low for a broadcast
        .withColumn("words", F.least(F.col("low") + F.col("length"), F.col("take")) - F.col("low"))
        .where("words > 0")
        .select("row", "pass", "shard", "slot", "first_word", "words")
    )
    return Mix(rows, sources, slots, pieces)


def _placed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Where each document with words begins in its source's stream.

    Documents fall into about sqrt(docs) buckets of their source: one running sum over the
    buckets, one inside each, so no window holds a whole source.
    """
    keyed = (
        rows.where("size > 0")
        .join(sources.select(F.col("source").alias("s"), "n", "docs"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("place", F.xxhash64(_long(seed), "row"))
        .withColumn("bucket", F.pmod(F.xxhash64(_long(seed + 1), "row"), F.ceil(F.sqrt("docs")).cast("bigint")))
        .select("row", "n", "size", "place", "bucket")
    )
    earlier = W.unboundedPreceding, -1
    sums = keyed.groupBy("n", "bucket").agg(F.sum("size").alias("words"))
    begins = sums.select(
        "n", "bucket", F.coalesce(F.sum("words").over(W.partitionBy("n").orderBy("bucket").rowsBetween(*earlier)), F.lit(0)).alias("begin")
    )
    inside = W.partitionBy("n", "bucket").orderBy("place", "row").rowsBetween(*earlier)
    offset = keyed.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return offset.join(begins, ["n", "bucket"]).select("row", "n", "size", (F.col("begin") + F.col("offset")).alias("at"))


def _slots(sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """(n, slot, shard, pass, block, take): every block that the mix takes, ``take`` words of it."""
    words = F.round("target").cast("bigint")
    src = sources.where("source_size > 0").select("n", "source_size", words.alias("words"))
    full, rest = F.expr(f"source_size div {block}"), F.expr("words % source_size")
    src = src.withColumns({"full": full, "per_pass": F.expr(f"(source_size + {block - 1}) div {block}")})
    count = F.expr("words div source_size") * F.col("per_pass") + F.ceil(rest / F.lit(block)).cast("bigint")
    src = src.withColumn("count", count).where("count > 0")
    # Slots are unfolded in two steps, so that no single row grows with the source.
    chunks = src.withColumn("chunk", F.explode(F.sequence(_long(0), F.expr(f"(count - 1) div {CHUNK}")))).repartition("n", "chunk")
    to = F.least(F.col("count"), (F.col("chunk") + 1) * CHUNK) - 1
    slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("chunk") * CHUNK, to)))
    slots = slots.withColumns({"pass": F.expr("slot div per_pass"), "r": F.expr("slot % per_pass")})
    key = (_long(seed), F.col("n"), F.col("pass"))
    index = F.when(F.col("r") == F.col("full"), F.col("full")).otherwise(permuted(F.col("r"), F.col("full"), *key))
    length = F.least(_long(block), F.col("source_size") - F.col("r") * block)
    left = F.col("words") - F.col("pass") * F.col("source_size") - F.col("r") * block
    return slots.select(
        "n",
        "slot",
        F.pmod(F.xxhash64(_long(seed + 2), "n", "slot"), F.lit(shards)).cast("int").alias("shard"),
        F.col("pass").cast("int").alias("pass"),
        index.alias("block"),
        F.least(length, left).alias("take"),
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: the same columns, one row for each run of words taken.

    A document taken whole keeps its text as it is; of others each unbroken run of words
    becomes a row with that part of the text, and ``n_chars``, where it is a column, is its length.
    """
    taken = mix(docs, text_col=text_col, **options)
    own, first, count, size = (free_name(c, docs.columns) for c in ("_row", "_first", "_words", "_size"))
    order = W.partitionBy("row", "pass").orderBy("first_word")
    cut = (F.col("first_word") != F.lag(F.col("first_word") + F.col("words")).over(order)).cast("int")
    runs = (
        taken.pieces.withColumn("cut", F.coalesce(cut, F.lit(0)))
        .withColumn("run", F.sum("cut").over(order))
        .groupBy("row", "pass", "run")
        .agg(F.min("first_word").alias(first), F.sum("words").alias(count))
        .select(F.col("row").alias(own), first, count)
        .join(taken.documents.select(F.col("row").alias(own), F.col("size").alias(size)), own)
    )
    whole = docs.withColumn(own, F.monotonically_increasing_id()).join(runs, own)
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, (F.col(first) + 1).cast("int"), F.col(count).cast("int")), "")
    whole = whole.withColumn(text_col, F.when(F.col(count) == F.col(size), F.col(text_col)).otherwise(part))
    if "n_chars" in docs.columns:
        whole = whole.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return whole.select(*docs.columns)
