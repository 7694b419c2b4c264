"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from math import ceil, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import lower_ascii, text_or_empty

RUN_BITS = 33
_RUNS = "row bigint, idx bigint, n bigint, part bigint, run bigint, edge binary"


def _number_runs(batches):
    """Number the runs of equal blocks of a partition sorted by (h, block).

    The distinct blocks of the first and the last ``h`` are also given out as edge rows: the
    same blocks may stand in the partitions beside this one.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    run, last_h, last, first_done, here = -1, None, None, False, []

    def edges(found):
        k = len(found)
        none = [None] * k
        return pa.RecordBatch.from_arrays(
            [
                pa.array(none, pa.int64()),
                pa.array(none, pa.int64()),
                pa.array(none, pa.int64()),
                pa.array([part] * k, pa.int64()),
                pa.array([r for r, _ in found], pa.int64()),
                pa.array([b for _, b in found], pa.binary()),
            ],
            names=["row", "idx", "n", "part", "run", "edge"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        hashes, blocks, runs = batch.column(3).to_pylist(), batch.column(4), []
        for i, h in enumerate(hashes):
            if h != last_h:
                if last_h is not None and not first_done:
                    yield edges(here)
                    first_done = True
                last_h, here, last = h, [], None
            # Blocks are only looked at where their fingerprints agree.
            block = blocks[i].as_py()
            if last is None or block != last:
                run += 1
                last = block
                here.append((run, block))
            runs.append(run)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                batch.column(2),
                pa.array([part] * len(runs), pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array([None] * len(runs), pa.binary()),
            ],
            names=["row", "idx", "n", "part", "run", "edge"],
        )
    if here:
        yield edges(here)


def name_blocks(blocks: DataFrame) -> DataFrame:
    """Integer names for (row, idx, n, block): equal names exactly where blocks are equal.

    The rows are sorted by range over (fingerprint, row), so a block that a third of all rows
    share spreads over partitions. Names are numbers of runs in the sorted order; a block at a
    partition's border takes the name of its first run. Comparisons are of whole blocks.
    """
    keyed = blocks.select("row", "idx", "n", F.xxhash64("block").alias("h"), "block")
    ordered = keyed.repartitionByRange("h", "row", "idx").sortWithinPartitions("h", "block")
    out = materialise(ordered.mapInArrow(_number_runs, _RUNS), "names")
    edge = out.where(F.col("edge").isNotNull()).select("part", "run", "edge")
    first = edge.groupBy("edge").agg(F.min(F.struct("part", "run")).alias("first"))
    # Two rows for each partition at most, besides fingerprints that collide there.
    moved = (
        edge.join(first, "edge")
        .where((F.col("first.part") != F.col("part")) | (F.col("first.run") != F.col("run")))
        .select("part", "run", _name(F.col("first.part"), F.col("first.run")).alias("moved"))
        .distinct()
    )
    return (
        out.where(F.col("row").isNotNull())
        .join(F.broadcast(moved), ["part", "run"], "left")
        .select("row", "idx", "n", F.coalesce("moved", _name(F.col("part"), F.col("run"))).alias("name"))
    )


def _name(part, run):
    return F.shiftleft(part, RUN_BITS) + run


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Fixed-size blocks of the text; an empty text has one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block_bytes))).cast("bigint")
    raw = F.col("text").cast("binary")
    return docs.select("row", n.alias("n"), raw.alias("raw"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("idx")).select(
        "row", "idx", "n", F.expr(f"substring(raw, cast(idx * {block_bytes} as int) + 1, {block_bytes})").alias("block")
    )


def identities(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """(row, level, name) for documents (row, text): equal (level, name) exactly for equal texts.

    Blocks get names, then adjacent names are paired and named again until one is left; a
    document is done at the level its number of blocks needs, and the level is part of the
    identity. Every level halves the rows and only level 0 moves text.
    """
    named = name_blocks(_blocks(docs, block_bytes))
    most = named.agg(F.max("n")).first()[0] or 1
    done = []
    for level in range(ceil(log2(most)) + 1):
        done.append(named.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if level == ceil(log2(most)):
            break
        pairs = (
            named.where("n > 1")
            .groupBy("row", F.expr("idx div 2").alias("idx"))
            .agg(
                F.expr("(max(n) + 1) div 2").alias("n"),
                F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("a"),
                F.max(F.expr("if(idx % 2 = 1, name, null)")).alias("b"),
            )
        )
        named = name_blocks(pairs.select("row", "idx", "n", F.concat_ws(",", "a", "b").cast("binary").alias("block")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Groups of documents whose texts agree after lower-casing A to Z, and the one that stays.

    Gives (id_col, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.
    Of equal texts the row with the largest id stays. A null text counts as empty, an empty text
    is a text like others, a null id is smaller than any id; of rows that share text and id one
    stays. Other columns are not read. ``docs`` should be a stored table: rows are told apart by
    their place in it.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), lower_ascii(text_or_empty(text_col)).alias("text")
    )
    facts = materialise(rows.select("row", "id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "facts")
    named = materialise(identities(rows.select("row", "text"), block_bytes).join(facts, "row"), "identities")
    # Only groups of several rows; written, so that the join below splits hot groups.
    groups = materialise(
        named.groupBy("level", "name")
        .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "row")).alias("keep"))
        .where("size > 1"),
        "groups",
    )
    stays = F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True))
    return named.join(groups, ["level", "name"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        stays.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
