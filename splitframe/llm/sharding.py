"""Shards of equal size by sampled splitters."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.position import global_position
from ..session import materialise
from .common import unit

LOWEST, HIGHEST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Splitters:
    """Ascending lower bounds (key, tie) of all ranges but the first."""

    keys: np.ndarray
    ties: np.ndarray

    @staticmethod
    def of(pairs: list[tuple[int, int]]) -> Splitters:
        pairs = sorted(set(pairs))
        return Splitters(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))

    def pairs(self) -> list[tuple[int, int]]:
        return list(zip(self.keys.tolist(), self.ties.tolist()))

    def find(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Number of bounds at or below each (key, tie): the range it falls in."""
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        out = low.copy()
        inside = np.flatnonzero(high > low)
        for a in np.unique(low[inside]):
            at = inside[low[inside] == a]
            out[at] = a + np.searchsorted(self.ties[a : high[at[0]]], tie[at], "right")
        return out

    def column(self) -> Column:
        @F.pandas_udf("int")
        def found(key: pd.Series, tie: pd.Series) -> pd.Series:
            return pd.Series(self.find(key.to_numpy(np.int64), tie.to_numpy(np.int64)).astype(np.int32))

        return found("_key", "_tie")


def _sampled(rows: DataFrame, step: float, seed: int) -> list[tuple[int, int, float]]:
    """Rows drawn with probability ``size / step``; what a row stands for is size over probability."""
    chance = F.least(F.lit(1.0), F.col("_size") / F.lit(step))
    drawn = rows.where(unit(F.lit(seed), "_key", "_tie") < chance).groupBy("_key", "_tie").agg(F.sum(F.col("_size") / chance).alias("w"))
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _quantiles(sample: list[tuple[int, int, float]], step: float) -> list[tuple[int, int]]:
    """Units (key, tie) of the sample at every ``step`` of its weight; one that weighs a step is a range of its own."""
    out, seen, due = [], 0.0, step
    for (key, tie), rows in groupby(sample, key=lambda r: r[:2]):
        weight = sum(r[2] for r in rows)
        if seen >= due or weight >= step:
            out.append((key, tie))
            due = max(due, step * (int(seen / step) + 1))
        if weight >= step and tie < HIGHEST:
            out.append((key, tie + 1))
        seen += weight
    return out


def choose_splitters(
    rows: DataFrame, shards: int, per_shard: int = 32, per_range: int = 8, whole_share: float = 0.05, seed: int = 7
) -> Splitters:
    """Bounds of ``shards`` ranges of (_key, _tie) with nearly equal sums of _size.

    A size-weighted sample of about ``shards * per_shard * per_range`` keys gives ``per_shard``
    fine ranges a shard. They are weighed exactly; one of twice the due weight is sampled more
    densely and subdivided, until none is left but those of one unit. Shard bounds are the fine
    bounds nearest to equal sums. A bound inside the rows of one key moves to their end if they
    weigh under ``whole_share`` of a shard, so such groups stay together. The driver holds the sample and a number for each fine range.
    """
    total = rows.agg(F.sum("_size")).first()[0] or 0
    if not total or shards < 2:
        return Splitters.of([])
    due = total / (shards * per_shard)
    cuts = Splitters.of(_quantiles(_sampled(rows, due / per_range, seed), due))
    for again in count():
        found = rows.groupBy(cuts.column().alias("range")).agg(F.sum("_size").alias("w"), F.count_distinct("_key", "_tie").alias("keys"))
        weights = {r["range"]: (r["w"], r["keys"]) for r in found.collect()}
        over = [k for k, (w, keys) in weights.items() if w > 2 * due and keys > 1]
        if not over:
            break
        inside = rows.where(cuts.column().isin(over))
        more = _sampled(inside, due / per_range / 2 ** (again + 1), seed + again + 1)
        at = cuts.find(np.array([r[0] for r in more], np.int64), np.array([r[1] for r in more], np.int64))
        new = [b for k in over for b in _quantiles([r for r, x in zip(more, at) if x == k], due)]
        finer = Splitters.of(cuts.pairs() + new)
        if len(finer.keys) == len(cuts.keys) and due / per_range < 2**again:
            break  # every row was drawn
        cuts = finer
    edges, sums = cuts.pairs(), np.cumsum([weights.get(k, (0, 0))[0] for k in range(len(cuts.keys) + 1)])[:-1].astype(float)
    if not edges:
        return cuts
    share = total / shards
    bounds = sorted({edges[int(np.argmin(np.abs(sums - share * k)))] for k in range(1, shards)})
    return Splitters.of(_whole_groups(rows, bounds, share * whole_share))


def _whole_groups(rows: DataFrame, bounds: list[tuple[int, int]], most: float) -> list[tuple[int, int]]:
    """Move bounds that cut a light group to its nearer end."""
    cut = {k: t for k, t in bounds}
    before = F.lit(False)
    for k, t in cut.items():
        before = before | ((F.col("_key") == k) & (F.col("_tie") < t))
    found = rows.where(F.col("_key").isin(list(cut))).groupBy("_key").agg(F.sum("_size").alias("all"), F.sum(F.when(before, F.col("_size")).otherwise(0)).alias("low"))
    out = []
    weights = {r["_key"]: (r["all"], r["low"]) for r in found.collect()}
    for k, t in bounds:
        whole, low = weights.get(k, (0, 0))
        if not low or whole > most:
            out.append((k, t))
        else:
            out.append((k, LOWEST) if low <= whole - low or k == 2**63 - 1 else (k + 1, LOWEST))
    return out


def shard(rows: DataFrame, shards: int, key: Column, size: Column, tie: Column) -> DataFrame:
    """``rows`` with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Sums of ``size`` (at least 1) are nearly equal. Rows are dealt by ranges of ``key`` (a long;
    a hash of what should stay together), and ``tie`` (a long) orders rows of one key. Rows equal
    in both are one unit, in a defined shard but any order. An empty table gives an empty table;
    nulls in key, size or tie are not allowed; columns named shard or slot are replaced, all others
    are kept whatever their names. All columns travel once, in one range shuffle.
    """
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    given = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("given")
    keyed = rows.select(given, key.alias("_key"), size.alias("_size"), tie.alias("_tie"))
    light = materialise(keyed.select("_key", "_size", "_tie"), "keys")
    dealt = keyed.withColumn("shard", choose_splitters(light, shards).column())
    placed = global_position(dealt, "shard", "_key", "_tie", out="slot")
    placed = materialise(placed, "placed")
    counts = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}
    first, starts = 0, []
    for k in range(shards):
        starts.append(first)
        first += counts.get(k, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("shard") + 1)
    return placed.select(*[F.col(f"given.`{c}`") for c in columns], "shard", (F.col("slot") - start).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
