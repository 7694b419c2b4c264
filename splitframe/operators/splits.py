"""Gradient histograms, split search and row routing for trees."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: gains are ranked after rounding, so float noise does not decide ties.
GAIN_DECIMALS = 6

# Splits of a level that are written as one CASE.
INLINE_SPLITS = 32
# Heap numbers listed for each split at most; in a sparser level only the nodes that are split are listed.
SPREAD = 16


def gh_total(df: DataFrame, by: list[str], g: str = "g", h: str = "h") -> DataFrame:
    """Sum of gradients and hessians per node."""
    return df.groupBy(*by).agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count(F.lit(1)).alias("n"))


def gh_histogram(df: DataFrame, bins: list[str], by: tuple[str, ...] = ("node",), g: str = "g", h: str = "h") -> DataFrame:
    """Sum of gradients and hessians per (node, feature, bin); features count from 0.

    Rows are unfolded inside the task and summed before the shuffle, so what moves is bounded
    by tasks x nodes x features x bins, however many rows share a bin.
    """
    cells = ", ".join(f"struct({i} AS feature, `{b}` AS bin)" for i, b in enumerate(bins))
    long = df.select(*by, F.col(g).alias("g"), F.col(h).alias("h"), F.expr(f"explode(array({cells}))").alias("c"))
    return (
        long.select(*by, "c.feature", "c.bin", "g", "h")
        .groupBy(*by, "feature", "bin")
        .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    )


def split_prefix_sums(histogram: DataFrame, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """Sums left of and right of every cut: bins up to the cut go left, the rest goes right.

    Missing values (null bin) sort last and so count as right. Cuts without values on both
    sides are left out, which removes the last bin. A window sees one feature's bins only.
    """
    w = Window.partitionBy(*by, "feature")
    upto = w.orderBy(F.col("bin").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"{c}_l": F.sum(c).over(upto) for c in ("g", "h", "n")} | {f"{c}_all": F.sum(c).over(w) for c in ("g", "h", "n")}
    sums["present"] = F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).over(w)
    both = histogram.select(*by, "feature", "bin", *[v.alias(k) for k, v in sums.items()])
    right = [(F.col(f"{c}_all") - F.col(f"{c}_l")).alias(f"{c}_r") for c in ("g", "h", "n")]
    return both.select(*by, "feature", "bin", "g_l", "h_l", "n_l", *right, "present").where(
        F.col("bin").isNotNull() & (F.col("n_l") < F.col("present"))
    ).drop("present")


def split_gain(g_l: Column, h_l: Column, g_r: Column, h_r: Column, lambda_: float, gamma: float | None = None) -> Column:
    """Half the drop in loss by a split, less a penalty, which is lambda unless given.

    Null where a denominator is 0 (lambda 0 and no curvature); such a cut is never chosen.
    """
    lam = F.lit(float(lambda_))
    score = lambda g, h: F.try_divide(g * g, h + lam)
    drop = score(g_l, h_l) + score(g_r, h_r) - score(g_l + g_r, h_l + h_r)
    return F.lit(0.5) * drop - F.lit(float(lambda_ if gamma is None else gamma))


def leaf_weight(g: Column, h: Column, lambda_: float) -> Column:
    """``-G / (H + lambda)``; 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(-g, h + F.lit(float(lambda_))), F.lit(0.0))


def best_split(prefix: DataFrame, lambda_: float, gamma: float | None = None, by: tuple[str, ...] = ("node",)) -> DataFrame:
    """Cut with the highest gain per node; the lowest feature, then bin, on a tie.

    An aggregate with map-side combining, so no node's candidates are sorted or gathered.
    """
    gain = split_gain(F.col("g_l"), F.col("h_l"), F.col("g_r"), F.col("h_r"), lambda_, gamma)
    rated = prefix.withColumn("gain", gain)
    kept = ["feature", "bin", "gain", "g_l", "h_l", "n_l", "g_r", "h_r", "n_r"]
    rank = F.struct(F.round("gain", GAIN_DECIMALS), -F.col("feature"), -F.col("bin"))
    best = rated.groupBy(*by).agg(F.max_by(F.struct(*kept), rank).alias("b"))
    return best.select(*by, "b.*")


def split_or_leaf(best: DataFrame, depth: int, max_depth: int) -> DataFrame:
    """Mark whether a node is split: positive gain and depth left."""
    gains = F.coalesce(F.round("gain", GAIN_DECIMALS) > 0, F.lit(False))
    return best.withColumn("is_split", gains & F.lit(depth < max_depth))


def route(node: Column, value: Column, cut: float | int | Column) -> Column:
    """Child of a split node: left if the value is at most the cut, otherwise (or null) right."""
    left = node * F.lit(2)
    return F.when(value <= F.lit(cut), left).otherwise(left + F.lit(1))


def tree_route(df: DataFrame, splits: list[dict], node: str = "node", column: str = "bin") -> DataFrame:
    """Move every row one level down. ``splits``: dicts of node, feature name and cut.

    Children of node n are 2n and 2n + 1. Rows of nodes that are not split stay. Few splits become one
    CASE; a wider level is looked up by node in literal arrays. No join: the optimizer would infer
    filters for it from all levels below, which grow with every way through them.
    """
    if len(splits) <= INLINE_SPLITS:
        moved = F.col(node)
        for s in splits:
            moved = F.when(F.col(node) == s["node"], route(F.col(node), F.col(s["feature"]), s[column])).otherwise(moved)
        return df.withColumn(node, moved)
    names = sorted({s["feature"] for s in splits})
    by = {s["node"]: s for s in splits}
    low, high = min(by), max(by)
    dense = high - low < SPREAD * len(by)
    listed = range(low, high + 1) if dense else sorted(by)
    feature = _literals([names.index(by[n]["feature"]) if n in by else -1 for n in listed], "int")
    cut = _literals([float(by[n][column]) if n in by else 0.0 for n in listed], "double")
    place = F.col(node) - low if dense else F.array_position(_literals(listed, "bigint"), F.col(node).cast("bigint")) - 1
    known = F.when(F.col(node).between(low, high), place)
    values = F.array(*[F.col(n).cast("double") for n in names])
    slot = F.coalesce(F.get(feature, known), F.lit(-1))
    return df.withColumn(node, F.when(slot < 0, F.col(node)).otherwise(route(F.col(node), F.get(values, slot), F.get(cut, known))))


def _literals(values: Iterable, kind: str) -> Column:
    """An array that the optimizer folds into one literal, whatever its length."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
