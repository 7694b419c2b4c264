"""Equal-frequency binning: exact cut points, labels, bin contents."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import sql_number
from ..session import materialise
from ..spec import COMPANY, PARTNER
from .align import psi_join
from .prep import merged_columns
from .wide_quantiles import wide_quantiles

# Default number of cut points and decimals kept of a cut point.
DEFAULT_K = 50
EDGE_DECIMALS = 3

APPROX_ACCURACY = 10_000
# A sketch of this size errs by about 0.05 % of the rows; the slack around a rank is twice that.
SKETCH_K = 8192
SLACK = 0.001
GRID = 500
FETCH_ROWS = 100_000
COLUMNS_AT_ONCE = 64


@dataclass(frozen=True)
class Edges:
    """k cut points per feature, kept in full even where they repeat.

    Bounded by the schema (features x k numbers), so it lives on the driver.
    """

    cuts: dict[str, tuple[float, ...]]

    @property
    def features(self) -> list[str]:
        return list(self.cuts)

    def merge(self, other: Edges) -> Edges:
        """Both parties' edges; a feature name of both is an error, as one would be lost."""
        both = set(self.cuts) & set(other.cuts)
        if both:
            raise ValueError(f"edges of both parties for {sorted(both)}: give their features different names")
        return Edges({**self.cuts, **other.cuts})

    def table(self, spark) -> DataFrame:
        rows = [(f, i, float(e)) for f, es in self.cuts.items() for i, e in enumerate(es)]
        return spark.createDataFrame(rows, "feature string, edge_idx int, edge double")


# --- cut points --------------------------------------------------------------------------------


def cut_probabilities(k: int) -> list[float]:
    return [(i + 1) / (k + 1) for i in range(k)]


def quantile_edges(df: DataFrame, columns: list[str], k: int = DEFAULT_K, method: str = "exact") -> Edges:
    """Cut points at (i+1)/(k+1) of every column, linearly interpolated, three decimals.

    ``method="exact"`` is exact at any size, see :func:`exact_quantiles`. ``"approx"`` takes
    elements from a quantile sketch instead: one pass, not interpolated, to be asked for.
    """
    if k < 1:
        raise ValueError("k must be positive")
    probs = cut_probabilities(k)
    if method == "approx":
        found = df.agg(*[F.percentile_approx(c, probs, APPROX_ACCURACY).alias(c) for c in columns]).first()
        values = {c: found[c] for c in columns}
    elif method == "exact":
        values = exact_quantiles(df, columns, probs)
    else:
        raise ValueError(f"unknown method {method!r}")
    missing = [c for c in columns if values[c] is None]
    if missing:
        raise ValueError(f"no values to cut in {missing}")
    return Edges({c: tuple(float(x) for x in np.round(values[c], EDGE_DECIMALS)) for c in columns})


def array_edges(df: DataFrame, column: str, k: int = DEFAULT_K, prefix: str = "x") -> Edges:
    """As ``quantile_edges`` for every place of an array column, whose features are x0, x1, ...

    All arrays must have one length, that of the first row met.
    """
    first = df.select(F.size(column).alias("n")).first()
    width = first["n"] if first else 0
    values = wide_quantiles(df, F.col(column), width, cut_probabilities(k), _Search)
    if not width or any(v is None for v in values):
        raise ValueError(f"no values to cut in {column}")
    return Edges({f"{prefix}{i}": tuple(float(x) for x in np.round(v, EDGE_DECIMALS)) for i, v in enumerate(values)})


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], fetch_rows: int = FETCH_ROWS, sketch_k: int = SKETCH_K
) -> dict[str, list[float] | None]:
    """Exact interpolated quantiles of many columns; nulls and NaN do not count.

    The wanted ranks are closed in on. A sketch proposes cut values around them, one counting
    pass says exactly how many rows lie at and between the cuts, and only the few values
    between the two cuts next to a rank are looked at; while those are still more than
    ``fetch_rows``, their stretches are sketched and counted again. Passes (three, as a rule)
    read the columns and shuffle counts. Many columns are searched together as one matrix, see
    ``wide_quantiles``. Nothing is sorted or gathered, and a sketch's error
    affects the number of passes, never the result.
    """
    if len(columns) > COLUMNS_AT_ONCE:
        return dict(zip(columns, wide_quantiles(df, F.expr(f"array({', '.join(f'CAST(`{c}` AS DOUBLE)' for c in columns)})"), len(columns), probs, _Search)))
    return dict(zip(columns, _quantiles(df, columns, probs, fetch_rows, sketch_k)))


def _quantiles(df: DataFrame, columns: list[str], probs: list[float], fetch_rows: int, sketch_k: int) -> list[list[float] | None]:
    # Expressions over many columns are written as text: building them call by call takes longer
    # than running them on a small table.
    wide = df.selectExpr(*[f"{_plain(c)} AS q{i}" for i, c in enumerate(columns)])
    around = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-SLACK, SLACK)})
    asks = []
    for i in range(len(columns)):
        values = _sketch_values(f"kll_sketch_agg_double(q{i}, {sketch_k})", around)
        asks += [f"count(q{i}) AS n{i}", f"CASE WHEN count(q{i}) > 0 THEN {values} END AS c{i}"]
    seen = wide.selectExpr(*asks).first()
    found = [_Search(i, seen[f"n{i}"], probs, set(seen[f"c{i}"] or ())) for i in range(len(columns))]
    _count(wide, found)
    while any(s.open for s in found):
        if sum(rows for s in found for _, _, rows in s.open) <= fetch_rows:
            _fetch(wide, found)
            break
        _propose(wide, found, sketch_k)
        _count(wide, found)
    return [s.result() for s in found]


def _plain(column: str) -> str:
    """As double, NaN as null. Adding 0.0 turns -0.0 into 0.0, so equal values have one form."""
    x = f"(CAST(`{column}` AS DOUBLE) + 0.0D)"
    return f"CASE WHEN NOT isnan{x} THEN {x} END"


def _sketch_values(sketch: str, fractions: list[float]) -> str:
    return f"kll_sketch_get_quantile_double({sketch}, array({', '.join(map(sql_number, fractions))}))"


def _unfold(cells: list[str]) -> str:
    """One row per cell, for long tables out of wide ones."""
    return f"explode(array({', '.join(cells)})) AS c"


class _Search:
    """Where the wanted ranks of one column may lie: cut values, and stretches between cuts.

    Segment 2m lies between cut m - 1 and cut m, segment 2m + 1 is cut m itself.
    """

    def __init__(self, index: int, rows: int, probs: list[float], cuts: set[float]):
        self.index, self.rows, self.cuts = index, rows, cuts
        self.places = [(rows - 1) * p for p in probs] if rows else []
        self.wanted = {math.floor(h) for h in self.places} | {math.ceil(h) for h in self.places}
        self.known: dict[int, float] = {}
        # (segment, rows before it, rows in it)
        self.open: list[tuple[int, int, int]] = []

    def ranks(self, before: int, rows: int) -> list[int]:
        return [r for r in self.wanted if before <= r < before + rows]

    def counted(self, counts: dict[int, int]) -> None:
        """Note ranks that fall on a cut; keep the stretches in which others lie."""
        values, before, self.open = sorted(self.cuts), 0, []
        for seg in sorted(counts):
            rows = counts[seg]
            if seg % 2:
                self.known |= dict.fromkeys(self.ranks(before, rows), values[seg // 2])
            elif self.ranks(before, rows):
                self.open.append((seg, before, rows))
            before += rows

    def result(self) -> list[float] | None:
        at = lambda h: self.known[math.floor(h)] + (self.known[math.ceil(h)] - self.known[math.floor(h)]) * (h - math.floor(h))
        return [at(h) for h in self.places] if self.rows else None


def _segments(wide: DataFrame, found: list[_Search]) -> DataFrame:
    """Long table (col, seg, x) of all values."""
    live = [s for s in found if s.cuts]
    asks = [(f"q{s.index}_{n}", f"q{s.index}", sorted(s.cuts), n == "le") for s in live for n in ("lt", "le")]
    both = count_below(wide, asks)
    cells = [f"struct({i} AS col, q{i}_lt + q{i}_le AS seg, q{i} AS x)" for i in (s.index for s in live)]
    return both.selectExpr(_unfold(cells)).select("c.*").where("seg IS NOT NULL")


def _count(wide: DataFrame, found: list[_Search]) -> None:
    if not any(s.cuts for s in found):
        return
    counts: dict[int, dict[int, int]] = {}
    for r in _segments(wide, found).groupBy("col", "seg").count().collect():
        counts.setdefault(r["col"], {})[r["seg"]] = r["count"]
    for s in found:
        s.counted(counts.get(s.index, {}))


def _open_values(wide: DataFrame, found: list[_Search]) -> DataFrame:
    """Rows of the long table that lie in open stretches."""
    keep = [f"(col = {s.index} AND seg IN ({', '.join(str(seg) for seg, _, _ in s.open)}))" for s in found if s.open]
    return _segments(wide, [s for s in found if s.open]).where(" OR ".join(keep))


def _propose(wide: DataFrame, found: list[_Search], sketch_k: int) -> None:
    """Add the grid values on both sides of every wanted rank, from a sketch per open stretch."""
    grid = [i / GRID for i in range(GRID + 1)]
    sketches = _open_values(wide, found).groupBy("col", "seg").agg(F.expr(f"kll_sketch_agg_double(x, {sketch_k})").alias("s"))
    for r in sketches.selectExpr("col", "seg", f"{_sketch_values('s', grid)} AS v").collect():
        search = found[r["col"]]
        before, rows = next((b, n) for seg, b, n in search.open if seg == r["seg"])
        for rank in search.ranks(before, rows):
            at = (rank - before + 0.5) / rows * GRID
            search.cuts |= {r["v"][max(0, math.floor(at) - 1)], r["v"][min(GRID, math.ceil(at) + 1)]}


def _fetch(wide: DataFrame, found: list[_Search]) -> None:
    """Read the values of the open stretches, which are counted to be few."""
    runs: dict[tuple[int, int], list[tuple[float, int]]] = {}
    for r in _open_values(wide, found).groupBy("col", "seg", "x").count().collect():
        runs.setdefault((r["col"], r["seg"]), []).append((r["x"], r["count"]))
    for s in found:
        for seg, before, _ in s.open:
            for value, rows in sorted(runs[s.index, seg]):
                s.known |= dict.fromkeys(s.ranks(before, rows), value)
                before += rows


# --- labels ------------------------------------------------------------------------------------


def count_below(df: DataFrame, asks: list[tuple[str, str, list[float], bool]]) -> DataFrame:
    """Add counts of cuts: (new column, column, sorted cuts, whether a cut equal to the value counts).

    The library's ``Bucketizer`` looks values up by binary search, for any number of cuts in
    the same compiled code. Its buckets are closed on the left; closed on the right, as wanted
    for "strictly below", they come from negated values and cuts. Null and NaN give null.
    """
    if not asks:
        return df
    inputs, outputs, bounds, ready, found = [], [], [], [], []
    for out, column, cuts, equal in asks:
        keys = sorted({float(x) + 0.0 for x in cuts if math.isfinite(x)})
        # Infinite cuts are outside the search: one at the bottom counts for all values but, where
        # equal ones do not count, itself; one at the top for itself only, where equal ones count.
        bottom, top = sum(x == -math.inf for x in cuts), sum(x == math.inf for x in cuts)
        edge = []
        if bottom:
            edge.append(f" + {bottom}" if equal else f" + if({_plain(column)} > double('-Infinity'), {bottom}, 0)")
        if top and equal:
            edge.append(f" + if({_plain(column)} = double('Infinity'), {top}, 0)")
        if not keys:
            given = f"{_plain(column)} IS NULL OR isnan({_plain(column)})"
            found.append(f"if({given}, CAST(NULL AS INT), CAST(0{''.join(edge)} AS INT)) AS `{out}`")
            continue
        inputs.append(f"{out}_in")
        outputs.append(f"{out}_at")
        bounds.append([-math.inf, *(keys if equal else [0.0 - x for x in reversed(keys)]), math.inf])
        ready.append(f"{'' if equal else '0.0D - '}{_plain(column)} AS `{out}_in`")
        place = f"CAST(`{out}_at` AS INT)"
        distinct = place if equal else f"({len(keys)} - {place})"
        # Repeated cuts count as often as they occur.
        finite = [x for x in cuts if math.isfinite(x)]
        upto = [0, *(bisect_right(finite, key) for key in keys)]
        repeated = len(keys) < len(finite)
        # A missing value has a bucket of its own, outside the array.
        place = f"get(array({', '.join(map(str, upto))}), {distinct})" if repeated else f"if({_plain(column)} IS NULL, NULL, {distinct})"
        found.append(f"{place}{''.join(edge)} AS `{out}`")
    if not inputs:
        return df.selectExpr(*[f"`{c}`" for c in df.columns], *found)
    search = Bucketizer(splitsArray=bounds, inputCols=inputs, outputCols=outputs, handleInvalid="keep")
    placed = search.transform(df.selectExpr("*", *ready))
    return placed.selectExpr(*[f"`{c}`" for c in df.columns], *found)


def bin_label(df: DataFrame, edges: Edges, suffix: str = "_bin") -> DataFrame:
    """Add a label per feature: the smallest i with x <= edge i, else k. Missing stays null."""
    return count_below(df, [(f + suffix, f, sorted(c), False) for f, c in edges.cuts.items()])


def bin_edge_join(df: DataFrame, id: str, edges: Edges) -> DataFrame:
    """Long table of (id, feature, bin, left, right]: the bin of a value with its bounds.

    The range predicate is answered per row by the label expression, so no range join runs.
    """

    def cell(f: str) -> Column:
        arr = F.array(*[F.lit(float(e)) for e in edges.cuts[f]])
        label = F.col(f"{f}_bin")
        left = F.when(label > 0, F.element_at(arr, F.when(label > 0, label).otherwise(F.lit(1))))
        k = len(edges.cuts[f])
        right = F.when(label < k, F.element_at(arr, F.when(label < k, label + 1).otherwise(F.lit(1))))
        return F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), label.alias("bin"), left.alias("left"), right.alias("right"))

    labelled = bin_label(df.select(id, *edges.features), edges)
    return labelled.select(id, F.explode(F.array(*map(cell, edges.features))).alias("c")).select(id, "c.*")


def long_bins(df: DataFrame, id: str, features: list[str], suffix: str = "_bin") -> DataFrame:
    """Bin labels as (id, feature, bin)."""
    cells = [f"struct('{f}' AS feature, `{f}{suffix}` AS bin)" for f in features]
    return df.selectExpr(f"`{id}`", _unfold(cells)).select(id, "c.feature", "c.bin")


def bin_counts(df: DataFrame, features: list[str], suffix: str = "_bin") -> DataFrame:
    """Rows per non-empty (feature, bin)."""
    cells = [f"struct('{f}' AS feature, `{f}{suffix}` AS bin)" for f in features]
    long = df.selectExpr(_unfold(cells)).select("c.feature", "c.bin")
    return long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def bin_members(df: DataFrame, features: list[str], suffix: str = "_bin") -> DataFrame:
    """Rows per (feature, bin), empty bins up to the feature's highest label included.

    The members themselves are the rows with that label: ask :func:`long_bins` for them.
    """
    counts = bin_counts(df, features, suffix).where(F.col("bin").isNotNull())
    top = counts.groupBy("feature").agg(F.max("bin").alias("top"))
    every = top.select("feature", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("bin"))
    return every.join(counts, ["feature", "bin"], "left").select("feature", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def bin_compact_edges(df: DataFrame, edges: Edges) -> DataFrame:
    """Edges of non-empty bins only, numbered anew. For reports: training keeps all edges."""
    filled = bin_counts(bin_label(df, edges), edges.features)
    kept = edges.table(df.sparkSession).join(
        filled.select("feature", F.col("bin").alias("edge_idx")), ["feature", "edge_idx"], "left_semi"
    )
    # At most k rows per feature take part in the numbering.
    return kept.selectExpr("feature", "edge", "int(row_number() OVER (PARTITION BY feature ORDER BY edge_idx) - 1) AS edge_idx")


def bin_before_join(
    company: DataFrame,
    partner: DataFrame,
    company_features: list[str],
    partner_features: list[str],
    k: int = DEFAULT_K,
    on: str = "id",
    method: str = "exact",
    skew: str = "aqe",
    write: bool = True,
) -> tuple[DataFrame, Edges]:
    """Cut each party's whole table, then let values and labels travel through the join.

    A party's table is read by every quantile pass and once more for its labels. ``write``
    stores it as Parquet first; switch it off for tables that are plain Parquet already.
    """
    if write:
        company, partner = materialise(company, "company"), materialise(partner, "partner")
    c_edges = quantile_edges(company, company_features, k, method)
    p_edges = quantile_edges(partner, partner_features, k, method)
    ours, theirs = bin_label(company, c_edges), bin_label(partner, p_edges)
    named = {(party, x): out for party, x, out in merged_columns(ours.columns, theirs.columns, on)}
    # Under the names that the columns have in the joined table.
    out = Edges({named[COMPANY, f]: c for f, c in c_edges.cuts.items()}).merge(Edges({named[PARTNER, f]: c for f, c in p_edges.cuts.items()}))
    return psi_join(ours, theirs, on, skew), out
