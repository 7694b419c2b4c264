"""Exact quantiles of thousands of columns that come as one array value a row.

Three scans, whatever the width. Tasks sort chunks of the matrix and keep equally spaced values of
every column, which merge into one summary a column; the summaries propose cuts on both sides of
every wanted rank, and a second scan counts exactly what lies at and between them. The third sends
only the values between the cuts next to a rank, as arrays, to where the rank is picked. Stretches
of more than ``PICKED`` values are summarised and counted once more before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import matrix_of

# Values that a task sorts at once, values that the summaries of a task hold, and summaries that merge.
CHUNK_VALUES = 2_000_000
SUMMARY_VALUES = 1_000_000
FAN = 8
# Most values of one stretch that a task picks ranks from.
PICKED = 4_000_000


class _Pool:
    """Mergeable summaries of columns: ``points`` equally spaced values each; eight become one a level up."""

    def __init__(self, points: int):
        self.points = points
        self.levels: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def add(self, values: np.ndarray, rows: np.ndarray, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((values, rows))
        if len(self.levels[level]) == FAN:
            full, self.levels[level] = self.levels[level], []
            self.add(*self._merged(full), level + 1)

    def add_sorted(self, x: np.ndarray) -> None:
        """Add a sorted chunk, missing values last."""
        rows = len(x) - np.isnan(x).sum(axis=0)
        at = ((np.arange(self.points)[:, None] + 0.5) / self.points * rows).astype(np.int64)
        self.add(np.take_along_axis(x, np.minimum(at, len(x) - 1), 0), rows)

    def _merged(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        values, total = np.concatenate([v for v, _ in parts]), sum(r for _, r in parts)
        weights = np.concatenate([np.broadcast_to(r / len(v), v.shape) for v, r in parts])
        order = np.argsort(values, axis=0, kind="stable")
        values, upto = np.take_along_axis(values, order, 0), np.cumsum(np.take_along_axis(weights, order, 0), axis=0)
        wanted = (np.arange(self.points)[:, None] + 0.5) / self.points * total
        at = np.stack([np.searchsorted(upto[:, c], wanted[:, c]) for c in range(values.shape[1])], axis=1)
        return np.take_along_axis(values, np.minimum(at, len(values) - 1), 0), total

    def summary(self) -> tuple[np.ndarray, np.ndarray] | None:
        parts = [p for level in self.levels for p in level]
        return self._merged(parts) if parts else None


def _points(width: int) -> int:
    return max(128, min(8192, SUMMARY_VALUES // max(width, 1)))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows x columns, -0.0 as 0.0, in chunks of about ``CHUNK_VALUES``; columns are contiguous."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(matrix_of(batch, ["x"]) + 0.0)
            size += held[-1].size
            if size >= CHUNK_VALUES:
                yield np.asfortranarray(np.concatenate(held))
                held, size = [], 0
    if held:
        yield np.asfortranarray(np.concatenate(held))


def _lists(values: list[np.ndarray], kind: pa.DataType = pa.float64()) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str], value: str) -> Iterator[tuple[tuple, np.ndarray, int]]:
    """Rows of a sorted stream as (key, array, rows)."""
    for batch in batches:
        lists = batch.column(value)
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        rows = batch.column("rows").to_pylist() if "rows" in batch.schema.names else [0] * len(names)
        for i, key in enumerate(names):
            yield key, flat[ends[i] : ends[i + 1]], rows[i]


def _summaries(matrix: DataFrame, width: int, fractions: list[float]) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and values at the fractions of every column; a bounded result: width x fractions."""
    points = _points(width)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(points)
        for x in _chunks(batches):
            x.sort(axis=0)
            pool.add_sorted(x)
        found = pool.summary()
        if found:
            values, rows = found
            names = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(rows[names]), _lists([values[:, c] for c in names])], ["col", "rows", "v"])

    parts = matrix.mapInArrow(sketch, "col bigint, rows bigint, v array<double>").repartition("col").sortWithinPartitions("col")
    return {r["col"]: (r["rows"], np.array(r["v"])) for r in parts.mapInArrow(_merging(["col"], points, fractions), "col bigint, rows bigint, v array<double>").collect()}


def _merging(keys: list[str], points: int, fractions: list[float]):
    """Arrow function: summaries of a key in a row, to its number of rows and values at the fractions."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(key: tuple, pool: _Pool) -> pa.RecordBatch:
            values, rows = pool.summary()
            at = np.minimum((np.array(fractions) * len(values)).astype(int), len(values) - 1)
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([int(rows[0])]), _lists([values[at, 0]])], [*keys, "rows", "v"])

        name, pool = None, None
        for key, values, rows in _groups(batches, keys, "v"):
            if key != name:
                if name is not None:
                    yield closed(name, pool)
                name, pool = key, _Pool(points)
            if rows:
                pool.add(values[:, None], np.array([rows]))
            else:
                pool.add(np.sort(values)[:, None], np.array([len(values)]))
        if name is not None:
            yield closed(name, pool)

    return merge


def _counts(matrix: DataFrame, cuts: dict[int, list[float]]) -> dict[int, dict[int, int]]:
    """Rows by column and segment: 2m between cuts m - 1 and m, 2m + 1 at cut m."""
    bounds = {c: np.array(v) for c, v in cuts.items()}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros(2 * len(b) + 1, np.int64) for c, b in bounds.items()}
        for x in _chunks(batches):
            for c, b in bounds.items():
                sums[c] += np.bincount(_segment(x[:, c], b), minlength=len(sums[c]))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), _lists(list(sums.values()), pa.int64())], ["col", "v"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None
        for (col,), counts, _ in _groups(batches, ["col"], "v"):
            if col != name:
                if name is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), _lists([total], pa.int64())], ["col", "v"])
                name, total = col, np.zeros(len(counts), np.int64)
            total = total + counts
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), _lists([total], pa.int64())], ["col", "v"])

    kind = "col bigint, v array<bigint>"
    found = matrix.mapInArrow(count, kind).repartition("col").sortWithinPartitions("col").mapInArrow(add, kind).collect()
    return {r["col"]: {seg: n for seg, n in enumerate(r["v"]) if n} for r in found}


def _segment(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Segments of the values that are there."""
    x = x[~np.isnan(x)]
    return np.searchsorted(cuts, x, "left") + np.searchsorted(cuts, x, "right")


def _open_values(matrix: DataFrame, cuts: dict[int, list[float]], open_: dict[int, set[int]]) -> DataFrame:
    """Values of open stretches (col, seg, v), an array a stretch and chunk, sorted by stretch in partitions."""
    bounds = {c: (np.array(cuts[c]), np.isin(np.arange(2 * len(cuts[c]) + 1), list(segs))) for c, segs in open_.items()}

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _chunks(batches):
            cols, segs, values = [], [], []
            for c, (b, wanted) in bounds.items():
                seg = _segment(x[:, c], b)
                mine = np.flatnonzero(wanted[seg])
                if not len(mine):
                    continue
                here = x[:, c][~np.isnan(x[:, c])][mine]
                order = np.argsort(seg[mine], kind="stable")
                names, starts = np.unique(seg[mine][order], return_index=True)
                cols += [c] * len(names)
                segs += names.tolist()
                values += np.split(here[order], starts[1:])
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(cols, pa.int64()), pa.array(segs, pa.int64()), _lists(values)], ["col", "seg", "v"])

    return matrix.mapInArrow(select, "col bigint, seg bigint, v array<double>").repartition("col", "seg").sortWithinPartitions("col", "seg")


def _picked(values: DataFrame, ranks: dict[tuple[int, int], list[int]]) -> list:
    """(col, rank in the stretch, value) of the wanted ranks of every stretch."""

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(key: tuple, held: list[np.ndarray]) -> pa.RecordBatch:
            at = ranks[key]
            found = np.sort(np.concatenate(held))[at]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at)), pa.array([key[1]] * len(at)), pa.array(at, pa.int64()), pa.array(found)], ["col", "seg", "rank", "x"])

        name, held = None, []
        for key, part, _ in _groups(batches, ["col", "seg"], "v"):
            if key != name:
                if name is not None:
                    yield closed(name, held)
                name, held = key, []
            held.append(part)
        if name is not None:
            yield closed(name, held)

    return values.mapInArrow(pick, "col bigint, seg bigint, rank bigint, x double").collect()


def wide_quantiles(df: DataFrame, matrix: Column, width: int, probs: list[float], search, picked: int = PICKED) -> list[list[float] | None]:
    """Exact interpolated quantiles of every place of an array column; nulls and NaN do not count.

    ``search`` makes the bookkeeping of one column: (index, rows, probs, cuts).
    """
    x = df.select(matrix.cast("array<double>").alias("x"))
    slack = 2.0 / _points(width)
    around = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)})
    seen = _summaries(x, width, around)
    found = [search(c, seen[c][0] if c in seen else 0, probs, set(seen[c][1].tolist()) if c in seen else set()) for c in range(width)]
    while live := [s for s in found if s.rows and not s.wanted <= s.known.keys()]:
        counts = _counts(x, {s.index: sorted(s.cuts) for s in live})
        for s in live:
            s.counted(counts.get(s.index, {}))
        live = [s for s in live if s.open]
        if not live:
            break
        cuts, stretches = {s.index: sorted(s.cuts) for s in live}, {s.index: {seg for seg, _, _ in s.open} for s in live}
        values = _open_values(x, cuts, stretches)
        if max(rows for s in live for _, _, rows in s.open) <= picked:
            ranks = {(s.index, seg): [r - before for r in s.ranks(before, rows)] for s in live for seg, before, rows in s.open}
            before = {(s.index, seg): b for s in live for seg, b, _ in s.open}
            for r in _picked(values, ranks):
                found[r["col"]].known[before[r["col"], r["seg"]] + r["rank"]] = r["x"]
            break
        grid = np.arange(1001) / 1000
        for r in values.mapInArrow(_merging(["col", "seg"], 2048, grid.tolist()), "col bigint, seg bigint, rows bigint, v array<double>").collect():
            s = found[r["col"]]
            b, rows = next((b, n) for seg, b, n in s.open if seg == r["seg"])
            for rank in s.ranks(b, rows):
                at = int((rank - b) / rows * 1000)
                s.cuts |= {r["v"][max(0, at - 2)], r["v"][min(1000, at + 3)]}
    return [s.result() for s in found]
