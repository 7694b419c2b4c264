"""Binned rows in one binary value each, and what trees need of them in NumPy.

Training reads every bin of every row once a level. As one value a row they come out of the scan and
through Arrow as a single buffer, which NumPy sees as a matrix without a copy per feature.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batches import matrix_of

# Histograms of up to so many cells are kept dense in a task (three times eight bytes a cell).
DENSE_CELLS = 4_000_000
# Values (rows x features) that are counted at once.
COUNTED = 2_000_000


@dataclass(frozen=True)
class Packing:
    """How bins are packed: big-endian numbers of ``size`` bytes, all bits set where missing."""

    features: int
    bins: int

    @property
    def size(self) -> int:
        """Bytes a bin: labels 0 to ``bins - 1`` and the mark of a missing value."""
        return 1 if self.bins < 256 else 2 if self.bins < 65_536 else 4

    @property
    def kind(self) -> str:
        return f">u{self.size}"

    def matrix(self, column: pa.Array) -> np.ndarray:
        """Rows x features of a batch."""
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        return data.view(self.kind).reshape(len(column), self.features)

    def at_most(self, name: str, feature: int, cut: int) -> str:
        """SQL that is true where the bin of a feature is at most the cut, for generated code."""
        return f"substring(`{name}`, {feature * self.size + 1}, {self.size}) <= X'{cut:0{2 * self.size}X}'"

    def packed(self, values: np.ndarray) -> pa.Array:
        """Binary values of rows x features; NaN is missing."""
        missing = np.isnan(values)
        whole = np.where(missing, 256**self.size - 1, np.nan_to_num(values)).astype(self.kind)
        width = self.features * self.size
        ends = np.arange(len(values) + 1, dtype=np.int64) * width
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(whole.tobytes())]).cast(pa.binary())


def pack_bins(df: DataFrame, bins: list[Column], keep: dict[str, Column], packing: Packing, out: str = "_bins") -> DataFrame:
    """``keep`` and the bins of a row as one binary value.

    ``bins``: a column for each feature, or one array column. Missing bins are null.
    """
    names, held = [f"b{i}" for i in range(len(bins))], list(keep)
    plain = df.select(*[c.alias(k) for k, c in keep.items()], *[c.alias(n) for c, n in zip(bins, names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[: len(keep)])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [batch.column(k) for k in held]
                yield pa.RecordBatch.from_arrays([*kept, packing.packed(matrix_of(batch, names))], [*held, out])

    return plain.mapInArrow(pack, f"{schema}, {out} binary")


def pack_values(df: DataFrame, values: str, cuts: list[tuple[float, ...]], keep: dict[str, Column], packing: Packing, out: str = "_bins") -> DataFrame:
    """As ``pack_bins`` from one array column of raw values: a bin is the number of cuts strictly below."""
    held = list(keep)
    plain = df.select(*[c.alias(k) for k, c in keep.items()], F.col(values).alias("values"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[: len(keep)])
    bounds = [np.sort(np.array(c)) for c in cuts]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asfortranarray(matrix_of(batch, ["values"]))
            if x.shape[1] != len(bounds):
                raise ValueError(f"rows of {values} have {x.shape[1]} values, not {len(bounds)}")
            for c, b in enumerate(bounds):
                x[:, c] = np.where(np.isnan(x[:, c]), np.nan, np.searchsorted(b, x[:, c], "left"))
            kept = [batch.column(k) for k in held]
            yield pa.RecordBatch.from_arrays([*kept, packing.packed(np.ascontiguousarray(x))], [*held, out])

    return plain.mapInArrow(pack, f"{schema}, {out} binary")


@dataclass(frozen=True)
class NodeArrays:
    """The nodes that a tree has, in order of their heap number, with pointers to children.

    ``feature`` is -1 at ends. Its size is that of the tree, however deep a branch goes.
    """

    node: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(nodes: Iterable, slots: dict[str, int], by: str = "bin") -> NodeArrays:
        """``nodes``: TreeNodes of one tree, open ones being leaves."""
        nodes = sorted(nodes, key=lambda n: n.node)
        at = {n.node: i for i, n in enumerate(nodes)}
        inner = [None if n.is_leaf else n for n in nodes]
        return NodeArrays(
            np.array([n.node for n in nodes], np.int64),
            np.array([slots[n.feature] if n else -1 for n in inner], np.int64),
            np.array([(n.edge if by == "value" else n.bin) if n else 0 for n in inner], float),
            np.array([at[2 * n.node] if n else 0 for n in inner], np.int64),
            np.array([at[2 * n.node + 1] if n else 0 for n in inner], np.int64),
            np.array([n.weight or 0.0 for n in nodes], float),
        )

    def index(self, heap: np.ndarray) -> np.ndarray:
        """Places of heap numbers."""
        return np.searchsorted(self.node, heap)

    def walk(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Place of the end that each row of ``x`` (rows x features) reaches from place ``at`` or the root.

        Rows leave the loop when they reach an end, so a long chain costs what its rows walk. A missing
        value (NaN, or the largest packed number) compares false and goes right.
        """
        at = np.zeros(len(x), np.int64) if at is None else at.copy()
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            here = at[going]
            down = x[going, self.feature[here]] <= self.cut[here]
            at[going] = here = np.where(down, self.left[here], self.right[here])
            going = going[self.feature[here] >= 0]
        return at


class _Cells:
    """Sums of g, h and rows by cell number: dense while the cells are few, else by distinct cells.

    Rows count once, or as often as they are given to stand for.
    """

    def __init__(self, cells: int):
        self.cells = cells
        self.dense = np.zeros((3, cells)) if cells <= DENSE_CELLS else None
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
        """Add rows x features of keys, with rows x (g, h and, if rows stand for several, their number); gives out sums where they are not kept."""
        self.keys.append(keys)
        self.values.append(values)
        self.held += keys.size
        if self.held >= max(COUNTED, self.cells if self.dense is not None else 0):
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.held:
            return
        width = self.keys[0].shape[1]
        keys = np.concatenate(self.keys).ravel()
        given = [np.repeat(np.concatenate([v[:, i] for v in self.values]), width) for i in range(self.values[0].shape[1])]
        weights_of = given if len(given) == 3 else [*given, None]
        self.keys, self.values, self.held = [], [], 0
        if self.dense is not None:
            for row, weights in zip(self.dense, weights_of):
                row += np.bincount(keys, weights, self.cells)
            return
        cells, place = np.unique(keys, return_inverse=True)
        yield cells, *(np.bincount(place, w, len(cells)) for w in weights_of)

    def end(self) -> Iterator[tuple]:
        yield from self.flush()
        if self.dense is not None:
            cells = np.flatnonzero(self.dense[2])
            yield cells, *self.dense[:, cells]


_PARTIAL = pa.schema([("slot", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())])
PARTIAL = "slot bigint, feature int, bin int, g double, h double, n bigint"


def dense_histogram(rows: DataFrame, packing: Packing, trees: list[NodeArrays], slots: list[dict[int, int]]) -> DataFrame:
    """Partial sums (``PARTIAL``) per (slot, feature, bin) of every task, to be added by the caller.

    ``rows``: ``_bins``, ``_at`` (heap number a class) and ``gh`` (g and h a class, then the number
    of rows that a row stands for, if not one). A class has a tree and the slots of the nodes to
    measure; rows in other nodes count nowhere. Rows are summed into arrays in the task, so what
    leaves it is bounded by slots x features x bins.
    """
    every = packing.bins + 1
    cells = (1 + max((s for per in slots for s in per.values()), default=-1)) * packing.features * every
    # Slot by place in the tree, -1 where the node is not measured.
    wanted = [np.array([per.get(int(n), -1) for n in t.node], np.int64) for t, per in zip(trees, slots)]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Cells(cells)
        lanes = np.arange(packing.features) * every
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, gh = packing.matrix(batch.column("_bins")), matrix_of(batch, ["gh"])
            counted = range(2 * len(trees), gh.shape[1])
            stored = matrix_of(batch, ["_at"]).astype(np.int64)
            for c, (tree, slot) in enumerate(zip(trees, wanted)):
                at = tree.walk(bins, tree.index(stored[:, c]))
                mine = np.flatnonzero(slot[at] >= 0)
                for i in range(0, len(mine), step := max(1, COUNTED // packing.features)):
                    part = mine[i : i + step]
                    x = bins[part].astype(np.int64)
                    keys = np.where(x >= every, packing.bins, x) + lanes + slot[at[part], None] * (packing.features * every)
                    for found in held.add(keys, gh[part][:, [2 * c, 2 * c + 1, *counted]]):
                        yield batch_of(*found)
        for found in held.end():
            yield batch_of(*found)

    def batch_of(cell: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        slot, rest = np.divmod(cell, packing.features * every)
        feature, label = np.divmod(rest, every)
        missing = label == packing.bins
        columns = [pa.array(slot), pa.array(feature.astype(np.int32)), pa.array(label.astype(np.int32), mask=missing), pa.array(g), pa.array(h)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], schema=_PARTIAL)

    return rows.select("_bins", "_at", "gh").mapInArrow(sums, PARTIAL)


def routed(frame: DataFrame, packing: Packing, trees: list[NodeArrays]) -> DataFrame:
    """``frame`` with ``_at``, the heap number of the node that a row is in, for every class."""

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = packing.matrix(batch.column("_bins"))
            stored = matrix_of(batch, ["_at"]).astype(np.int64)
            at = [t.node[t.walk(bins, t.index(stored[:, c]))] for c, t in enumerate(trees)]
            flat = np.column_stack(at).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(trees), pa.int32()), pa.array(flat, pa.int64()))
            others = [n for n in batch.schema.names if n != "_at"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), lists], [*others, "_at"])

    names = [f for f in frame.schema.fields if f.name != "_at"]
    ordered = frame.select(*[f.name for f in names], "_at")
    return ordered.mapInArrow(route, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + ", _at array<bigint>")


def forest_scores(columns: list[Column], flat: list[tuple[int, NodeArrays]], width: int, wide: bool) -> Column:
    """Sum of leaf weights a class as an array, in Arrow batches.

    ``columns``: one a feature, or (``wide``) one array column of all of them. A forest of any depth:
    the arrays hold the nodes that exist.
    """

    @F.pandas_udf("array<double>")
    def forest(*values: pd.Series) -> pd.Series:
        if wide:
            x = np.array([np.asarray(v, dtype=float) for v in values[0]]) if len(values[0]) else np.empty((0, 1))
        else:
            x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        total = np.zeros((len(x), width))
        for c, tree in flat:
            total[:, c] += tree.weight[tree.walk(x)]
        return pd.Series(list(total))

    return forest(*columns)

