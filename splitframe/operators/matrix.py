"""Matrix operators on coordinate tables ``(i, j, v)`` with unique ``(i, j)``; absent cells are 0."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.keys import keyed_int

# A full block takes 8 KB, so an Arrow batch of 10,000 blocks stays under 150 MB.
BLOCK = 32
# Cells of right blocks that a group of the product keeps (32 MB), groups for each shuffle task, and how many
# times the kept blocks a group streams at most.
HELD_CELLS = 4_194_304
GROUPS_A_TASK = 4
STREAMED = 2
SMALL_CELLS = 1_000_000
# Fixed value: a quiet NaN that arithmetic does not make.
ABSENT = np.array(0x7FF8_0000_0000_5A5A, np.int64).view(np.float64)

_COMPARE = {
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}


def from_rows(df: DataFrame, row: str, vector: str) -> DataFrame:
    """Array column to cells, ``j`` counting from 0."""
    cells = df.select(F.col(row).cast("bigint").alias("i"), F.posexplode(vector).alias("j", "v"))
    return cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def from_columns(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """Wide table to cells, ``j`` in the order of ``columns``."""
    return from_rows(df.select(row, F.array(*[F.col(c).cast("double") for c in columns]).alias("_vec")), row, "_vec")


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per cell with both values. A union and a combined sum, instead of a full join."""
    zero = F.lit(0.0)
    left = a.select("i", "j", F.col("v").alias("a"), zero.alias("b"))
    right = b.select("i", "j", zero.alias("a"), F.col("v").alias("b"))
    return left.unionByName(right).groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def mat_filled(a: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """All cells of a matrix of so many rows and columns: absent ones as the zeros they are.

    Cells outside the shape are an error of the caller and stay. The cells are made in tasks, and
    united with the given ones by one combined sum.
    """
    rows, columns = shape
    every = a.sparkSession.range(rows * columns) if rows * columns else a.sparkSession.range(0)
    zeros = every.select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"), F.lit(0.0).alias("v"))
    return a.select("i", "j", "v").unionByName(zeros).groupBy("i", "j").agg(F.sum("v").alias("v"))


def _whole(a: DataFrame, shape: tuple[int, int] | None) -> DataFrame:
    return a if shape is None else mat_filled(a, shape)


def mat_add(a: DataFrame, b: DataFrame | float, shape: tuple[int, int] | None = None) -> DataFrame:
    """Sum with a matrix, or with a number: on every cell of the ``shape``, or without one on present cells."""
    if not isinstance(b, DataFrame):
        return _whole(a, shape).select("i", "j", (F.col("v") + F.lit(float(b))).alias("v"))
    return a.select("i", "j", "v").unionByName(b.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def mat_sub(a: DataFrame, b: DataFrame | float, shape: tuple[int, int] | None = None) -> DataFrame:
    return mat_add(a, mat_scale(b, -1.0) if isinstance(b, DataFrame) else -float(b), shape)


def mat_scale(a: DataFrame, factor: float) -> DataFrame:
    return a.select("i", "j", (F.col("v") * F.lit(float(factor))).alias("v"))


def mat_hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elementwise product; cells are unique, so the join has no hot key."""
    joined = a.alias("a").join(b.alias("b"), ["i", "j"])
    return joined.select("i", "j", (F.col("a.v") * F.col("b.v")).alias("v"))


def mat_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mat_fmod(a: DataFrame, m: float) -> DataFrame:
    """Remainder with the sign of the dividend."""
    return a.select("i", "j", (F.col("v") % F.lit(float(m))).alias("v"))


def mat_compare(a: DataFrame, op: str, b: DataFrame | float, shape: tuple[int, int] | None = None) -> DataFrame:
    """Elementwise ``<``, ``>``, ``<=``, ``>=`` against a matrix or a number, as 0/1.

    A number is compared with every cell of the ``shape``, or without one with present cells.
    """
    test = _COMPARE[op]
    if not isinstance(b, DataFrame):
        return _whole(a, shape).select("i", "j", test(F.col("v"), F.lit(float(b))).cast("int").alias("v"))
    return _merge(a, b).select("i", "j", test(F.col("a"), F.col("b")).cast("int").alias("v"))


def _within(axis: str, wanted: slice | list[int] | None) -> Column:
    if wanted is None:
        return F.lit(True)
    if isinstance(wanted, slice):
        ok = F.lit(True)
        if wanted.start is not None:
            ok = ok & (F.col(axis) >= wanted.start)
        if wanted.stop is not None:
            ok = ok & (F.col(axis) < wanted.stop)
        if wanted.step not in (None, 1):
            ok = ok & ((F.col(axis) - (wanted.start or 0)) % wanted.step == 0)
        return ok
    return F.col(axis).isin([int(x) for x in wanted])


def mat_slice(a: DataFrame, rows: slice | list[int] | None = None, columns: slice | list[int] | None = None) -> DataFrame:
    """Cells of the chosen rows and columns, under their old coordinates."""
    return a.where(_within("i", rows) & _within("j", columns))


def mat_assign(
    a: DataFrame,
    value: DataFrame | float,
    rows: slice | list[int] | None = None,
    columns: slice | list[int] | None = None,
    shape: tuple[int, int] | None = None,
) -> DataFrame:
    """Overwrite the chosen rows and columns by a number or by another matrix's cells.

    A matrix replaces all that was there: cells it lacks become absent, new ones are added. A
    number is put in all chosen cells of the ``shape``, or without one in present cells.
    """
    inside = _within("i", rows) & _within("j", columns)
    if not isinstance(value, DataFrame):
        if shape is not None:
            filled = mat_filled(a.where(F.lit(False)), shape).where(inside).select("i", "j", F.lit(float(value)).alias("v"))
            return a.where(~inside).select("i", "j", "v").unionByName(filled)
        return a.select("i", "j", F.when(inside, F.lit(float(value))).otherwise(F.col("v")).alias("v"))
    return a.where(~inside).select("i", "j", "v").unionByName(value.where(inside).select("i", "j", "v"))


def mat_like(a: DataFrame, fill: float = 0.0) -> DataFrame:
    """Same cells, all with one value (0 or 1 in the usual cases)."""
    return a.select("i", "j", F.lit(float(fill)).alias("v"))


def mat_random_like(a: DataFrame, low: int, high: int, seed: str | int) -> DataFrame:
    """Same cells with repeatable random integers in ``[low, high)``."""
    return a.select("i", "j", keyed_int(low, high, seed, "i", "j").alias("v"))


def mat_mul(a: DataFrame, b: DataFrame, block: int = BLOCK, small_cells: int = SMALL_CELLS) -> DataFrame:
    """Matrix product.

    A right side of at most ``small_cells`` cells (counted first) is broadcast: then the left
    side is not shuffled at all and only combined sums move. Two large matrices are cut into
    square blocks and dealt out in a grid of bounded groups, see ``_block_mul``. Either
    way there is a cell, be it zero, exactly where two cells met.
    """
    if b.count() <= small_cells:
        right = F.broadcast(b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w")))
        products = a.join(right, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        return products.select("i", F.col("k").alias("j"), "v")
    return _block_mul(a, b, block)


@dataclass(frozen=True)
class _Grid:
    """How a product of blocks is dealt out: slices of left rows, right columns and the inner axis."""

    rows: int
    columns: int
    inner: int

    @staticmethod
    def of(left: Row, right: Row, tasks: int, held: int) -> _Grid:
        """The cheapest grid whose groups hold about ``held`` right blocks, with enough groups for the tasks.

        A group keeps its right blocks and streams its left ones, so left blocks are sent once a
        column slice, right blocks once a row slice, and several inner slices add sums of output
        blocks. Counts are approximate; they decide the layout only.
        """
        slices = max(1, math.ceil(right["blocks"] / held))
        best = None
        for columns in sorted({min(2**e, right["n_j"]) for e in range(slices.bit_length() + 1)}):
            inner = max(1, min(right["n_i"], math.ceil(slices / columns)))
            parts = math.ceil(left["blocks"] / (STREAMED * held))
            rows = max(1, min(left["n_i"], max(math.ceil(GROUPS_A_TASK * tasks / (columns * inner)), math.ceil(parts / inner))))
            spare = (left["blocks"] + right["blocks"]) // max(1, left["n_i"] * right["n_j"])
            inner = max(inner, min(right["n_i"], max(math.ceil(parts / rows), min(math.ceil(tasks / (columns * rows)), spare))))
            sums = inner * left["n_i"] * right["n_j"] if inner > 1 else 0
            cost = columns * left["blocks"] + rows * right["blocks"] + sums
            if best is None or cost < best[0]:
                best = cost, _Grid(rows, columns, inner)
        return best[1]


def _blocks(a: DataFrame, block: int) -> DataFrame:
    """Cells gathered into square blocks (bi, bj); a group has at most ``block * block`` cells."""
    at = lambda c: F.floor(F.col(c) / F.lit(block)).alias(f"b{c}")
    place = (F.pmod("i", F.lit(block)) * block + F.pmod("j", F.lit(block))).cast("int")
    return a.groupBy(at("i"), at("j")).agg(F.collect_list(F.struct(place.alias("at"), "v")).alias("cells"))


def _shape(a: DataFrame, block: int) -> Row:
    """Approximate numbers of blocks, block rows and block columns."""
    at = lambda c: F.floor(F.col(c) / F.lit(block))
    count = F.approx_count_distinct
    found = a.select(at("i").alias("i"), at("j").alias("j"))
    return found.agg(count(F.struct("i", "j")).alias("blocks"), count("i").alias("n_i"), count("j").alias("n_j")).first()


def _dense(batch: pa.RecordBatch, block: int) -> np.ndarray:
    """Blocks of a batch as arrays in which absent cells are marked."""
    cells = batch.column("cells")
    sizes = np.diff(cells.offsets.to_numpy())
    flat = cells.flatten()
    out = np.full((batch.num_rows, block * block), ABSENT)
    out[np.repeat(np.arange(batch.num_rows), sizes), flat.field("at").to_numpy()] = flat.field("v").to_numpy(zero_copy_only=False)
    return out.reshape(-1, block, block)


def _product(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product over the cells that are there, and where such a product is."""
    here, there = x.view(np.int64) != ABSENT.view(np.int64), y.view(np.int64) != ABSENT.view(np.int64)
    some = np.ones((len(x), y.shape[1]), bool) if here.all() and there.all() else here.astype(np.float32) @ there.astype(np.float32) > 0
    x, y = np.where(here, x, 0.0), np.where(there, y, 0.0)
    if np.isfinite(x).all() and np.isfinite(y).all():
        return x @ y, some
    # An infinite cell times an absent one is nothing, not NaN.
    parts = (np.where(here[:, k, None] & there[k], x[:, k, None] * y[k], 0.0) for k in range(x.shape[1]))
    return sum(parts), some


def _cells(i: int, j: np.ndarray, total: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
    """Cells of a strip of output: rows from ``i``, columns ``j``."""
    r, c = np.nonzero(some)
    return pa.RecordBatch.from_arrays([pa.array(r + i), pa.array(j[c]), pa.array(total[r, c])], ["i", "j", "v"])


def _block_mul(a: DataFrame, b: DataFrame, block: int, held: int | None = None) -> DataFrame:
    """Product of two large matrices in a grid of (row slice, column slice, inner slice).

    Every group gets its right blocks first and keeps them, then its left blocks by block row: a
    strip of output is summed in the group, whatever the number of left blocks that share a right
    one, and unfolded to cells when it is whole. Only with several inner slices are sums of
    output blocks shuffled, before they are unfolded. Groups go to tasks by number, so none gets many by chance.
    """
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = _Grid.of(_shape(a, block), _shape(b, block), tasks, held or max(1, HELD_CELLS // block**2))
    groups = grid.rows * grid.columns * grid.inner
    tasks = min(groups, max(tasks, math.ceil(groups / GROUPS_A_TASK)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _blocks(a, block).select(F.lit(1).alias("side"), F.col("bi").alias("at"), F.col("bj").alias("bk"), "cells", dealt("bi", grid.rows).alias("p"), every(grid.columns).alias("q"))
    right = _blocks(b, block).select(F.lit(0).alias("side"), F.col("bj").alias("at"), F.col("bi").alias("bk"), "cells", every(grid.rows).alias("p"), dealt("bj", grid.columns).alias("q"))
    both = left.unionByName(right).withColumn("s", dealt("bk", grid.inner))
    group = (F.col("p") * grid.columns + F.col("q")).cast("bigint") * grid.inner + F.col("s")
    both = both.select(group.alias("grp"), "side", "at", "bk", "cells").repartitionById(tasks, F.pmod("grp", F.lit(tasks)).cast("int")).sortWithinPartitions("grp", "side", "at", "bk")
    whole = grid.inner == 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, strip = None, {}, None

        def finished() -> Iterator[pa.RecordBatch]:
            if strip is None or not strip[2].any():
                return
            at, total, some = strip
            if whole:
                yield _cells(at * block, columns, total, some)
                return
            marked = np.where(some, total, ABSENT)
            names = [int(c) for c in columns[::block] // block]
            data = [marked[:, n * block : (n + 1) * block].tobytes() for n in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(names)), pa.array(names, pa.int64()), pa.array(data, pa.binary())], ["bi", "bj", "data"])

        for batch in batches:
            arrays = _dense(batch, block)
            for n, (g, side, at, bk) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "side", "at", "bk")))):
                if g != group:
                    yield from finished()
                    group, kept, strip, ready = g, {}, None, False
                if side == 0:
                    kept.setdefault(bk, []).append((at, arrays[n].copy()))
                    continue
                if not ready:
                    # Right blocks of one inner number side by side, and their places in the strip.
                    names = sorted({j for held in kept.values() for j, _ in held})
                    places = {j: i for i, j in enumerate(names)}
                    columns = (np.array(names, np.int64)[:, None] * block + np.arange(block)).ravel()
                    kept = {k: (np.hstack([y for _, y in v]), np.concatenate([np.arange(block) + places[j] * block for j, _ in v])) for k, v in kept.items()}
                    ready = True
                if strip is not None and strip[0] != at:
                    yield from finished()
                    strip = None
                if bk in kept:
                    if strip is None:
                        strip = at, np.zeros((block, len(columns))), np.zeros((block, len(columns)), bool)
                    y, to = kept[bk]
                    product, some = _product(arrays[n], y)
                    strip[1][:, to] += product
                    strip[2][:, to] |= some
        yield from finished()

    if whole:
        return both.mapInArrow(multiply, "i bigint, j bigint, v double")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total, some = None, None, None
        for batch in batches:
            for bi, bj, data in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "data"))):
                x = np.frombuffer(data).reshape(block, block)
                here = x.view(np.int64) != ABSENT.view(np.int64)
                if (bi, bj) != name:
                    if name:
                        yield _cells(name[0] * block, name[1] * block + np.arange(block), total, some)
                    name, total, some = (bi, bj), np.zeros((block, block)), np.zeros((block, block), bool)
                total += np.where(here, x, 0.0)
                some |= here
        if name:
            yield _cells(name[0] * block, name[1] * block + np.arange(block), total, some)

    sums = both.mapInArrow(multiply, "bi bigint, bj bigint, data binary").repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    return sums.mapInArrow(add, "i bigint, j bigint, v double")


def gram(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """``left' right`` of two column groups of one tall table, as cells.

    Every task adds up its own rows with NumPy and gives one small matrix; only those
    (len(left) x len(right)) matrices are shuffled.
    """
    n_left, n_right = len(left), len(right)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_left, n_right))
        for rows in batches:
            cells = rows.to_numpy(dtype=float)
            total += cells[:, :n_left].T @ cells[:, n_left:]
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    # Columns may be named on both sides, so they are renamed by place.
    picked = [F.col(c).cast("double").alias(f"l{n}") for n, c in enumerate(left)]
    picked += [F.col(c).cast("double").alias(f"r{n}") for n, c in enumerate(right)]
    parts = df.select(*picked).mapInPandas(partial, "i bigint, j bigint, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
