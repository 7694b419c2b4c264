import numpy as np
import pytest

from splitframe.operators import matrix as m


def cells(spark, a):
    rows = [(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


RNG = np.random.default_rng(0)
A, B = RNG.normal(size=(7, 12)), RNG.normal(size=(12, 5))


@pytest.mark.parametrize("options", [{}, {"small_cells": 0, "block": 4}, {"small_cells": 0, "block": 64}])
def test_product(spark, options):
    assert np.allclose(dense(m.mat_mul(cells(spark, A), cells(spark, B), **options), (7, 5)), A @ B)


def test_product_with_a_hot_inner_index(spark):
    a, b = np.zeros((30, 6)), np.zeros((6, 30))
    a[:, 2], b[2, :], a[3, 5], b[5, 1] = 1.5, 2.0, 4.0, 5.0
    got = m.mat_mul(cells(spark, a).where("v != 0"), cells(spark, b).where("v != 0"), block=8, small_cells=0)
    assert np.allclose(dense(got, (30, 30)), a @ b)


def test_gram(spark):
    df = spark.createDataFrame([tuple(map(float, r)) for r in A.T], ", ".join(f"c{i} double" for i in range(7)))
    names = [f"c{i}" for i in range(7)]
    assert np.allclose(dense(m.gram(df.repartition(3), names, names[:2]), (7, 2)), A @ A[:2].T)


def test_elementwise(spark):
    a, b = cells(spark, A), cells(spark, A * 2 - 1)
    assert np.allclose(dense(m.mat_add(a, b), A.shape), A * 3 - 1)
    assert np.allclose(dense(m.mat_sub(a, b), A.shape), 1 - A)
    assert np.allclose(dense(m.mat_add(a, 2), A.shape), A + 2)
    assert np.allclose(dense(m.mat_sub(a, 2), A.shape), A - 2)
    assert np.allclose(dense(m.mat_hadamard(a, b), A.shape), A * (A * 2 - 1))
    assert np.allclose(dense(m.mat_scale(a, -3), A.shape), A * -3)
    assert np.allclose(dense(m.mat_transpose(a), A.T.shape), A.T)
    assert np.allclose(dense(m.mat_fmod(m.mat_scale(a, 10), 3), A.shape), np.fmod(A * 10, 3))


@pytest.mark.parametrize("op, fn", [("<", np.less), (">", np.greater), ("<=", np.less_equal), (">=", np.greater_equal)])
def test_compare(spark, op, fn):
    b = np.round(A)
    a = np.where(np.abs(A) < 0.3, b, A)
    assert np.array_equal(dense(m.mat_compare(cells(spark, a), op, cells(spark, b)), A.shape), fn(a, b))
    assert np.array_equal(dense(m.mat_compare(cells(spark, b), op, 1.0), A.shape), fn(b, 1.0))


def test_slices_and_assignment(spark):
    a = cells(spark, A)
    got = m.mat_slice(a, slice(1, None, 2), [0, 3])
    assert {(r["i"], r["j"]) for r in got.collect()} == {(i, j) for i in (1, 3, 5) for j in (0, 3)}
    want = A.copy()
    want[2:4, :] = 9
    assert np.allclose(dense(m.mat_assign(a, 9.0, slice(2, 4)), A.shape), want)
    want[:, [1]] = -A[:, [1]]
    assert np.allclose(dense(m.mat_assign(m.mat_assign(a, 9.0, slice(2, 4)), cells(spark, -A), columns=[1]), A.shape), want)


def test_same_shape(spark):
    a = cells(spark, A)
    assert np.array_equal(dense(m.mat_like(a, 1), A.shape), np.ones(A.shape))
    noise = dense(m.mat_random_like(a, -2, 3, "s"), A.shape)
    assert noise.min() >= -2 and noise.max() <= 2 and len(np.unique(noise)) == 5
    assert np.array_equal(noise, dense(m.mat_random_like(a.repartition(3), -2, 3, "s"), A.shape))


@pytest.mark.parametrize("options", [{}, {"small_cells": 0, "block": 2}])
def test_products_have_the_same_cells_either_way(spark, options):
    """Zero sums stay, absent cells give nothing, and an infinite cell meets only what is there."""
    inf = float("inf")
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0), (1, 2, inf), (3, 3, 0.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 1, 2.0), (3, 0, 5.0)], "i long, j long, v double")
    got = {(r["i"], r["j"]): r["v"] for r in m.mat_mul(a, b, **options).collect()}
    assert got == {(0, 0): 0.0, (1, 1): inf, (3, 0): 0.0}


def test_assign_adds_and_removes_cells(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (5, 5, 9.0)], "i long, j long, v double")
    value = spark.createDataFrame([(0, 1, 7.0), (1, 1, 8.0), (4, 4, 3.0)], "i long, j long, v double")
    got = {(r["i"], r["j"]): r["v"] for r in m.mat_assign(a, value, slice(0, 2), slice(0, 2)).collect()}
    assert got == {(0, 1): 7.0, (1, 1): 8.0, (5, 5): 9.0}


@pytest.mark.parametrize("held, block", [(1, 4), (2, 3), (5, 8), (10_000, 4)])
def test_grids_of_blocks_give_the_same(spark, held, block):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(21, 30)), rng.normal(size=(30, 17))
    x[rng.random(x.shape) < 0.6], y[rng.random(y.shape) < 0.6] = 0, 0
    x[:, 7], y[7, :], x[4, 2], x[5, 7] = 1.5, 2.0, np.inf, -0.0
    a, b = cells(spark, x).where("v != 0 or (i = 5 and j = 7)"), cells(spark, y).where("v != 0")
    got = m._block_mul(a, b, block, held).collect()
    want = {(r["i"], r["j"]): r["v"] for r in m.mat_mul(a, b).collect()}
    assert len(got) == len(want)
    for r in got:
        assert np.isclose(r["v"], want[r["i"], r["j"]], equal_nan=True)


def test_grid_of_a_product(spark):
    shape = lambda blocks, i, j: {"blocks": blocks, "n_i": i, "n_j": j}
    # A tall table by a wide one: the right side is kept whole, its inner axis is not cut.
    grid = m._Grid.of(shape(1_250_000, 312_500, 4), shape(628, 4, 157), 200, 4096)
    assert (grid.columns, grid.inner) == (1, 1) and grid.rows >= 800
    # Its transpose by itself: only the inner axis can be cut.
    grid = m._Grid.of(shape(1_250_000, 4, 312_500), shape(1_250_000, 312_500, 4), 200, 4096)
    assert grid.columns * grid.inner >= 300 and grid.rows <= 4


def test_numbers_on_a_shape(spark):
    x = np.where(np.abs(A) < 0.7, 0.0, A)
    a = cells(spark, x).where("v != 0")
    assert np.allclose(dense(m.mat_add(a, 2, x.shape), x.shape), x + 2) and m.mat_add(a, 2, x.shape).count() == x.size
    assert np.allclose(dense(m.mat_sub(a, 2, x.shape), x.shape), x - 2)
    assert np.array_equal(dense(m.mat_compare(a, "<=", 0.0, x.shape), x.shape), x <= 0)
    want = x.copy()
    want[2:5, [1, 3]] = 9
    assert np.allclose(dense(m.mat_assign(a, 9, slice(2, 5), [1, 3], x.shape), x.shape), want)
    assert m.mat_filled(a.where("false"), (0, 3)).count() == 0


def test_a_product_of_one_block_row_is_dealt_out_too():
    shape = lambda blocks, n_i, n_j: {"blocks": blocks, "n_i": n_i, "n_j": n_j}
    for blocks in (1_875, 18_750, 1_000_000):
        grid = m._Grid.of(shape(blocks, 1, blocks), shape(blocks, blocks, 1), 200, 1024)
        assert (grid.rows, grid.columns) == (1, 1) and grid.inner >= 200
        assert blocks / grid.inner <= 1024
    # A small left side whose block rows are few, but a right side that fits: left blocks stay bounded.
    grid = m._Grid.of(shape(4_000_000, 4, 1_000_000), shape(1_000_000, 1_000_000, 1), 8, 1_000_000)
    assert 4_000_000 / (grid.rows * grid.inner) <= 2 * 1_000_000


def test_groups_of_one_block_row_add_up(spark):
    a = RNG.normal(size=(400, 3))
    e = cells(spark, a)
    got = m.mat_mul(m.mat_transpose(e), e, block=4, small_cells=0)
    assert np.allclose(dense(got, (3, 3)), a.T @ a)
