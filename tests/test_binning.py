import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe.operators import binning as b
from splitframe.operators import wide_quantiles


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*[[None if v is None else float(v) for v in columns[n]] for n in names])), ", ".join(f"{n} double" for n in names))


def columns(n=3000):
    rng = np.random.default_rng(1)
    return {
        "normal": rng.normal(size=n),
        "few": rng.integers(0, 4, n),
        "hot": np.where(np.arange(n) % 3 == 0, 0.5, rng.uniform(size=n)),
        "constant": np.full(n, 7.0),
        "signed_zero": np.where(np.arange(n) % 2 == 0, -0.0, 0.0),
        "wide": rng.lognormal(0, 8, n),
    }


@pytest.mark.parametrize("k", [1, 7, 50])
def test_exact_edges_equal_numpy(spark, k):
    data = columns()
    edges = b.quantile_edges(frame(spark, **data), list(data), k)
    for c, x in data.items():
        want = np.quantile(x, b.cut_probabilities(k)).round(3)
        assert np.allclose(edges.cuts[c], want, rtol=1e-12, atol=1.1e-3 if c == "wide" else 1e-9)


def test_rounds_of_narrowing_are_exact(spark):
    data = columns(20000)
    probs = b.cut_probabilities(9)
    # A poor sketch and hardly any values to fetch: several rounds are needed.
    got = b.exact_quantiles(frame(spark, **data), list(data), probs, fetch_rows=40, sketch_k=16)
    for c, x in data.items():
        assert np.allclose(got[c], np.quantile(x, probs), rtol=1e-9, atol=0)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [1.0, 1.0, 1.0, 9.0], [None, 3.0, None, 1.0], [math.nan, 2.0, 4.0]])
def test_tiny_columns(spark, values):
    probs = b.cut_probabilities(4)
    got = b.exact_quantiles(frame(spark, x=values), ["x"], probs)["x"]
    present = [v for v in values if v is not None and not math.isnan(v)]
    assert np.allclose(got, np.quantile(present, probs))


def test_column_without_values(spark):
    with pytest.raises(ValueError):
        b.quantile_edges(frame(spark, x=[None, None]), ["x"], 3)


def test_more_columns_than_one_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(b, "COLUMNS_AT_ONCE", 2)
    data = columns(500)
    edges = b.quantile_edges(frame(spark, **data), list(data), 3)
    assert edges.features == list(data)


def labels(spark, values, cuts):
    df = b.bin_label(frame(spark, x=values), b.Edges({"x": tuple(cuts)}))
    return [r["x_bin"] for r in df.collect()]


def test_bins_are_closed_on_the_right(spark):
    assert labels(spark, [0.9, 1.0, 1.1, 2.0, 2.5], [1.0, 2.0]) == [0, 0, 1, 1, 2]


def test_repeated_edges_leave_bins_empty(spark):
    assert labels(spark, [0.0, 1.0, 1.5, 3.0], [1.0, 1.0, 1.0, 2.0]) == [0, 0, 3, 4]


def test_missing_values_and_zeros(spark):
    assert labels(spark, [None, math.nan, -0.0, 0.0, math.inf, -math.inf], [0.0]) == [None, None, 0, 0, 1, 0]


def test_label_is_first_edge_not_below(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, 500) / 2
    cuts = sorted(rng.integers(0, 30, 200) / 2)
    want = [next((i for i, e in enumerate(cuts) if v <= e), len(cuts)) for v in x]
    assert labels(spark, x, cuts) == want


def test_constant_column_goes_into_the_first_bin(spark):
    df = frame(spark, x=[3.0] * 10)
    edges = b.quantile_edges(df, ["x"], 5)
    assert edges.cuts["x"] == (3.0,) * 5
    assert [(r["bin"], r["n"]) for r in b.bin_members(b.bin_label(df, edges), ["x"]).collect()] == [(0, 10)]
    assert [r["edge"] for r in b.bin_compact_edges(df, edges).collect()] == [3.0]


def test_edges_come_from_the_whole_table_not_the_overlap(spark):
    company = spark.range(100).select(F.col("id"), F.col("id").cast("double").alias("c"))
    partner = spark.range(90, 200).select(F.col("id"), F.col("id").cast("double").alias("p"))
    joined, edges = b.bin_before_join(company, partner, ["c"], ["p"], 1)
    assert edges.cuts == {"c": (49.5,), "p": (144.5,)}
    assert {(r["c_bin"], r["p_bin"]) for r in joined.collect()} == {(1, 0)}


def test_infinite_edges_and_values(spark):
    inf = math.inf
    values = [-inf, -1.0, 0.0, 2.0, inf, None, math.nan]
    df = frame(spark, x=values).withColumn("n", F.monotonically_increasing_id())
    for cuts in ([-inf, 0.0, 0.0, inf], [-inf, inf], [0.0, 2.0], [-inf, -inf, 1.0], [inf]):
        for equal in (False, True):
            got = [r["c"] for r in b.count_below(df, [("c", "x", cuts, equal)]).orderBy("n").collect()]
            want = [None if v is None or math.isnan(v) else sum(c <= v if equal else c < v for c in cuts) for v in values]
            assert got == want, (cuts, equal)


def test_edges_under_the_names_of_the_joined_table(spark):
    left = frame(spark, id=range(8), x0=range(8), u=range(8))
    right = frame(spark, id=range(8), x0=[v * 10 for v in range(8)])
    joined, edges = b.bin_before_join(left, right, ["x0", "u"], ["x0"], 3)
    assert set(edges.features) == {"company_x0", "u", "partner_x0"} and edges.cuts["partner_x0"] == tuple(10 * e for e in edges.cuts["company_x0"])
    assert b.bin_edge_join(joined, "id", edges).count() == 24
    with pytest.raises(ValueError):
        b.Edges({"a": (1.0,)}).merge(b.Edges({"a": (2.0,)}))


@pytest.mark.parametrize("picked", [4_000_000, 3])
def test_wide_tables_are_searched_as_one_matrix(spark, monkeypatch, picked):
    monkeypatch.setattr(wide_quantiles, "SUMMARY_VALUES", 1000)
    monkeypatch.setattr(wide_quantiles, "CHUNK_VALUES", 900)
    monkeypatch.setattr(wide_quantiles.wide_quantiles, "__defaults__", (picked,))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 7))
    x[:, 1], x[:, 2] = np.round(x[:, 1]), 4.0
    x[rng.random(900) < 0.3, 3] = np.nan
    x[:, 4] = np.nan
    x[5, 4], x[:40, 5], x[0, 6] = 2.5, -0.0, np.inf
    rows = [([None if np.isnan(v) and i % 2 else float(v) for v in r],) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "x array<double>").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.73, 1.0]
    got = wide_quantiles.wide_quantiles(df, F.col("x"), 7, probs, b._Search)
    for c in range(7):
        want = np.quantile(x[~np.isnan(x[:, c]), c], probs)
        assert np.allclose(got[c][:5], want[:5], atol=1e-12) and got[c][5] == want[5] or c == 6
    assert np.allclose(got[6][:5], np.quantile(x[:, 6], probs[:5]))
    assert wide_quantiles.wide_quantiles(df.where("false"), F.col("x"), 2, probs, b._Search) == [None, None]


def test_edges_of_an_array_column(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 70)), 2)
    names = [f"x{i}" for i in range(70)]
    wide = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    arrays = wide.select(F.array(*names).alias("v"))
    assert b.quantile_edges(wide, names, 9) == b.array_edges(arrays, "v", 9)
    assert b.quantile_edges(wide, names[:5], 9).cuts["x3"] == b.array_edges(arrays, "v", 9).cuts["x3"]
