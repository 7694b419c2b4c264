import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe.operators import binning, splits
from splitframe.plans import boosting, packed
from splitframe.plans.boosting import TreeNode, gbt_fit

NAMES = ["a", "b", "c"]


def data(spark, n=400, seed=0, classes=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.uniform(size=n)])
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=n)).astype(float)
    label = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    rows = [(*map(float, r), float(t), float(v)) for r, t, v in zip(x, label, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, target double"), x, label, y


def binned(df, k=8, names=NAMES):
    edges = binning.quantile_edges(df, names, k)
    return binning.bin_label(df, edges), edges


def brute_force(x, y, cuts, rounds, depth, lam, grad):
    """Plain boosting over raw values; returns the score of every row."""
    score = np.zeros(len(y))
    for _ in range(rounds):
        g, h = grad(y, score)
        step = np.zeros(len(y))

        def grow(rows, level):
            G, H = g[rows].sum(), h[rows].sum()
            best = (0.0, None)
            if level < depth:
                for j, edges in enumerate(cuts):
                    for e in edges:
                        left = rows & (x[:, j] <= e)
                        right = rows & ~left
                        if left.any() and right.any():
                            parts = [g[s].sum() ** 2 / (h[s].sum() + lam) for s in (left, right)]
                            gain = round(0.5 * (sum(parts) - G**2 / (H + lam)) - lam, 6)
                            if gain > best[0]:
                                best = (gain, (left, right))
            if best[1] is None:
                step[rows] = -G / (H + lam)
            else:
                for side in best[1]:
                    grow(side, level + 1)

        grow(np.ones(len(y), bool), 0)
        score = score + step
    return score


def logistic(y, s):
    p = 1 / (1 + np.exp(-s))
    return p - y, p * (1 - p)


def piecewise(y, s):
    p = np.clip(s + 0.5, 0, 1)
    return p - y, p * (1 - p)


def squared(y, s):
    return 2 * (s - y) / len(y), np.full(len(y), 2 / len(y))


@pytest.mark.parametrize(
    "options, grad, target",
    [({}, logistic, "y"), ({"share_y": True}, piecewise, "y"), ({"mission": "regression"}, squared, "target")],
)
def test_forest_equals_brute_force(spark, options, grad, target):
    df, x, label, real = data(spark)
    rows, edges = binned(df)
    lam = 1e-3 if target == "target" else 0.5
    model = gbt_fit(rows, NAMES, edges, target, n_estimators=3, max_depth=3, lambda_=lam, **options)
    want = brute_force(x, real if target == "target" else label, [edges.cuts[n] for n in NAMES], 3, 3, lam, grad)
    got = [r["score"] for r in model.score(df).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=1e-6)
    assert np.allclose(got, want, atol=1e-6)


def test_training_and_scoring_routes_agree_with_repeated_edges(spark):
    df, *_ = data(spark)
    rows, edges = binned(df, k=20)
    assert len(set(edges.cuts["b"])) < 20
    model = gbt_fit(rows, NAMES, edges, n_estimators=2, max_depth=3)
    for t in range(2):
        same = rows.where(model.leaf_of(t, by="bin") == model.leaf_of(t, by="value")).count()
        assert same == rows.count()


def test_running_score_is_stored_when_trees_grow_many(spark, monkeypatch):
    df, *_ = data(spark)
    rows, edges = binned(df)
    plain = gbt_fit(rows, NAMES, edges, n_estimators=4, max_depth=2)
    monkeypatch.setattr(boosting, "INLINE_LEAVES", 5)
    stored = gbt_fit(rows, NAMES, edges, n_estimators=4, max_depth=2)
    for a, b in zip(plain.nodes, stored.nodes, strict=True):
        assert (a.tree, a.node, a.feature, a.bin) == (b.tree, b.node, b.feature, b.bin)
        assert a.weight == pytest.approx(b.weight, abs=1e-9)


@pytest.mark.parametrize("by", ["value", "bin"])
def test_vectorised_scores_equal_inlined_ones(spark, monkeypatch, by):
    df, *_ = data(spark)
    df = df.withColumn("a", F.when(F.col("c") > 0.9, None).otherwise(F.col("a")))
    rows, edges = binned(df)
    model = gbt_fit(rows, NAMES, edges, n_estimators=3, max_depth=3)
    inlined = [r["score"] for r in model.score(rows, by).collect()]
    monkeypatch.setattr(boosting, "INLINE_LEAVES", 0)
    assert np.allclose(inlined, [r["score"] for r in model.score(rows, by).collect()])


def test_missing_values_go_right(spark):
    df = spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)] + [(None, 1.0)] * 3, "a double, y double")
    rows, edges = binned(df, 9, ["a"])
    model = gbt_fit(rows, ["a"], edges, n_estimators=1, max_depth=1, lambda_=0.1)
    leaves = rows.select("a", model.leaf_of(0).alias("value"), model.leaf_of(0, by="bin").alias("bin")).collect()
    assert all(r["value"] == r["bin"] == 3 for r in leaves if r["a"] is None)


@pytest.mark.parametrize("lam", [0.0, 1e-5])
def test_no_split_with_an_empty_side(spark, lam):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (1.0, 1.0)], "a double, y double")
    rows, edges = binned(df, 4, ["a"])
    model = gbt_fit(rows, ["a"], edges, n_estimators=1, max_depth=2, lambda_=lam)
    assert [(n.node, n.is_leaf) for n in model.nodes] == [(1, True)]
    assert model.nodes[0].weight == pytest.approx(0.5 / (0.75 + lam))


def test_flat_hessian_without_lambda_does_not_fail(spark):
    # Beyond +-1/2 the piecewise sigmoid has no curvature at all.
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(8)], "a double, y double")
    rows, edges = binned(df, 3, ["a"])
    gbt_fit(rows, ["a"], edges, n_estimators=3, max_depth=2, lambda_=0.0, share_y=True)


def test_single_class_and_depth_zero(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(8)], "a double, y double")
    rows, edges = binned(df, 3, ["a"])
    assert all(n.is_leaf for n in gbt_fit(rows, ["a"], edges, n_estimators=1, max_depth=2, lambda_=1.0).nodes)
    stump = gbt_fit(rows, ["a"], edges, n_estimators=1, max_depth=0, lambda_=1.0)
    assert [n.weight for n in stump.nodes] == [pytest.approx(4.0 / 3.0)]


def test_several_classes_get_a_tree_each_and_learn(spark):
    df, _, label, _ = data(spark, classes=3)
    rows, edges = binned(df)
    model = gbt_fit(rows, NAMES, edges, n_estimators=4, max_depth=2, lambda_=0.1, classes=3, curve=True, validation=df)
    assert model.classes == [0.0, 1.0, 2.0]
    losses = [loss for s, _, loss, _ in model.curve if s == "train"]
    assert losses == sorted(losses, reverse=True)
    assert model.curve[-1][3] > 0.7
    hits = model.predict(df).where(F.col("prediction") == F.col("y")).count() / df.count()
    assert hits == pytest.approx(model.curve[-1][3])


def test_one_class_against_two_gradients_sum_to_zero(spark):
    df, *_ = data(spark, classes=3)
    rows, edges = binned(df)
    model = gbt_fit(rows, NAMES, edges, n_estimators=1, max_depth=2, lambda_=1e-5, classes=3)
    assert any(not n.is_leaf for n in model.nodes)


def test_child_histograms_add_up_to_the_parent(spark):
    df, *_ = data(spark)
    rows, _ = binned(df)
    bins = [f"{n}_bin" for n in NAMES]
    gh = rows.withColumns({"g": F.lit(0.5) - F.col("y"), "h": F.lit(0.25), "node": F.when(F.col("a_bin") <= 3, 2).otherwise(3)})
    parent = splits.gh_histogram(gh.withColumn("node", F.lit(1)), bins).drop("node")
    child = splits.gh_histogram(gh, bins).groupBy("feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    key = lambda r: (r["feature"], r["bin"])
    for a, b in zip(sorted(parent.collect(), key=key), sorted(child.collect(), key=key), strict=True):
        assert key(a) == key(b) and a["n"] == b["n"]
        assert (a["g"], a["h"]) == (pytest.approx(b["g"]), pytest.approx(b["h"]))


def test_ties_take_the_first_feature_and_bin(spark):
    df = spark.createDataFrame([(float(i % 4), float(i % 4), float(i % 4 > 1)) for i in range(40)], "a double, b double, y double")
    rows, edges = binned(df, 7, ["b", "a"])
    model = gbt_fit(rows, ["b", "a"], edges, n_estimators=1, max_depth=1, lambda_=0.1)
    assert model.nodes[0].feature == "b"


def test_histogram_shuffles_sums_only(spark):
    df, *_ = data(spark)
    rows, _ = binned(df)
    gh = rows.withColumns({"g": F.col("y"), "h": F.col("y"), "node": F.lit(1)})
    plan = splits.gh_histogram(gh, [f"{n}_bin" for n in NAMES])._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "partial_sum" in plan[exchange:] and plan.count("Exchange hashpartitioning") == 1


def test_scores_take_a_stream(spark, tmp_path):
    df, *_ = data(spark, 50)
    rows, edges = binned(df)
    model = gbt_fit(rows, NAMES, edges, n_estimators=1, max_depth=2)
    df.write.parquet(str(tmp_path / "in"))
    stream = model.predict(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("scored").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scored").count() == 50


@pytest.mark.parametrize("change", [{}, {"DENSE_CELLS": 0}, {"COUNTED": 50}])
def test_deep_trees_equal_brute_force(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(packed, name, value)
    monkeypatch.setattr(boosting, "STORED_LEVELS", 3)
    df, x, label, _ = data(spark, 300, seed=3)
    df = df.withColumn("b", F.when(F.col("b") == 2, None).otherwise(F.col("b")))
    rows, edges = binned(df, 12)
    model = gbt_fit(rows, NAMES, edges, "y", n_estimators=2, max_depth=11, lambda_=0.01, gamma=0.0001)
    assert max(n.node for n in model.nodes) >= 2**7
    x = x.copy()
    x[x[:, 1] == 2, 1] = np.inf
    want = reference(x, label, [edges.cuts[n] for n in NAMES], 2, 11, 0.01, 0.0001)
    assert np.allclose([r["score"] for r in model.score(df).collect()], want, atol=1e-5)


def reference(x, y, cuts, rounds, depth, lam, gamma):
    """Boosting over raw values as `brute_force`, with a penalty of its own and missing values (inf) to the right."""
    score = np.zeros(len(y))
    for _ in range(rounds):
        g, h = logistic(y, score)
        step = np.zeros(len(y))

        def grow(rows, level):
            best = (0.0, None)
            for j, edges in enumerate(cuts if level < depth else []):
                for e in edges:
                    left = rows & (x[:, j] <= e)
                    right = rows & ~left
                    if left.any() and (right & np.isfinite(x[:, j])).any():
                        parts = [g[s].sum() ** 2 / (h[s].sum() + lam) for s in (left, right)]
                        gain = round(0.5 * (sum(parts) - g[rows].sum() ** 2 / (h[rows].sum() + lam)) - gamma, 6)
                        if gain > best[0]:
                            best = (gain, (left, right))
            if best[1] is None:
                step[rows] = -g[rows].sum() / (h[rows].sum() + lam)
            else:
                for side in best[1]:
                    grow(side, level + 1)

        grow(np.ones(len(y), bool), 0)
        score = score + step
    return score


@pytest.mark.parametrize("bins, size", [(3, 1), (255, 1), (256, 2), (70_000, 4)])
def test_packed_bins_come_back(spark, bins, size):
    packing = packed.Packing(3, bins)
    assert packing.size == size
    rows = [(i, i % bins, bins - 1, None if i % 3 else 0) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, a int, b int, c int")
    for columns in ([F.col("a"), F.col("b"), F.col("c")], [F.array("a", "b", "c")]):
        table = packed.pack_bins(df, columns, {"i": F.col("i")}, packing).orderBy("i")
        got = packing.matrix(table.toArrow().combine_chunks().column("_bins").combine_chunks())
        want = np.array([[a, b, 256**size - 1 if c is None else c] for _, a, b, c in rows])
        assert (got == want).all()
        at_most = table.where(packing.at_most("_bins", 0, 1)).count()
        assert at_most == sum(a <= 1 for _, a, _, _ in rows) and table.where(packing.at_most("_bins", 2, bins - 1)).count() == sum(c == 0 for *_, c in rows)


def test_chain_of_sixty_levels():
    nodes = []
    for i in range(60):
        nodes += [TreeNode(0, 0, 2 ** (i + 1) - 1, "a", i, float(i), 0.0, None), TreeNode(0, 0, 2 ** (i + 2) - 2, None, None, None, None, float(i))]
    nodes.append(TreeNode(0, 0, 2**61 - 1, None, None, None, None, 99.0))
    tree = packed.NodeArrays.of(nodes, {"a": 0}, "value")
    x = np.array([[-1.0], [0.0], [0.5], [59.0], [59.5], [np.nan]])
    assert tree.weight[tree.walk(x)].tolist() == [0.0, 0.0, 1.0, 59.0, 99.0, 99.0]
    # From a stored node on.
    assert tree.weight[tree.walk(x[2:4], tree.index(np.array([3, 2**30 - 1])))].tolist() == [1.0, 59.0]


def test_wide_levels_are_looked_up(spark, monkeypatch):
    df = spark.createDataFrame([(n, float(v)) for n in (4, 5, 6, 7) for v in (0, 1, 2)] + [(5, None)], "node bigint, x double").withColumns({"at": F.lit("own"), "cut": F.lit(1)})
    level = [{"node": n, "feature": "x", "bin": n - 5} for n in (4, 5, 6)]
    plain = splits.tree_route(df, level)
    monkeypatch.setattr(splits, "INLINE_SPLITS", 0)
    wide = splits.tree_route(df, level)
    assert plain.columns == wide.columns and sorted(plain.collect(), key=str) == sorted(wide.collect(), key=str)


@pytest.mark.parametrize("step", [1, 1000])
def test_wide_levels_need_no_join(spark, monkeypatch, step):
    """Dense and sparse levels, of which each row meets all: joins made their plans grow exponentially."""
    df = spark.range(4).select(F.col("id").cast("double").alias("x"), F.explode(F.array(*(F.lit(n).cast("bigint") for n in (0, 1, 5, 40 * step, 41 * step, 2**40)))).alias("node"))
    level = [{"node": n * step, "feature": "x", "edge": 1.5} for n in range(1, 41)]
    got = splits.tree_route(df, level, column="edge")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(splits, "INLINE_SPLITS", 100)
    plain = splits.tree_route(df, level, column="edge")
    assert sorted(got.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("classes", [1, 3])
def test_rows_start_at_the_root_and_never_without_a_node(spark, monkeypatch, classes):
    """Arrays that are null cost far more on their way to Python than others."""
    without, measure = [], packed.dense_histogram

    def spied(rows, *rest):
        without.append(rows.where("_at IS NULL OR size(_at) = 0").count())
        return measure(rows, *rest)

    monkeypatch.setattr(boosting, "dense_histogram", spied)
    df, _, _, _ = data(spark, 200, classes=max(2, classes))
    rows, edges = binned(df)
    gbt_fit(rows, NAMES, edges, n_estimators=2, max_depth=2, classes=classes)
    assert without == [0] * 4


def test_validation_rows_are_made_once(spark, monkeypatch):
    df, *_ = data(spark)
    rows, edges = binned(df)
    labels, write = [], boosting.materialise
    monkeypatch.setattr(boosting, "materialise", lambda df, label: labels.append(label) or write(df, label))
    model = gbt_fit(rows, NAMES, edges, n_estimators=3, max_depth=1, curve=True, validation=df)
    assert labels.count("validation") == 1
    ours, theirs = ([p[2:] for p in model.curve if p[0] == s] for s in ("train", "validation"))
    assert np.allclose(ours, theirs)


@pytest.mark.parametrize("mission, classes", [("classification", None), ("classification", [0.0, 1.0, 2.0]), ("regression", None)])
def test_rows_equal_in_label_and_bins_train_as_one(spark, monkeypatch, mission, classes):
    """Few kinds of rows, many copies: the same trees and curve as from all rows, which no level reads."""
    kinds, _, _, _ = data(spark, 30, classes=3 if classes else 2)
    kinds = kinds.withColumn("a", F.when(F.col("c") < 0.9, F.col("a"))).withColumn("n", (F.col("c") * 20).cast("int") + 1)
    label = F.when(F.col("i") != 3, F.col("target" if mission == "regression" else "y"))
    df = kinds.select(*NAMES, "y", "target", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select(*NAMES, label.alias("y"))
    rows, edges = binned(df, 4)
    options = dict(n_estimators=3, max_depth=3, lambda_=0.001, mission=mission, classes=classes, curve=True)
    read, measure = [], packed.dense_histogram
    monkeypatch.setattr(boosting, "dense_histogram", lambda frame, *rest: read.append(frame.count()) or measure(frame, *rest))
    monkeypatch.setattr(boosting, "INLINE_LEAVES", 4)
    some = gbt_fit(rows, NAMES, edges, **options)
    assert max(read) <= 60 < rows.count() // 4
    monkeypatch.setattr(boosting, "GROUPED", 10**9)
    every = gbt_fit(rows, NAMES, edges, **options)
    assert max(read) == rows.count()
    key = lambda n: (n.tree, n.cls, n.node, n.feature, n.bin)
    assert [key(n) for n in some.nodes] == [key(n) for n in every.nodes] and len(some.nodes) > 3
    assert np.allclose([n.weight for n in some.nodes if n.is_leaf], [n.weight for n in every.nodes if n.is_leaf])
    plain = lambda m: np.array([p[2:] for p in m.curve], float)
    assert np.allclose(plain(some), plain(every), equal_nan=True)
