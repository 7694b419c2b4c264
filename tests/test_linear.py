import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe.operators.position import position_rows
from splitframe.plans import linear, lr_fit, svm_fit

NAMES = ["a", "b", "c"]


def data(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(scale=0.3, size=n) > 0).astype(float)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(5), x, y


def descend(x, y, act, epochs, size, lr, lam):
    w = np.zeros((x.shape[1], y.shape[1]))
    for t in range(1, epochs + 1):
        for j in range(0, len(x), size):
            xb, yb = x[j : j + size], y[j : j + size]
            w = (1 - lam) * w - lr / t / len(xb) * xb.T @ (act(xb @ w) - yb)
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("size", [None, 64, 100, 1000])
@pytest.mark.parametrize("shared", [False, True])
def test_weights_equal_numpy(spark, size, shared):
    df, x, y = data(spark)
    model = lr_fit(df, NAMES, lambda_=0.01, lr=0.3, n_epochs=2, batch_size=size, order_by=["id"], share_y=shared)
    act = (lambda z: np.clip(z + 0.5, 0, 1)) if shared else sigmoid
    assert np.allclose(model.weights, descend(x, y[:, None], act, 2, size or len(x), 0.3, 0.01))


def test_wide_path_equals_the_inlined_one(spark, monkeypatch):
    df, *_ = data(spark)
    for shared in (False, True):
        a = lr_fit(df, NAMES, n_epochs=3, share_y=shared).weights
        monkeypatch.setattr(linear, "INLINE_SUMS", 0)
        assert np.allclose(a, lr_fit(df, NAMES, n_epochs=3, share_y=shared).weights)
        monkeypatch.undo()


def test_several_classes_equal_numpy(spark):
    df, x, _ = data(spark)
    label = np.digitize(x[:, 0], [-0.5, 0.5])
    three = df.withColumn("y", F.when(F.col("a") < -0.5, 0).when(F.col("a") < 0.5, 1).otherwise(2))
    model = lr_fit(three, NAMES, classes=3, n_epochs=4, lr=1.0)
    soft = lambda z: np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(model.weights, descend(x, np.eye(3)[label], soft, 4, len(x), 1.0, 0.0))
    # Both rare classes lie on the sides, so most rows are told apart.
    assert linear.evaluate(model, three) > 0.5


def test_several_classes_cannot_be_shared(spark):
    df, *_ = data(spark)
    with pytest.raises(ValueError):
        lr_fit(df, NAMES, classes=2, share_y=True)


def test_validation_points_every_few_steps(spark):
    df, *_ = data(spark)
    model = lr_fit(df, NAMES, batch_size=100, order_by=["id"], n_epochs=2, validation=df, val_steps=2)
    assert [s for _, s, _ in model.curve] == [0, 2, 4]
    assert model.curve[-1][2] > 0.9


def test_batches_need_an_order(spark):
    df, *_ = data(spark)
    with pytest.raises(ValueError):
        lr_fit(df, NAMES, batch_size=10)


def test_svm_equals_numpy_on_all_rows(spark):
    df, x, y = data(spark)
    pm = df.withColumn("y", F.when(F.col("y") == 0, -1.0).otherwise(F.col("y")))
    model = svm_fit(pm, NAMES, lambda_=0.1, n_steps=5, batch_size=None)
    s, w = np.where(y == 0, -1.0, 1.0), np.zeros(3)
    for t in range(1, 6):
        rate, active = 1 / (0.1 * t), s * (x @ w) < 1
        w = (1 - rate * 0.1) * w + rate / len(x) * (x[active].T @ s[active])
    assert np.allclose(model.weights[:, 0], w)
    assert linear.evaluate(model, pm) > 0.9


def test_svm_one_against_the_rest(spark):
    df, *_ = data(spark)
    three = df.withColumn("y", F.when(F.col("a") < -0.5, 0).when(F.col("a") < 0.5, 1).otherwise(2))
    model = svm_fit(three, NAMES, classes=3, lambda_=0.1, n_steps=5, batch_size=None)
    assert model.weights.shape == (3, 3)
    assert set(r["prediction"] for r in model.predict(three).select("prediction").distinct().collect()) <= {0, 1, 2}


def test_drawn_batches_have_distinct_rows_and_repeat_with_the_seed(spark, monkeypatch):
    monkeypatch.setattr(linear, "DRAWN_ROWS", 120)
    df, *_ = data(spark)
    placed = position_rows(df.select("id", *NAMES, "y"), "id")
    first = [sorted(r["id"] for r in b.collect()) for b in linear._drawn(placed, 5, 40, 1)]
    again = [sorted(r["id"] for r in b.collect()) for b in linear._drawn(placed, 5, 40, 1)]
    assert first == again
    assert all(len(set(ids)) == 40 for ids in first)
    assert first[0] != first[1]


def test_sampled_svm_takes_batches_larger_than_the_table(spark):
    df, *_ = data(spark, 30)
    pm = df.withColumn("y", F.when(F.col("y") == 0, -1.0).otherwise(F.col("y")))
    whole = svm_fit(pm, NAMES, lambda_=0.1, n_steps=3, batch_size=None)
    assert np.allclose(svm_fit(pm, NAMES, lambda_=0.1, n_steps=3, batch_size=64).weights, whole.weights)


def test_each_party_scores_its_own_columns(spark):
    df, x, _ = data(spark)
    model = lr_fit(df, NAMES, n_epochs=2, split_col=1)
    r = model.score_split(df).first()
    assert r["z_company"] == pytest.approx(model.weights[0, 0] * r["a"])
    assert r["z"] == pytest.approx(r["z_company"] + r["z_partner"])


def test_large_and_small_batches_are_drawn_alike(spark, monkeypatch):
    df, *_ = data(spark)
    placed = position_rows(df.select("id", *NAMES, "y"), "id")
    drawn = lambda: [sorted(r["id"] for r in b.collect()) for b in linear._drawn(placed, 4, 200, 1)]
    small = drawn()
    monkeypatch.setattr(linear, "DRAWN_ROWS", 50)
    assert small == drawn()
    assert all(len(set(ids)) == 200 for ids in small) and small[0] != small[1]


def test_draws_are_even(spark):
    df, *_ = data(spark)
    placed = position_rows(df.select("id"), "id")
    batches = linear._drawn(placed, 400, 30, 2)
    batch = next(batches)
    stored = spark.read.parquet(batch.inputFiles()[0].rsplit("/", 1)[0])
    assert stored.groupBy("_step").count().where("count <> 30").count() == 0
    counts = [r["count"] for r in stored.groupBy("id").count().collect()]
    # 40 of 400 steps each, with a standard deviation of 6.
    assert len(counts) == 300 and 10 < min(counts) and max(counts) < 70
    assert 4.5 < np.std(counts) < 7.5


def test_large_batch_steps(spark, monkeypatch):
    monkeypatch.setattr(linear, "DRAWN_ROWS", 50)
    df, *_ = data(spark)
    pm = df.withColumn("y", F.when(F.col("y") == 0, -1.0).otherwise(F.col("y")))
    model = svm_fit(pm, NAMES, lambda_=0.1, n_steps=5, batch_size=250)
    assert linear.evaluate(model, pm) > 0.85


def test_weights_that_run_away_stay_valid(spark):
    df, *_ = data(spark)
    model = linear.LinearModel(NAMES, "logistic", None, 0.0, np.array([[np.inf], [1e300], [-1.0]]))
    assert model.predict(df).count() == 300


def test_rows_with_missing_values_take_no_part_either_way(spark, monkeypatch):
    df, x, y = data(spark)
    holes = df.withColumns(
        {
            "a": F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("a")),
            "b": F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("b")),
            "y": F.when(F.col("id") % 13 != 0, F.col("y")),
        }
    )
    keep = np.array([i % 7 != 0 and i % 11 != 0 and i % 13 != 0 for i in range(len(x))])
    want = descend(x[keep], y[keep, None], sigmoid, 3, len(x), 0.1, 0.0)
    for inline in (64, 0):
        monkeypatch.setattr(linear, "INLINE_SUMS", inline)
        assert np.allclose(lr_fit(holes, NAMES, n_epochs=3).weights, want)


def test_no_rows_is_a_plain_error(spark):
    df, *_ = data(spark)
    for fit in (lr_fit, svm_fit):
        with pytest.raises(ValueError, match="no rows"):
            fit(df.where("id < 0"), NAMES, batch_size=None)


def test_two_thousand_features_are_scored(spark):
    names = [f"f{i}" for i in range(2000)]
    df = spark.range(20).select("id", *[(F.col("id") * 0.001 * (i % 7)).alias(n) for i, n in enumerate(names)])
    w = np.linspace(-1, 1, 2000)[:, None]
    model = linear.LinearModel(names, "logistic", None, 0.0, w, split_col=800)
    x = np.outer(np.arange(20), [0.001 * (i % 7) for i in range(2000)])
    got = model.score_split(df).orderBy("id").select("z_company", "z_partner", "z").collect()
    assert np.allclose([r["z"] for r in got], (x @ w).ravel()) and np.allclose([r["z_company"] for r in got], (x[:, :800] @ w[:800]).ravel())


def test_slices_of_very_many_parts_are_one_range(spark):
    from splitframe.operators.position import _MID, ROW_BITS, Positioned

    rows = [(p, k, (p << ROW_BITS) + k) for p in range(0, 4000, 2) for k in range(3)]
    df = spark.createDataFrame(rows, f"p int, k int, {_MID} long")
    placed = Positioned(df, tuple(range(0, 4000, 2)), tuple(range(0, 6000, 3)), 6000)
    for low, high in ((0, 6000), (1, 5998), (2999, 3001), (-5, 2), (5999, 9999), (7, 7)):
        got = [(r["p"] // 2) * 3 + r["k"] for r in placed.slice(low, high).collect()]
        assert sorted(got) == list(range(max(low, 0), min(high, 6000)))


def test_newton_steps_reach_a_certified_optimum(spark):
    from splitframe.plans.baselines import newton_lr

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.7 + rng.logistic(size=400) > 0).astype(float)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3)
    w, worst = newton_lr(df, ["a", "b", "c"])
    one = np.column_stack([x, np.ones(400)])
    assert worst <= 1e-10 and np.abs(one.T @ (1 / (1 + np.exp(-one @ w)) - y)).max() < 1e-6
    with pytest.raises(ValueError):
        newton_lr(df.where("false"), ["a"])
    # Separable classes have no optimum: the certificate says so.
    apart = spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)], "a double, y double")
    assert newton_lr(apart, ["a"], max_steps=3)[1] > 1e-10


def test_the_certified_baseline_joins_its_table_once(spark, monkeypatch):
    from splitframe.plans import baselines

    df, *_ = data(spark)
    df = df.withColumn("k", F.monotonically_increasing_id())
    both = df.select("k", "a", "b").join(df.select("k", "c", "y"), "k")
    read = []
    newton = baselines.newton_lr
    monkeypatch.setattr(baselines, "newton_lr", lambda given, *rest: read.append(given) or newton(given, *rest))
    found = baselines.baseline_lr(both, both, NAMES, certify=True).collect()
    assert len(found) == 300 and found[0]["gradient"] < 1e-10
    assert "Join" not in read[0]._jdf.queryExecution().optimizedPlan().toString()
