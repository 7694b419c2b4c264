import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe.operators import binning
from splitframe.plans.boosting import gbt_fit
from splitframe.plans.linear import lr_fit, svm_fit


def table(spark, rows, width, seed=0, label=(0.0, 1.0)):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, width)), 3)
    y = np.where(x[:, 0] + x[:, width // 2] > 0, label[1], label[0])
    data = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id bigint, v array<double>, y double"), x, y


def spread(df, width):
    return df.select("id", "y", *[F.col("v")[j].alias(f"x{j}") for j in range(width)])


def test_models_are_those_of_named_columns(spark):
    df, *_ = table(spark, 300, 6)
    names = [f"x{j}" for j in range(6)]
    # Rows that linear models leave out, and a missing value that goes right in trees.
    more = spark.createDataFrame([(900, [None] + [0.5] * 5, 1.0), (901, [0.1] * 6, None)], df.schema)
    df = df.unionByName(more)
    wide = spread(df, 6)
    a, b = lr_fit(df, names, n_epochs=3, values="v", split_col=2), lr_fit(wide, names, n_epochs=3, split_col=2)
    assert np.allclose(a.weights, b.weights)
    for got, want in zip(a.score_split(df).orderBy("id").limit(300).collect(), b.score_split(wide).orderBy("id").limit(300).collect()):
        assert [got[c] for c in ("z", "z_company", "z_partner")] == pytest.approx([want[c] for c in ("z", "z_company", "z_partner")])
    a, b = (svm_fit(d, names, n_steps=4, batch_size=32, lambda_=0.1, **o) for d, o in ((df, {"values": "v"}), (wide, {})))
    assert np.allclose(a.weights, b.weights)

    labelled, wide = df.where("y is not null"), wide.where("y is not null")
    edges = binning.array_edges(labelled, "v", 7)
    assert edges == binning.quantile_edges(wide, names, 7)
    a = gbt_fit(labelled, names, edges, n_estimators=2, curve=True, validation=labelled, values="v")
    b = gbt_fit(binning.bin_label(wide, edges), names, edges, n_estimators=2, curve=True, validation=wide)
    assert [(n.node, n.feature, n.bin) for n in a.nodes] == [(n.node, n.feature, n.bin) for n in b.nodes]
    assert np.allclose([c[2] for c in a.curve], [c[2] for c in b.curve])
    for out in ("score", "predict"):
        one = getattr(a, out)(labelled, out="o", values="v").orderBy("id").collect()
        two = getattr(b, out)(wide, out="o").orderBy("id").collect()
        assert np.allclose([r["o"] for r in one], [r["o"] for r in two])


def test_five_thousand_features(spark):
    df, x, y = table(spark, 160, 5000, seed=4, label=(-1.0, 1.0))
    names = [f"x{j}" for j in range(5000)]
    svm = svm_fit(df, names, n_steps=3, batch_size=None, lambda_=0.1, values="v")
    assert svm.predict(df).where("prediction = y").count() > 120
    df = df.withColumn("y", F.greatest("y", F.lit(0.0)))
    lr = lr_fit(df, names, n_epochs=2, lr=0.5, values="v")
    first = -0.5 * x.T @ (0.5 - np.maximum(y, 0)) / 160
    p = 1 / (1 + np.exp(-(x @ first)))
    assert np.allclose(lr.weights[:, 0], first - 0.25 * x.T @ (p - np.maximum(y, 0)) / 160)
    edges = binning.array_edges(df, "v", 3)
    assert np.allclose([edges.cuts[n] for n in names[:50]], np.round(np.quantile(x[:, :50], [0.25, 0.5, 0.75], axis=0).T, 3), atol=1e-9)
    model = gbt_fit(df, names, edges, n_estimators=1, max_depth=3, lambda_=1.0, values="v")
    found = model.predict(df, values="v")
    assert {n.feature for n in model.nodes if n.feature} and found.where("prediction = y").count() > 120


def test_arrays_of_several_lengths_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0.0), ([1.0], 1.0)], "v array<double>, y double").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        binning.array_edges(df, "v", 2)
