import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitframe import Party
from splitframe.operators import bin_label, psi_cardinality, quantile_edges
from splitframe.plans import RunOptions, evaluate, gbt_fit, lr_fit, run_linear, run_trees
from splitframe.sources import (
    gen_party_tables,
    load_linear,
    load_trees,
    save_linear,
    save_trees,
    scan_aligned_pair,
    scan_bins,
    scan_dense_matrix,
    scan_lines,
    scan_npy,
    scan_party_csv,
    scan_shares,
    sink_shares,
    spread_columns,
)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_party_csv(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,x0,y\n007,1.1,1\n8,,0\n")
    party = scan_party_csv(spark, path)
    assert party.df.dtypes == [("id", "string"), ("x0", "double"), ("y", "double")]
    assert [tuple(r) for r in party.df.collect()] == [("007", 1.1, 1.0), ("8", None, 0.0)]
    assert (party.spec.features, party.spec.label) == (("x0",), "y")
    single = scan_party_csv(spark, path, float32=True).df.first()["x0"]
    assert single == float(np.float32(1.1))


def test_id_by_name_and_missing_id(spark, tmp_path):
    path = write(tmp_path / "c.csv", "x0,id\n1.5,a\n")
    assert scan_party_csv(spark, path, "id").spec.features == ("x0",)
    with pytest.raises(ValueError):
        scan_party_csv(spark, path, "key")


def test_public_columns_are_integers(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,x,b\na,1,3\n")
    assert dict(scan_party_csv(spark, path, public=("b",)).df.dtypes)["b"] == "int"


def test_aligned_pair_is_matched_by_id_not_place(spark):
    a = Party.of(spark.createDataFrame([("1", 1.0), ("2", 2.0)], "id string, x double"))
    b = Party.of(spark.createDataFrame([("2", 20.0, 1.0), ("1", 10.0, 0.0)], "id string, z double, y double"))
    joined, own, theirs, holder = scan_aligned_pair(a, b)
    assert (own, theirs, holder) == (["x"], ["z"], "partner")
    assert all(r["z"] == 10 * r["x"] for r in joined.collect())


def test_lines_are_numbered_across_blocks_and_files(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for f, span in (("a", range(0, 3000)), ("b", range(3000, 4000))):
        (folder / f).write_text("".join(f"line {i}\n" for i in span))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = scan_lines(spark, str(folder))
        assert df.rdd.getNumPartitions() > 4
        assert df.where(F.concat(F.lit("line "), "row") != F.col("value")).count() == 0
        assert df.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_dense_matrix_with_labels(spark, tmp_path):
    m = write(tmp_path / "m.data", " 1 2.5  -3\n4\t5 6 \n")
    y = write(tmp_path / "m.labels", "-1\n1\n")
    df = spread_columns(scan_dense_matrix(spark, m, y), 3)
    assert sorted(tuple(r) for r in df.collect()) == [(0, -1.0, 1.0, 2.5, -3.0), (1, 1.0, 4.0, 5.0, 6.0)]


def test_npy(spark, tmp_path):
    data = np.arange(200_001 * 2, dtype=np.float32).reshape(-1, 2)
    np.save(tmp_path / "a.npy", data)
    got = scan_npy(spark, str(tmp_path / "a.npy"), ["p", "q"]).agg(F.count("row"), F.max("row"), F.sum("p"), F.sum("q")).first()
    assert tuple(got) == (200_001, 200_000, data[:, 0].sum(dtype=float), data[:, 1].sum(dtype=float))
    with pytest.raises(ValueError):
        scan_npy(spark, str(tmp_path / "a.npy"), ["p"])


def test_generated_parties(spark):
    company, partner = gen_party_tables(spark, 50, 30, 20, seed=3)
    assert (company.count(), partner.count()) == (80, 70)
    assert psi_cardinality(company, partner).first()["n"] == 50
    row = company.first()
    assert len(row["id"]) == 20 and 0 <= row["x0"] < 100
    again, _ = gen_party_tables(spark, 50, 30, 20, seed=3)
    assert company.collect() == again.collect()
    assert [r["id"] for r in company.collect()] != sorted(r["id"] for r in company.collect())


def test_share_formats(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1.5), ("r2", -2.0)], "row_id string, x double")
    for fmt in ("parquet", "csv"):
        sink_shares(df, df, str(tmp_path / f"{fmt}c"), str(tmp_path / f"{fmt}p"), fmt)
        a, b = scan_shares(spark, str(tmp_path / f"{fmt}c"), str(tmp_path / f"{fmt}p"), fmt)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) == [("r1", 1.5), ("r2", -2.0)]
    np.save(tmp_path / "s.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    a, _ = scan_shares(spark, str(tmp_path / "s.npy"), str(tmp_path / "s.npy"), "npy")
    assert sorted(map(tuple, a.collect())) == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    with pytest.raises(ValueError):
        sink_shares(df, df, "x", "y", "txt")
    with pytest.raises(ValueError):
        scan_shares(spark, "x", "y", "txt")


def halves(spark, n=200):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.0, -1.0, 2.0] > 0).astype(float)
    a = spark.createDataFrame([(str(i), float(x[i, 0])) for i in range(n)], "id string, a double")
    b = spark.createDataFrame([(str(i), float(x[i, 1]), float(x[i, 2]), float(y[i])) for i in range(n)], "id string, b double, c double, y double")
    return Party.of(a), Party.of(b)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_linear_model_store(spark, tmp_path, fmt):
    a, b = halves(spark)
    df = a.df.join(b.df, "id")
    model = lr_fit(df, ["a", "b", "c"], n_epochs=2, split_col=1)
    paths = {p: str(tmp_path / p) for p in ("company", "partner")}
    save_linear(spark, model, paths, fmt)
    again = load_linear(spark, paths)
    assert np.array_equal(model.weights, again.weights) and again.split_col == 1
    held = spark.read.format(fmt).option("header", True).load(paths["partner"] + "/weights")
    assert {r["feature"] for r in held.collect()} == {"b", "c"}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tree_model_store(spark, tmp_path, fmt):
    a, b = halves(spark)
    df = a.df.join(b.df, "id")
    edges = quantile_edges(df, ["a", "b", "c"], 6)
    model = gbt_fit(bin_label(df, edges), ["a", "b", "c"], edges, n_estimators=2, max_depth=2)
    paths = {p: str(tmp_path / p) for p in ("company", "partner")}
    save_trees(spark, model, ["a"], paths, 1, fmt)
    again = load_trees(spark, paths)
    assert again.edges == edges
    x, z = ([r["score"] for r in m.score(df).orderBy("id").collect()] for m in (model, again))
    assert np.allclose(x, z, atol=1e-9)
    held = spark.read.format(fmt).option("header", True).load(paths["partner"] + "/edges")
    assert {r["feature"] for r in held.collect()} == {"b", "c"}


def test_different_infos_are_refused(spark, tmp_path):
    for party, lam in (("company", 0.0), ("partner", 0.5)):
        spark.createDataFrame([(json.dumps({"lambda": lam}),)], "value string").write.text(str(tmp_path / party / "info"))
    with pytest.raises(ValueError):
        load_linear(spark, {p: str(tmp_path / p) for p in ("company", "partner")})


@pytest.mark.parametrize("through", [True, False])
def test_linear_run(spark, tmp_path, through):
    a, b = halves(spark)
    check = a.df.join(b.df, "id")
    paths = {p: str(tmp_path / p) for p in ("company", "partner")}
    opt = RunOptions(seed="s", through_shares=through, batch_size=64, n_epochs=2, lr=0.5, model_to=paths)
    result = run_linear(a, b, opt, validation=check)
    assert result.label_party == "partner"
    assert result.model.curve[-1][2] > 0.9
    assert evaluate(load_linear(spark, paths), check) == result.model.curve[-1][2]


def test_tree_run_stores_shares_bins_and_model(spark, tmp_path):
    a, b = halves(spark)
    check = a.df.join(b.df, "id")
    named = lambda kind: {p: str(tmp_path / kind / p) for p in ("company", "partner")}
    opt = RunOptions(seed="s", n_estimators=2, max_depth=2, reg_coef=1e-3, shares_to=named("shares"), model_to=named("model"), bins_to=str(tmp_path / "bins"))
    result = run_trees(a, b, opt, validation=check)
    plain = run_trees(a, b, RunOptions(n_estimators=2, max_depth=2, reg_coef=1e-3, through_shares=False, curve=False))
    for m, n in zip(result.model.nodes, plain.model.nodes, strict=True):
        assert (m.node, m.feature, m.bin) == (n.node, n.feature, n.bin)
    assert scan_bins(spark, str(tmp_path / "bins"), "row_id").count() == 600
    assert load_trees(spark, named("model")).predict(check).where("prediction = y").count() == round(200 * result.model.curve[-1][3])
