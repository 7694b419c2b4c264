from dataclasses import replace

import numpy as np
import pytest

from splitframe.plans import boosting, linear, runs
from splitframe.plans import RunOptions, resume_linear, resume_trees, run_linear, run_trees
from splitframe.spec import Party


def sides(spark, n=120, apart=False):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 4))
    y = (x @ [1.0, -1.0, 0.5, 2.0] > 0).astype(float)
    left = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x[:, :2])], "id long, x0 double, x1 double")
    shift = 10_000 if apart else 5
    rows = [(i + shift, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x[:, 2:], y))]
    right = spark.createDataFrame(rows, "key long, x0 double, x1 double, y double")
    return Party.of(left), Party.of(right, id="key")


@pytest.mark.parametrize("through_shares", [True, False])
def test_equal_feature_names_and_different_id_names(spark, through_shares):
    options = RunOptions(seed="s", through_shares=through_shares, n_epochs=3, max_depth=1, k_quantiles=4)
    company, partner = sides(spark)
    other = Party.of(partner.df.toDF("id", "p0", "p1", "y"))
    renamed = Party.of(company.df.toDF("id", "c0", "c1"))
    got, want = (run_linear(c, p, options).model for c, p in ((company, partner), (renamed, other)))
    assert got.features == ["company_x0", "company_x1", "partner_x0", "partner_x1"] and np.allclose(got.weights, want.weights)
    got, want = (run_trees(c, p, options) for c, p in ((company, partner), (renamed, other)))
    assert got.model.features == ["company_x0", "company_x1", "partner_x0", "partner_x1"]
    a, b = (r.model.predict(r.train).groupBy("prediction").count().collect() for r in (got, want))
    assert sorted(a) == sorted(b)


def test_no_common_ids_is_a_plain_error(spark):
    company, partner = sides(spark, apart=True)
    for run in (run_linear, run_trees):
        with pytest.raises(ValueError):
            run(company, partner, RunOptions(seed="s"))


def test_shares_need_a_seed(spark):
    company, partner = sides(spark)
    for run in (run_linear, run_trees):
        with pytest.raises(ValueError, match="seed"):
            run(company, partner)


def test_stored_shares_bins_and_edges_train_like_the_run_that_wrote_them(spark, tmp_path):
    company, partner = sides(spark)
    stored = {side: str(tmp_path / side) for side in ("company", "partner")}
    options = RunOptions(seed="s", n_epochs=3, max_depth=2, k_quantiles=4, reg_coef=1e-3, batch_size=50, shares_to=stored, bins_to=str(tmp_path / "bins"))
    later = RunOptions(n_epochs=3, max_depth=2, reg_coef=1e-3, batch_size=50)
    trees = run_trees(company, partner, options)
    names = trees.company_features
    again = resume_trees(spark, stored, str(tmp_path / "bins"), names, later)
    assert again.model.features == trees.model.features and again.model.edges == trees.model.edges
    assert again.label_party == trees.label_party != ""
    key = lambda n: (n.tree, n.node, n.feature, n.bin, n.edge)
    assert [key(n) for n in again.model.nodes] == [key(n) for n in trees.model.nodes]
    lines = run_linear(company, partner, options)
    again = resume_linear(spark, stored, names, later)
    assert again.model.features == lines.model.features and again.model.split_col == 2
    assert np.allclose(again.model.weights, lines.model.weights)


def failing(monkeypatch, module, name, after):
    """Have a function of ``module`` fail from its call number ``after`` on; gives the list of calls."""
    whole, calls = getattr(module, name), []

    def run(*args):
        calls.append(args)
        if len(calls) > after:
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(module, name, run)
    return calls


def test_trees_go_on_after_the_last_finished_one(spark, tmp_path, monkeypatch):
    company, partner = sides(spark)
    options = RunOptions(seed="s", n_estimators=3, max_depth=2, k_quantiles=4, reg_coef=1e-3, run_dir=str(tmp_path / "run"))
    whole = run_trees(company, partner, replace(options, run_dir=None)).model
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        failing(patch, boosting, "tree_fit", 1)
        run_trees(company, partner, options)
    with monkeypatch.context() as patch:
        calls = failing(patch, boosting, "tree_fit", 9)
        cuts = failing(patch, runs, "quantile_edges", 0)
        joins = failing(patch, runs, "psi_shares", 0)
        result = run_trees(company, partner, options)
    assert len(calls) == 2 and not cuts and not joins
    key = lambda n: (n.tree, n.cls, n.node, n.feature, n.bin, n.edge)
    assert [key(n) for n in result.model.nodes] == [key(n) for n in whole.nodes] and result.model.edges == whole.edges
    assert np.allclose([n.weight for n in result.model.nodes if n.is_leaf], [n.weight for n in whole.nodes if n.is_leaf])
    assert [p[:2] for p in result.model.curve] == [p[:2] for p in whole.curve] and np.allclose([p[2] for p in result.model.curve], [p[2] for p in whole.curve])
    assert result.train.count() == 115 and (tmp_path / "run" / "work").exists()
    monkeypatch.setattr(boosting, "INLINE_LEAVES", 1)
    more = run_trees(company, partner, replace(options, n_estimators=5))
    assert more.model.nodes[: len(whole.nodes)] == result.model.nodes and more.model.trees == 5
    assert run_trees(company, partner, replace(options, n_estimators=2)).model.trees == 2
    with pytest.raises(ValueError, match="max_depth"):
        run_trees(company, partner, replace(options, max_depth=3))
    with pytest.raises(ValueError, match="kind"):
        run_linear(company, partner, options)
    result.remove()
    assert not (tmp_path / "run").exists()


@pytest.mark.parametrize("through_shares", [True, False])
def test_linear_runs_go_on_after_the_last_finished_epoch(spark, tmp_path, monkeypatch, through_shares):
    company, partner = sides(spark)
    options = RunOptions(seed="s", n_epochs=4, batch_size=50, through_shares=through_shares, run_dir=str(tmp_path / "run"))
    table = run_linear(company, partner, replace(options, run_dir=None))
    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        failing(patch, linear, "residual_sums", 7)
        run_linear(company, partner, options, table.train)
    with monkeypatch.context() as patch:
        calls = failing(patch, linear, "residual_sums", 99)
        result = run_linear(company, partner, options, table.train)
    assert len(calls) == 6 and np.allclose(result.model.weights, table.model.weights)
    assert [p[1] for p in result.model.curve] == list(range(12))
    assert result.label_party == table.label_party
    result.remove()
    assert not (tmp_path / "run").exists()
    table.remove()  # nothing of its own


def test_a_run_that_goes_on_reads_the_rows_it_packed(spark, tmp_path, monkeypatch):
    company, partner = sides(spark)
    options = RunOptions(seed="s", max_depth=2, k_quantiles=4, reg_coef=1e-3, curve=False, run_dir=str(tmp_path / "run"))
    run_trees(company, partner, replace(options, n_estimators=1))
    mark = tmp_path / "run" / "tables" / "binned" / "_SUCCESS"
    written = mark.stat().st_mtime_ns
    frames, grow = [], boosting.tree_fit
    monkeypatch.setattr(boosting, "tree_fit", lambda model, frame, *rest: frames.append(frame) or grow(model, frame, *rest))
    run_trees(company, partner, replace(options, n_estimators=2))
    assert mark.stat().st_mtime_ns == written and len(frames) == 1
    assert all("/run/tables/binned/" in f for f in frames[0].inputFiles())


def test_stored_bins_come_from_one_share_without_a_join(spark, tmp_path, monkeypatch):
    from splitframe.sources import stores

    company, partner = sides(spark)
    stored = {side: str(tmp_path / side) for side in ("company", "partner")}
    plans, write = [], stores.sink_bins
    monkeypatch.setattr(stores, "sink_bins", lambda df, *rest: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *rest))
    options = RunOptions(seed="s", n_estimators=1, max_depth=1, k_quantiles=4, reg_coef=1e-3, curve=False, shares_to=stored, bins_to=str(tmp_path / "bins"))
    result = run_trees(company, partner, options)
    assert len(plans) == 1 and "Join" not in plans[0]
    names = ["row_id", *[f"{f}_bin" for f in result.model.features]]
    assert sorted(spark.read.parquet(options.bins_to).select(names).collect()) == sorted(result.train.select(names).collect())
