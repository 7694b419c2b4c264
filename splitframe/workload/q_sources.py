"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scores import to_int_labels
from ..operators.align import psi_join
from ..operators.binning import bin_label, quantile_edges
from ..operators.shares import psi_shares, share_reconstruct
from ..plans.boosting import gbt_fit
from ..plans.linear import lr_fit
from ..session import materialise, shared_dir
from ..sources import (
    load_linear,
    load_trees,
    save_linear,
    save_trees,
    scan_aligned_pair,
    scan_bins,
    scan_dense_matrix,
    scan_party_csv,
    scan_party_parquet,
    scan_shares,
    sink_bins,
    sink_shares,
)
from .fixtures import FEATURES_A, SQL_A, SQL_B, company_a, joined, parties, partner_a, scaled_a, table
from .q_linear import LR_TWO_STEPS
from .registry import query, rnd, rounded, sql_rnd


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


@query("scan_party_parquet", "select cast(doc_id as varchar) as doc_id, cast(quality as double) as quality, cast(toxic as double) as toxic from labels")
def _(spark, sf):
    return scan_party_parquet(spark, f"{sf}/labels.parquet", "doc_id").df


@query("scan_party_csv", "select cast(doc_id as varchar) as doc_id, cast(quality as double) as y, cast(toxic as double) as x0 from labels")
def _(spark, sf):
    path = _folder(spark)
    named = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("x0"))
    named.write.option("header", True).csv(path)
    return scan_party_csv(spark, path).df


@query("scan_aligned_pair", f"with {SQL_B} select cast(id as varchar) as id, c0, c1, p0, y, 'partner' as holder from j")
def _(spark, sf):
    company, partner = parties(spark, sf, "b")
    pair, _, _, holder = scan_aligned_pair(company, partner)
    return pair.withColumns({"id": F.col("id").cast("string"), "holder": F.lit(holder)})


@query(
    "scan_dense_matrix",
    f"""with t as (select row_number() over (order by vec_id) - 1 as row, embedding, label from embeddings)
    select row, cast(len(embedding) as integer) as width, {sql_rnd("list_sum(list_transform(embedding, lambda v: cast(v as double)))")} as total,
           cast(label as double) as y from t""",
)
def _(spark, sf):
    path = _folder(spark)
    e = table(spark, sf, "embeddings").orderBy("vec_id")
    text = F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), "  ")
    e.select(text).write.text(f"{path}/matrix")
    e.select(F.col("label").cast("string")).write.text(f"{path}/labels")
    m = scan_dense_matrix(spark, f"{path}/matrix", f"{path}/labels")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return m.select("row", F.size("x").alias("width"), rnd(total).alias("total"), "y")


def _round_trip(spark, sf, format):
    path = _folder(spark)
    ours, theirs = psi_shares(company_a(spark, sf), partner_a(spark, sf), seed=11, unique_ids=True)
    sink_shares(ours, theirs, f"{path}/company", f"{path}/partner", format)
    ours, theirs = scan_shares(spark, f"{path}/company", f"{path}/partner", format)
    return rounded(share_reconstruct(ours, theirs), [], [*FEATURES_A, "y"])


_PLAIN_A = f"with {SQL_A} select {', '.join(f'{sql_rnd(c)} as {c}' for c in [*FEATURES_A, 'y'])} from j"


@query("sink_shares", _PLAIN_A)
def _(spark, sf):
    return _round_trip(spark, sf, "parquet")


@query("scan_shares", _PLAIN_A)
def _(spark, sf):
    return _round_trip(spark, sf, "csv")


@query(
    "sink_scan_bins",
    """with q as (select unnest(quantile_cont(l_quantity, [1/5.0, 2/5.0, 3/5.0, 4/5.0])) as e, unnest([0, 1, 2, 3]) as k from lineitem),
    r as (select l_quantity as x from lineitem)
    select 'l_quantity' as feature, cast((select count(*) from q where round_even(q.e, 3) < r.x) as integer) as bin, count(*) as n
    from r group by 2""",
)
def _(spark, sf):
    path = _folder(spark)
    lines = table(spark, sf, "lineitem")
    edges = quantile_edges(lines, ["l_quantity"], 4)
    sink_bins(bin_label(lines, edges), "l_orderkey", ["l_quantity"], path)
    return scan_bins(spark, path, "l_orderkey", ["l_quantity"]).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("sink_scan_linear_model", LR_TWO_STEPS)
def _(spark, sf):
    path = _folder(spark)
    model = lr_fit(scaled_a(spark, sf), FEATURES_A, n_epochs=2, split_col=2)
    paths = {"company": f"{path}/company", "partner": f"{path}/partner"}
    save_linear(spark, model, paths, "csv")
    return load_linear(spark, paths).weight_table(spark).select("feature", rnd("weight").alias("weight"))


@query("sink_scan_tree_model", f"with {SQL_A} select count(*) as n, count(*) as equal_labels, count(*) as equal_scores from j")
def _(spark, sf):
    path = _folder(spark)
    data = materialise(joined(spark, sf), "joined")
    edges = quantile_edges(data, FEATURES_A, 10)
    model = gbt_fit(bin_label(data, edges), FEATURES_A, edges, n_estimators=2, max_depth=2)
    paths = {"company": f"{path}/company", "partner": f"{path}/partner"}
    save_trees(spark, model, ["c0", "c1"], paths, seed=5)
    again = load_trees(spark, paths)
    both = again.score(model.score(data, out="s0"), out="s1")
    label = lambda s: to_int_labels(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(s))))
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label("s0") == label("s1")).alias("equal_labels"),
        F.count_if(F.abs(F.col("s0") - F.col("s1")) < 1e-9).alias("equal_scores"),
    )


@query("scan_csv_join", f"with {SQL_A} select cast(id as varchar) as id, c0, c1, p0, p1, p2, y from j")
def _(spark, sf):
    path = _folder(spark)
    company_a(spark, sf).write.option("header", True).csv(f"{path}/company")
    partner_a(spark, sf).write.option("header", True).csv(f"{path}/partner")
    company, partner = (scan_party_csv(spark, f"{path}/{p}", "id") for p in ("company", "partner"))
    return psi_join(company.table(), partner.table())
