"""Scalar functions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, scores
from ..operators import metrics
from .fixtures import joined, SQL_A, table
from .registry import query, rnd, sql_rnd

# A score and a 0/1 label per order, made of its columns.
_Z = "with t as (select o_orderkey as id, (o_totalprice - 150000.0E0) / 50000.0E0 as z, case when o_orderstatus = 'F' then 1.0E0 else 0.0E0 end as y from orders)"
_P = "(1.0E0 / (1.0E0 + exp(-z)))"
_Q = "greatest(0.0E0, least(1.0E0, z + 0.5E0))"


def _scored(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        ((F.col("o_totalprice") - 150000.0) / 50000.0).alias("z"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"),
    )


@query("sigmoid", f"{_Z} select id, {sql_rnd(_P)} as p, {sql_rnd(_P.replace('z', 'greatest(-500.0E0, least(500.0E0, 1000 * z))'))} as clipped from t")
def _(spark, sf):
    z = F.col("z")
    return _scored(spark, sf).select("id", rnd(scores.sigmoid(z)).alias("p"), rnd(scores.sigmoid(z * 1000, clip=500)).alias("clipped"))


@query("approx_sigmoid", f"{_Z} select id, {sql_rnd(_Q)} as p from t")
def _(spark, sf):
    return _scored(spark, sf).select("id", rnd(scores.approx_sigmoid(F.col("z"))).alias("p"))


_SOFT = """with e as (select vec_id as i, label, unnest(range(len(embedding))) as j, cast(unnest(embedding) as double) as v from embeddings),
x as (select i, label, j, exp(v) as w, sum(exp(v)) over (partition by i) as total from e)"""


@query("softmax", f"{_SOFT} select i, cast(j as integer) as j, {sql_rnd('w / total')} as p from x")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("z"))
    return e.select("i", F.posexplode(scores.softmax(F.col("z"))).alias("j", "p")).select("i", "j", rnd("p").alias("p"))


@query("grad_hess_logistic", f"{_Z} select id, {sql_rnd(f'{_P} - y')} as g, {sql_rnd(f'{_P} * (1 - {_P})')} as h from t")
def _(spark, sf):
    g, h = scores.grad_hess_logistic(F.col("y"), F.col("z"))
    return _scored(spark, sf).select("id", rnd(g).alias("g"), rnd(h).alias("h"))


@query("grad_hess_approx", f"{_Z} select id, {sql_rnd(f'{_Q} - y')} as g, {sql_rnd(f'{_Q} * (1 - {_Q})')} as h from t")
def _(spark, sf):
    g, h = scores.grad_hess_approx(F.col("y"), F.col("z"))
    return _scored(spark, sf).select("id", rnd(g).alias("g"), rnd(h).alias("h"))


@query(
    "grad_hess_softmax",
    f"""{_SOFT} select i, cast(j as integer) as j, {sql_rnd('w / total - case when j = label then 1 else 0 end')} as g,
    {sql_rnd('w / total * (1 - w / total)')} as h from x""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), "label", F.col("embedding").cast("array<double>").alias("z"))
    y = F.transform(F.sequence(F.lit(0), F.size("z") - 1), lambda j: (j == F.col("label")).cast("double"))
    g, h = scores.grad_hess_softmax(y, F.col("z"))
    cells = e.select("i", F.posexplode(F.arrays_zip(g.alias("g"), h.alias("h"))).alias("j", "c"))
    return cells.select("i", "j", rnd("c.g").alias("g"), rnd("c.h").alias("h"))


@query("grad_hess_mse", f"{_Z}, n as (select count(*) as n from t) select id, {sql_rnd('2 * (z - y) / n * 1000')} as g, {sql_rnd('2000.0E0 / n')} as h from t, n")
def _(spark, sf):
    df = _scored(spark, sf)
    g, h = scores.grad_hess_mse(F.col("y"), F.col("z"), df.count())
    return df.select("id", rnd(g * 1000).alias("g"), rnd(h * 1000).alias("h"))


@query(
    "to_int_labels",
    f"""{_Z} select id, (cast(round_even({_P}, 0) as double) + 0.0E0) as label from t""",
)
def _(spark, sf):
    return _scored(spark, sf).select("id", scores.to_int_labels(scores.sigmoid(F.col("z"))).alias("label"))


@query(
    "to_int_labels_several",
    """with e as (select vec_id as id, unnest(range(len(embedding))) as j, unnest(embedding) as v from embeddings),
    r as (select id, j, row_number() over (partition by id order by v desc, j) as k from e)
    select id, cast(j as integer) as label from r where k = 1""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), scores.to_int_labels(F.col("embedding"), several=True).alias("label"))


@query("sign_label", "select c_custkey as id, cast(sign(c_acctbal) as double) as label from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), scores.sign_label(F.col("c_acctbal")).alias("label"))


@query("key_to_token", "select doc_id, sha256(cast(doc_id as varchar)) as token from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", keys.key_to_token(F.col("doc_id"), 256).alias("token"))


@query(
    "random_key",
    """with d as (select o_orderkey as id, sha256('key|' || o_orderkey) as h from orders)
    select id, array_to_string(list_transform(range(20), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', cast(('0x' || substr(h, cast(3 * i + 1 as bigint), 3))::bigint % 36 + 1 as bigint), 1)), '') as key from d""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), keys.random_key("key", "o_orderkey").alias("key"))


# --- metrics -----------------------------------------------------------------------------------------


@query("cross_entropy_sum", f"{_Z} select {sql_rnd(f'-sum(y * ln({_P} + 1e-12))', 4)} as loss from t")
def _(spark, sf):
    p = scores.sigmoid(F.col("z"))
    return _scored(spark, sf).agg(rnd(metrics.cross_entropy_sum(F.col("y"), p), 4).alias("loss"))


@query("log_loss", f"{_Z} select {sql_rnd(f'-avg(y * ln({_P} + 1e-12) + (1 - y) * ln(1 - {_P} + 1e-12))')} as loss from t")
def _(spark, sf):
    p = scores.sigmoid(F.col("z"))
    return _scored(spark, sf).agg(rnd(metrics.log_loss(F.col("y"), p)).alias("loss"))


@query("mse", f"{_Z} select {sql_rnd('avg((y - z) * (y - z))')} as mse from t")
def _(spark, sf):
    return _scored(spark, sf).agg(rnd(metrics.mse(F.col("y"), F.col("z"))).alias("mse"))


@query("accuracy", f"{_Z} select {sql_rnd('avg(case when (z > 0) = (y = 1) then 1.0E0 else 0.0E0 end)')} as accuracy from t")
def _(spark, sf):
    label = scores.to_int_labels(scores.sigmoid(F.col("z")))
    return _scored(spark, sf).agg(rnd(metrics.accuracy(F.col("y"), label)).alias("accuracy"))


@query(
    "metric_max_so_far",
    f"""with {SQL_A}, a as (select 'month' as series, cast(c1 as integer) as step, {sql_rnd('avg(y)')} as accuracy from j group by c1)
    select series, step, accuracy, (select max(b.accuracy) from a b where b.step <= a.step) as best from a""",
)
def _(spark, sf):
    rate = joined(spark, sf).groupBy(F.lit("month").alias("series"), F.col("c1").cast("int").alias("step")).agg(rnd(F.avg("y")).alias("accuracy"))
    return metrics.metric_max_so_far(rate)
