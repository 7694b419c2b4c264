"""Joins on ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align
from ..operators.binning import bin_label, quantile_edges
from .fixtures import SQL_A, SQL_B, SQL_F, company_a, company_b, company_f, partner_a, partner_b, partner_f
from .registry import query

COMPANY_SECRET = 0x5A17C0DE1234567890ABCDEF5A17C0DE1234567890ABCDEF5A17C0DE12345679
PARTNER_SECRET = 0x3B9ACA07FEDCBA09876543213B9ACA07FEDCBA09876543213B9ACA07FEDCBA09


@query("psi_join", f"with {SQL_A} select id, c0, c1, p0, p1, p2, y from j")
def _(spark, sf):
    return align.psi_join(company_a(spark, sf), partner_a(spark, sf))


@query("psi_join_texts", f"with {SQL_B} select id, c0, c1, p0, y from j")
def _(spark, sf):
    return align.psi_join(company_b(spark, sf), partner_b(spark, sf))


@query("psi_join_duplicates", f"with {SQL_F} select id, c0, p0 from j")
def _(spark, sf):
    return align.psi_join(company_f(spark, sf), partner_f(spark, sf))


@query(
    "psi_join_salted",
    """with co as (select l_suppkey as id, l_orderkey as o, l_linenumber as l, l_quantity as q from lineitem),
    pa as (select s_suppkey as id, s_acctbal as b from supplier) select co.id, o, l, q, b from co join pa on co.id = pa.id""",
)
def _(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("q")
    )
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("b"))
    return align.psi_join(lines, suppliers, skew="salt", salts=8)


@query("psi_cardinality", f"with {SQL_F} select count(*) as n from j")
def _(spark, sf):
    return align.psi_cardinality(company_f(spark, sf), partner_f(spark, sf))


@query("key_intersection", f"with {SQL_F} select id from co intersect select id from pa")
def _(spark, sf):
    return align.key_intersection(company_f(spark, sf), partner_f(spark, sf))


@query("psi_blinded_join", f"with {SQL_A} select c0, c1, p0, p1, p2, y from j")
def _(spark, sf):
    return align.psi_blinded_join(company_a(spark, sf), partner_a(spark, sf), "company salt", "partner salt")


@query("psi_blinded_join_two_party", f"with {SQL_B} select c0, c1, p0, y from j")
def _(spark, sf):
    return align.psi_blinded_join(company_b(spark, sf), partner_b(spark, sf), COMPANY_SECRET, PARTNER_SECRET, mode="two_party")


@query(
    "psi_public_columns",
    """with ca as (select median(o_totalprice) as m from orders), g as (select l_orderkey, sum(l_quantity) as q from lineitem group by 1),
    pa as (select median(q) as m from g)
    select o_orderkey as id, cast(case when o_totalprice <= round_even(ca.m, 3) then 0 else 1 end as integer) as c0_bin,
           cast(case when q <= round_even(pa.m, 3) then 0 else 1 end as integer) as p0_bin
    from orders join g on o_orderkey = l_orderkey, ca, pa""",
)
def _(spark, sf):
    company, partner = company_a(spark, sf), partner_a(spark, sf)
    c = bin_label(company, quantile_edges(company, ["c0"], 1))
    p = bin_label(partner, quantile_edges(partner, ["p0"], 1))
    return align.psi_public_columns(c, p, ["c0_bin"], ["p0_bin"])


@query("psi_row_index", f"with {SQL_A} select sha256('row|' || id) as row_id, id, c0, c1, p0, p1, p2, y from j")
def _(spark, sf):
    return align.psi_row_index(company_a(spark, sf), partner_a(spark, sf), "row", unique_ids=True)


@query("psi_row_index_duplicates", f"with {SQL_F} select id, count(*) as n, count(*) as row_ids, sum(c0) as c0 from j group by id")
def _(spark, sf):
    company, partner = company_f(spark, sf), partner_f(spark, sf)
    rows = align.psi_row_index(company, partner, "row", tasks=align.tasks_for(company, partner))
    return rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("row_ids"), F.sum("c0").alias("c0")
    )


@query(
    "dense_row_index",
    f"with {SQL_B} select id, row_number() over (order by sha256('row|' || id)) - 1 as pos from j",
)
def _(spark, sf):
    rows = align.psi_row_index(company_b(spark, sf), partner_b(spark, sf), "row", unique_ids=True)
    return align.dense_row_index(rows).select("id", "pos")
