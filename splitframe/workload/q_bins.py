"""Binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning as b
from .fixtures import SQL_A, company_a, partner_a, stored, table
from .registry import query, rnd


def edges_sql(source: str, columns: list[str], k: int) -> str:
    """(feature, edge_idx, edge) of a table's columns, by the engine's own percentile."""
    fractions = ", ".join(f"{(i + 1) / (k + 1)!r}E0" if "e" not in repr((i + 1) / (k + 1)) else repr((i + 1) / (k + 1)) for i in range(k))
    one = (
        "select '{c}' as feature, cast(unnest(range({k})) as integer) as edge_idx, unnest(q) as edge from "
        "(select list_transform(quantile_cont({c}, [{fr}]), lambda x: cast(round_even(x, 3) as double)) as q from {source})"
    )
    return " union all ".join(one.format(c=c, k=k, fr=fractions, source=source) for c in columns)


COMPANY_COLS, PARTNER_COLS = ["c0", "c1"], ["p0", "p1", "p2"]


def edges_a_sql(k: int) -> str:
    """Cut points of both parties' whole tables in fixture A, as CTE ``ed``."""
    return f"ed as ({edges_sql('co', COMPANY_COLS, k)} union all {edges_sql('pa', PARTNER_COLS, k)})"


def edges_a(spark, sf, k):
    company, partner = stored(spark, sf, "a")
    c = b.quantile_edges(company.df, COMPANY_COLS, k)
    return c.merge(b.quantile_edges(partner.df, PARTNER_COLS, k))


@query("quantile_edges", f"with {SQL_A}, {edges_a_sql(20)} select feature, edge_idx, edge from ed")
def _(spark, sf):
    return edges_a(spark, sf, 20).table(spark)


_PRICES = ["l_extendedprice", "l_quantity", "l_discount"]


@query("quantile_edges_lines", edges_sql("lineitem", _PRICES, 50))
def _(spark, sf):
    return b.quantile_edges(table(spark, sf, "lineitem"), _PRICES, 50).table(spark)


@query("quantile_edges_narrowed", edges_sql("lineitem", _PRICES, 50))
def _(spark, sf):
    # A coarse sketch and a small last step, so that stretches are sketched and counted again.
    found = b.exact_quantiles(table(spark, sf, "lineitem"), _PRICES, b.cut_probabilities(50), fetch_rows=500, sketch_k=64)
    return b.Edges({c: tuple(float(round(x, 3)) for x in v) for c, v in found.items()}).table(spark)


@query("quantile_edges_approx")
def _(spark, sf):
    return b.quantile_edges(table(spark, sf, "lineitem"), _PRICES, 20, method="approx").table(spark)


def _label_sql(x: str, feature: str, k: int) -> str:
    """First edge that is not below the value, else k."""
    return f"cast(coalesce((select min(edge_idx) from ed where feature = '{feature}' and {x} <= edge), {k}) as integer)"


@query(
    "bin_label",
    f"with {SQL_A}, {edges_a_sql(20)} select id, {', '.join(f'{_label_sql(c, c, 20)} as {c}_bin' for c in PARTNER_COLS)} from pa",
)
def _(spark, sf):
    df = stored(spark, sf, "a")[1].df
    return b.bin_label(df, b.quantile_edges(df, PARTNER_COLS, 20)).select("id", *[f"{c}_bin" for c in PARTNER_COLS])


@query(
    "bin_edge_join",
    f"""with {SQL_A}, {edges_a_sql(10)},
    ranges as (select feature, edge_idx as bin, lag(edge) over (partition by feature order by edge_idx) as lo, edge as hi from ed
               union all select feature, 10, max(edge), null from ed group by feature),
    x as (select id, 'c0' as feature, c0 as x from co union all select id, 'c1', c1 from co)
    select id, x.feature, x, cast(bin as integer) as bin, lo, hi from x join ranges r on x.feature = r.feature
      and (lo is null or x > lo) and (hi is null or x <= hi)""",
)
def _(spark, sf):
    df = company_a(spark, sf)
    out = b.bin_edge_join(df, "id", b.quantile_edges(df, COMPANY_COLS, 10))
    return out.withColumnsRenamed({"left": "lo", "right": "hi"})


_ED_LINES = f"ed as ({edges_sql('lineitem', ['l_discount', 'l_tax'], 20)})"


@query(
    "bin_compact_edges",
    f"""with {_ED_LINES},
    used as (select distinct 'l_discount' as feature, {_label_sql('l_discount', 'l_discount', 20)} as b from lineitem
             union all select distinct 'l_tax', {_label_sql('l_tax', 'l_tax', 20)} from lineitem)
    select ed.feature, edge, cast(row_number() over (partition by ed.feature order by edge_idx) - 1 as integer) as edge_idx
    from ed join used u on u.feature = ed.feature and u.b = edge_idx""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    return b.bin_compact_edges(lines, b.quantile_edges(lines, ["l_discount", "l_tax"], 20))


@query(
    "bin_members",
    f"""with {_ED_LINES},
    l as (select 'l_discount' as feature, {_label_sql('l_discount', 'l_discount', 20)} as bin from lineitem
          union all select 'l_tax', {_label_sql('l_tax', 'l_tax', 20)} from lineitem),
    top as (select feature, unnest(range(max(bin) + 1)) as bin from l group by feature)
    select top.feature, cast(top.bin as integer) as bin, count(l.bin) as n from top left join l on l.feature = top.feature and l.bin = top.bin
    group by 1, 2""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    edges = b.quantile_edges(lines, ["l_discount", "l_tax"], 20)
    out = b.bin_members(b.bin_label(lines, edges), edges.features)
    return out.select("feature", "bin", F.col("n").cast("bigint").alias("n"))


@query(
    "bin_before_join",
    f"""with {SQL_A}, {edges_a_sql(20)} select id, {', '.join(f'{_label_sql(c, c, 20)} as {c}_bin' for c in COMPANY_COLS + PARTNER_COLS)} from j""",
)
def _(spark, sf):
    out, _ = b.bin_before_join(company_a(spark, sf), partner_a(spark, sf), COMPANY_COLS, PARTNER_COLS, 20)
    return out.select("id", *[f"{c}_bin" for c in COMPANY_COLS + PARTNER_COLS])
