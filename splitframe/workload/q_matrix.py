"""Matrix operators on the embeddings as coordinate cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix as m
from .fixtures import SQL_E, cells, table, wide_e
from .registry import query, rnd, sql_rnd

_V = f"with {SQL_E}"


def _out(df, digits=6):
    return df.select("i", "j", rnd("v", digits).alias("v"))


def _square(spark, sf):
    """Second operand of the same shape: v * v."""
    return cells(spark, sf).select("i", "j", (F.col("v") * F.col("v")).alias("v"))


@query("mat_add", f"{_V} select i, j, {sql_rnd('v + v * v')} as v from e")
def _(spark, sf):
    return _out(m.mat_add(cells(spark, sf), _square(spark, sf)))


@query("mat_sub", f"{_V} select i, j, {sql_rnd('v - v * v - 1.5E0')} as v from e")
def _(spark, sf):
    return _out(m.mat_sub(m.mat_sub(cells(spark, sf), _square(spark, sf)), 1.5))


@query("mat_scale", f"{_V} select i, j, {sql_rnd('v * 2.5E0')} as v from e")
def _(spark, sf):
    return _out(m.mat_scale(cells(spark, sf), 2.5))


@query("mat_hadamard", f"{_V} select i, j, {sql_rnd('v * v * v')} as v from e")
def _(spark, sf):
    return _out(m.mat_hadamard(cells(spark, sf), _square(spark, sf)))


_GRAM = f"{_V} select a.j as i, b.j as j, {sql_rnd('sum(a.v * b.v)', 5)} as v from e a join e b on a.i = b.i group by 1, 2"


@query(
    "mat_mul",
    f"""{_V}, w as (select distinct n_nationkey as r, n_nationkey * 0.25E0 - n_regionkey as w, n_regionkey as c from nation)
    select i, cast(c as bigint) as j, {sql_rnd('sum(v * w)', 5)} as v from e join w on e.j = w.r group by 1, 2""",
)
def _(spark, sf):
    w = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("i"),
        F.col("n_regionkey").cast("bigint").alias("j"),
        (F.col("n_nationkey") * 0.25 - F.col("n_regionkey")).alias("v"),
    )
    return _out(m.mat_mul(cells(spark, sf), w), 5)


@query("mat_mul_blocks", _GRAM)
def _(spark, sf):
    e = cells(spark, sf)
    return _out(m.mat_mul(m.mat_transpose(e), e, block=64, small_cells=0), 5)


@query("mat_gram", _GRAM)
def _(spark, sf):
    names = [f"x{j}" for j in range(64)]
    return _out(m.gram(wide_e(spark, sf), names, names), 5)


@query("mat_transpose", f"{_V} select j as i, i as j, v from e")
def _(spark, sf):
    return m.mat_transpose(cells(spark, sf))


@query("mat_fmod", f"{_V} select i, j, {sql_rnd('(v * 100) % 3')} as v from e")
def _(spark, sf):
    return _out(m.mat_fmod(m.mat_scale(cells(spark, sf), 100.0), 3))


@query(
    "mat_compare",
    " union all ".join(
        f"select * from ({_V} select '{op}' as op, '{with_}' as operand, i, j, cast(v {op} {x} as integer) as v from e)"
        for op in ("<", ">", "<=", ">=")
        for with_, x in (("matrix", "v * v"), ("number", "0.1E0"))
    ),
)
def _(spark, sf):
    e, sq = cells(spark, sf), _square(spark, sf)
    out = None
    for op in ("<", ">", "<=", ">="):
        for operand, x in (("matrix", sq), ("number", 0.1)):
            one = m.mat_compare(e, op, x).select(F.lit(op).alias("op"), F.lit(operand).alias("operand"), "i", "j", "v")
            out = one if out is None else out.unionByName(one)
    return out


@query("mat_slice", f"{_V} select i, j, v from e where i >= 10 and i < 200 and j in (0, 5, 63)")
def _(spark, sf):
    return m.mat_slice(cells(spark, sf), slice(10, 200), [0, 5, 63])


@query("mat_assign", f"{_V} select i, j, case when i < 100 and j >= 60 then v * v when j in (1, 2) then 7.0E0 else v end as v from e")
def _(spark, sf):
    filled = m.mat_assign(cells(spark, sf), 7.0, columns=[1, 2])
    return m.mat_assign(filled, _square(spark, sf), slice(0, 100), slice(60, None))


@query("mat_like", f"{_V} select i, j, 0.0E0 as zero, 1.0E0 as one from e")
def _(spark, sf):
    e = cells(spark, sf)
    return m.mat_like(e, 0).withColumnRenamed("v", "zero").withColumn("one", F.lit(1.0))


@query(
    "mat_random_like",
    f"{_V} select i, j, (('0x' || substr(sha256(concat_ws('|', 'noise', i, j)), 1, 8))::bigint % 20) - 5 as v from e",
)
def _(spark, sf):
    return m.mat_random_like(cells(spark, sf), -5, 15, "noise")


# Sparse cells with a shape: numbers meet the absent cells as zeros.
_SPARSE = f"""{_V}, g as (select unnest(range((select max(i) + 1 from e))) as i), h as (select unnest(range(64)) as j),
s as (select g.i, h.j, coalesce(e.v, 0) as v from g cross join h left join e on e.i = g.i and e.j = h.j and e.v > 0.05E0)"""


def _sparse(spark, sf):
    """Cells above 0.05, and the shape of the whole."""
    rows = table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return cells(spark, sf).where("v > 0.05"), (rows, 64)


@query("mat_add_sparse", f"{_SPARSE} select i, j, {sql_rnd('v - 0.75E0')} as v from s")
def _(spark, sf):
    a, shape = _sparse(spark, sf)
    return _out(m.mat_sub(a, 0.75, shape))


@query("mat_compare_sparse", f"{_SPARSE} select i, j, cast(v <= 0.06E0 as integer) as v from s")
def _(spark, sf):
    a, shape = _sparse(spark, sf)
    return m.mat_compare(a, "<=", 0.06, shape)


@query(
    "mat_assign_sparse",
    f"""{_SPARSE} select i, j, {sql_rnd('case when i >= 3 and j in (1, 5, 60) then -1.0E0 else v end')} as v from s
    where v > 0.05E0 or (i >= 3 and j in (1, 5, 60))""",
)
def _(spark, sf):
    a, shape = _sparse(spark, sf)
    return _out(m.mat_assign(a, -1.0, slice(3, None), [1, 5, 60], shape))
