"""Projections, splits, label coding, batches, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep
from ..operators.position import concat_by_position, global_position
from .fixtures import SQL_A, SQL_B, SQL_C, company_a, company_b, company_c, joined, parties, partner_b, partner_c, table
from .registry import query

_SIDES = " union all ".join(
    f"select '{n}' as fixture, '{holder}' as holder, count(*) as labelled from (with {sql} select y from {t}) where y is not null"
    for n, holder, t, sql in (("a", "partner", "pa", SQL_A), ("b", "partner", "pa", SQL_B), ("c", "company", "co", SQL_C))
)


@query("find_label_party", _SIDES)
def _(spark, sf):
    out = []
    for name in ("a", "b", "c"):
        company, partner = parties(spark, sf, name)
        holder = prep.find_label_party(company.df, partner.df)
        held = (company if holder == "company" else partner).df.where(F.col("y").isNotNull())
        out.append(held.agg(F.lit(name).alias("fixture"), F.lit(holder).alias("holder"), F.count(F.lit(1)).alias("labelled")))
    return prep.stack_rows(*out)


@query("split_x_y", f"with {SQL_B} select id, 'x' as part, c0 as v from j union all select id, 'y' as part, y as v from j")
def _(spark, sf):
    x, y = prep.split_x_y(joined(spark, sf, "b"), keep=["id"])
    return x.select("id", F.lit("x").alias("part"), F.col("c0").alias("v")).unionByName(
        y.select("id", F.lit("y").alias("part"), F.col("y").alias("v"))
    )


@query("merge_headers", f"with {SQL_C} select c0, c1, y, p0, p1, cast(2 as bigint) as y_index from j")
def _(spark, sf):
    company, partner = company_c(spark, sf), partner_c(spark, sf)
    names, y_index = prep.merge_headers(company, partner)
    return company.join(partner, "id").select(*names, F.lit(y_index).cast("bigint").alias("y_index"))


@query("vertical_split", f"with {SQL_B} select id, 'company' as side, c0 as a, c1 as b from j union all select id, 'partner', p0, y from j")
def _(spark, sf):
    left, right = prep.vertical_split(joined(spark, sf, "b"), "id", ["c0", "c1", "p0", "y"], 2)
    return left.select("id", F.lit("company").alias("side"), F.col("c0").alias("a"), F.col("c1").alias("b")).unionByName(
        right.select("id", F.lit("partner").alias("side"), F.col("p0").alias("a"), F.col("y").alias("b"))
    )


@query(
    "ordered_train_test_split",
    """with t as (select o_orderkey as id, row_number() over (order by o_orderkey) - 1 as pos, count(*) over () as n from orders)
    select id, case when pos < floor(0.75 * n) then 'train' else 'test' end as part from t""",
)
def _(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    train, test = prep.ordered_train_test_split(ids, "id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "hashed_train_test_split",
    """select o_orderkey as id, case when ('0x' || substr(sha256(concat_ws('|', 'split', o_orderkey)), 1, 8))::bigint < 1073741824
    then 'test' else 'train' end as part from orders""",
)
def _(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    train, test = prep.hashed_train_test_split(ids, "id", "split")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("recode_label_pm1", f"with {SQL_C} select id, case when y = 0 then -1.0E0 else y end as y from co")
def _(spark, sf):
    return company_c(spark, sf).select("id", prep.recode_label_pm1(F.col("y")).alias("y"))


@query(
    "recode_label_01",
    "select c_custkey as id, case sign(c_acctbal) when -1 then 0.0E0 else cast(sign(c_acctbal) as double) end as y from customer",
)
def _(spark, sf):
    signs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.signum("c_acctbal").alias("y"))
    return signs.select("id", prep.recode_label_01(F.col("y")).alias("y"))


@query(
    "one_hot_label",
    """with c as (select label as cls, row_number() over (order by label) - 1 as pos from (select distinct label from embeddings))
    select vec_id as id, cast(pos as integer) as pos, case when label = cls then 1.0E0 else 0.0E0 end as v from embeddings, c""",
)
def _(spark, sf):
    coded = prep.one_hot_label(table(spark, sf, "embeddings").select("vec_id", "label"), "label")
    return coded.select(F.col("vec_id").alias("id"), F.posexplode("y_vec").alias("pos", "v"))


@query("project_label_columns", f"with {SQL_B} select c0, c1, p0 from j")
def _(spark, sf):
    return prep.project_label_columns(joined(spark, sf, "b"))


@query(
    "batch_assign",
    """with t as (select o_orderkey as id, (row_number() over (order by o_orderkey) - 1) // 1024 as batch from orders)
    select batch, count(*) as n, min(id) as first_id, max(id) as last_id from t group by batch""",
)
def _(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    cut = prep.batch_assign(ids, "id", batch_size=1024)
    return cut.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(
    "sample_batch",
    "select o_orderkey as id, o_totalprice as v from orders order by sha256(concat_ws('|', 'draw', 3, o_orderkey)), o_orderkey limit 64",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return prep.sample_batch(rows, "id", "draw", 3)


@query(
    "party_sample",
    " union all ".join(
        f"select '{p}' as party, {k} as id from {t} where ('0x' || substr(sha256(concat_ws('|', 'keep', '{p}', {k})), 1, 8))::bigint < 3865470566"
        for p, k, t in (("company", "o_orderkey", "orders"), ("partner", "c_custkey", "customer"))
    ),
)
def _(spark, sf):
    out = []
    for party, key, name in (("company", "o_orderkey", "orders"), ("partner", "c_custkey", "customer")):
        ids = table(spark, sf, name).select(F.lit(party).alias("party"), F.col(key).alias("id"))
        out.append(prep.party_sample(ids, "id", "keep", party))
    return prep.stack_rows(*out)


@query("random_reorder", f"with {SQL_A} select id, c0, c1 from co")
def _(spark, sf):
    return prep.random_reorder(company_a(spark, sf), "mix", "id")


@query(
    "random_reorder_positions",
    "select o_orderkey as id, row_number() over (order by sha256(concat_ws('|', 'mix', o_orderkey)), o_orderkey) - 1 as pos from orders",
)
def _(spark, sf):
    from ..functions.keys import keyed_digest

    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return global_position(ids.withColumn("_d", keyed_digest("mix", "id")), "_d", "id").select("id", "pos")


@query("global_position", "select o_orderkey as id, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos from orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return global_position(rows, "o_orderdate", "id").select("id", "pos")


@query(
    "concat_by_position",
    """with a as (select doc_id, n_chars, row_number() over (order by doc_id) - 1 as pos from documents),
    b as (select doc_id as labelled, quality, row_number() over (order by doc_id) - 1 as pos from labels)
    select pos, doc_id, n_chars, labelled, quality from a join b using (pos)""",
)
def _(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", "n_chars")
    right = table(spark, sf, "labels").select(F.col("doc_id").alias("labelled"), "quality")
    return concat_by_position(left, right, ["doc_id"], ["labelled"])


@query("stack_rows", f"with {SQL_B} select id, c0 as v from co union all select id, p0 as v from pa")
def _(spark, sf):
    return prep.stack_rows(
        company_b(spark, sf).select("id", F.col("c0").alias("v")), partner_b(spark, sf).select("id", F.col("p0").alias("v"))
    )


@query("party_apply", f"with {SQL_A} select id, 2 * c0 as doubled, c1 + 1 as moved, c1 as pandas_c1 from co")
def _(spark, sf):
    company = company_a(spark, sf)
    doubled, moved = prep.party_apply(
        company,
        lambda df: (df.select("id", (F.col("c0") * 2).alias("doubled")), df.select("id", (F.col("c1") + 1).alias("moved"))),
        num_returns=2,
    )
    batched = prep.party_apply(company, lambda b: b[["id"]].assign(pandas_c1=b["c1"]), "id bigint, pandas_c1 double")
    return doubled.join(moved, "id").join(batched, "id")


# A class for every order line: places come by a join, the vector stays sparse.
@query(
    "one_hot_label_many",
    """with t as (select l_orderkey * 10 + l_linenumber as y from lineitem), c as (select count(distinct y) as size from t)
    select y, size, dense_rank() over (order by y) - 1 as place from t, c""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("y"))
    return prep.one_hot_label(rows, "y", sparse=True).select("y", "y_vec.size", F.col("y_vec.at").alias("place"))


@query("sample_batch_half", "select o_orderkey as id from orders order by sha256(concat_ws('|', 'draw', 1, o_orderkey)), o_orderkey limit (select count(*) // 2 from orders)")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return prep.sample_batch(rows, "id", "draw", 1, rows.count() // 2, top_rows=0)
