"""Additive shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shares
from ..plans.linear import lr_fit
from ..session import materialise
from .fixtures import FEATURES_A, SQL_A, company_a, joined, partner_a, scaled_a, table
from .q_linear import lr_steps_sql
from .registry import query, rnd, rounded, sql_rnd


def _mask(row: str, column: str, seed: str = "7") -> str:
    return f"((('0x' || substr(sha256(concat_ws('|', '{seed}', {row}, '{column}')), 1, 8))::bigint % 65536) - 32768)"


@query(
    "share_split",
    f"""select o_orderkey as row_id, cast({_mask('o_orderkey', 'v')} as double) as first_share,
    {sql_rnd(f"o_totalprice - {_mask('o_orderkey', 'v')}")} as second_share from orders""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("v"))
    first, second = shares.share_split(rows, ["v"], seed=7)
    return first.withColumnRenamed("v", "first_share").join(second.select("row_id", rnd("v").alias("second_share")), "row_id")


_COLS = [*FEATURES_A, "y"]


@query(
    "psi_shares",
    f"""with {SQL_A}, r as (select *, sha256('7|' || id) as row_id from j)
    select row_id, {', '.join(f"{sql_rnd(f'{c} - ' + _mask('row_id', c))} as company_{c}" if c.startswith('c') else f"cast({_mask('row_id', c)} as double) as company_{c}" for c in _COLS)},
           {', '.join(f"cast({_mask('row_id', c)} as double) as partner_{c}" if c.startswith('c') else f"{sql_rnd(f'{c} - ' + _mask('row_id', c))} as partner_{c}" for c in _COLS)}
    from r""",
)
def _(spark, sf):
    ours, theirs = shares.psi_shares(company_a(spark, sf), partner_a(spark, sf), seed=7, unique_ids=True)
    ours = ours.select("row_id", *[rnd(c).alias(f"company_{c}") for c in _COLS])
    theirs = theirs.select("row_id", *[rnd(c).alias(f"partner_{c}") for c in _COLS])
    return ours.join(theirs, "row_id")


@query("share_reconstruct", f"with {SQL_A} select {', '.join(f'{sql_rnd(c)} as {c}' for c in _COLS)} from j")
def _(spark, sf):
    # No promise of unique ids here: rows get their ids from content and copy number.
    ours, theirs = shares.psi_shares(company_a(spark, sf), partner_a(spark, sf), seed=8)
    return rounded(shares.share_reconstruct(ours, theirs), [], _COLS)


@query(
    "share_linear",
    f"""with {SQL_A} select {sql_rnd('2 * c0 + p0 - 3 * p2 + 10')} as v from j""",
)
def _(spark, sf):
    ours, theirs = shares.psi_shares(company_a(spark, sf), partner_a(spark, sf), seed=9, unique_ids=True)

    def own(s, constant):
        """What one party does with its share alone."""
        one = lambda c: s.select("row_id", F.col(c).alias("v"))
        v = shares.share_add(shares.share_scale(one("c0"), ["v"], 2.0), one("p0"))
        v = shares.share_sub(v, shares.share_scale(one("p2"), ["v"], 3.0))
        return shares.share_shift(v, ["v"], constant)

    return rounded(shares.share_reconstruct(own(ours, 10.0), own(theirs, 0.0)), [], ["v"])


@query("share_group_sum", f"with {SQL_A} select c1 as month, {sql_rnd('sum(c0)', 4)} as c0, {sql_rnd('sum(p0)', 4)} as p0 from j group by c1")
def _(spark, sf):
    rows = materialise(joined(spark, sf).select(F.col("id").alias("row_id"), "c0", "p0", F.col("c1").alias("month")), "rows")
    first, second = shares.share_split(rows, ["c0", "p0"], seed=10)
    return rounded(shares.share_group_sum(first, second, rows, ["month"], ["c0", "p0"]), ["month"], ["c0", "p0"], 4)


@query("share_labels", lr_steps_sql(2, 0.1, "greatest(0.0E0, least(1.0E0, {z} + 0.5E0))"))
def _(spark, sf):
    model = lr_fit(scaled_a(spark, sf), FEATURES_A, n_epochs=2, share_y=True)
    return model.weight_table(spark).select("feature", rnd("weight").alias("weight"))
