"""Additive shares of a table: two tables whose cells add up to the value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import share_mask
from ..session import materialise
from .align import psi_row_index
from .prep import merged_columns

ROW_ID = "row_id"


def share_split(df: DataFrame, columns: list[str], seed: str | int, row_id: str = ROW_ID) -> tuple[DataFrame, DataFrame]:
    """``x`` as an integer mask in ``[-32768, 32768)`` and ``x - mask``.

    The mask is a keyed hash of (seed, row id, column), so both tables can be computed
    separately, or again after a failure, and still add up.
    """
    first = df.select(row_id, *[share_mask(seed, row_id, c).cast("double").alias(c) for c in columns])
    second = df.select(row_id, *[(F.col(c) - share_mask(seed, row_id, c)).alias(c) for c in columns])
    return first, second


def psi_shares(
    company: DataFrame,
    partner: DataFrame,
    seed: str | int,
    on: str = "id",
    unique_ids: bool = False,
    public: tuple[str, ...] = (),
    skew: str = "aqe",
    write: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Aligned features as two share tables, company's and partner's, with a common row id.

    Company's columns: company keeps ``c - r``, partner gets ``r``. Partner's columns the
    other way round. Ids are dropped; ``public`` columns go to both tables as they are. With
    ``write`` the masked join is written once, so the two tables do not both run the join.
    """
    merged = merged_columns(company.columns, partner.columns, on)
    names = [out for _, _, out in merged if out not in public]
    own = {out for party, _, out in merged if party == "company"}
    indexed = psi_row_index(company, partner, seed, on, unique_ids, skew)
    mask = {n: share_mask(seed, ROW_ID, n) for n in names}
    held = [(F.col(n) - mask[n] if n in own else mask[n].cast("double")).alias(f"company_{n}") for n in names]
    given = [(mask[n].cast("double") if n in own else F.col(n) - mask[n]).alias(f"partner_{n}") for n in names]
    both = indexed.select(ROW_ID, *public, *held, *given)
    if write:
        both = materialise(both, "shares")
    side = lambda party: both.select(ROW_ID, *public, *[F.col(f"{party}_{n}").alias(n) for n in names])
    return side("company"), side("partner")


def share_reconstruct(
    first: DataFrame, second: DataFrame, columns: list[str] | None = None, row_id: str = ROW_ID, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Add two share tables row by row; public columns to ``keep`` are taken from the first."""
    return share_add(first, second, columns, row_id, keep)


def share_add(
    a: DataFrame, b: DataFrame, columns: list[str] | None = None, row_id: str = ROW_ID, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Add two tables of one party's shares (row ids are unique, so no key is hot)."""
    columns = columns or [c for c in a.columns if c != row_id and c not in keep]
    joined = a.alias("a").join(b.select(row_id, *columns).alias("b"), row_id)
    return joined.select(row_id, *[f"a.{c}" for c in keep], *[(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in columns])


def share_sub(a: DataFrame, b: DataFrame, columns: list[str] | None = None, row_id: str = ROW_ID) -> DataFrame:
    columns = columns or [c for c in a.columns if c != row_id]
    return share_add(a, share_scale(b, columns, -1.0, row_id), columns, row_id)


def share_scale(share: DataFrame, columns: list[str], factor: float, row_id: str = ROW_ID) -> DataFrame:
    """Multiply by a constant: each party scales its own share."""
    return share.select(row_id, *[(F.col(c) * F.lit(float(factor))).alias(c) for c in columns])


def share_shift(share: DataFrame, columns: list[str], constant: float, row_id: str = ROW_ID) -> DataFrame:
    """Add a constant: to be done by one of the parties only."""
    return share.select(row_id, *[(F.col(c) + F.lit(float(constant))).alias(c) for c in columns])


def share_group_sum(
    first: DataFrame, second: DataFrame, groups: DataFrame, by: list[str], columns: list[str], row_id: str = ROW_ID
) -> DataFrame:
    """Group totals from shares: each share is summed alone, only totals are added.

    ``groups`` gives the public group columns per row id. Sums are combined before the
    shuffle, so a hot group costs no more than others.
    """
    keyed = groups.select(row_id, *by)

    def totals(share: DataFrame, tag: str) -> DataFrame:
        sums = [F.sum(c).alias(f"{tag}_{c}") for c in columns]
        return share.select(row_id, *columns).join(keyed, row_id).groupBy(*by).agg(*sums)

    joined = totals(first, "a").join(totals(second, "b"), by)
    return joined.select(*by, *[(F.col(f"a_{c}") + F.col(f"b_{c}")).alias(c) for c in columns])
