"""Alignment of two parties' tables on an identifier."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..spec import COMPANY
from .curve import PRIME, TOKEN_BYTES, multiples, usable
from .position import global_position
from .prep import merged_columns

# Fixed value: the most items that Spark's frequent-items sketch tracks.
TRACKED_MOST = 1_000_000
COPY_CHUNK = 1_000_000
# Rows of both sides that a task joins where the aligned rows are grouped by id: about 0.4 GB of row ids.
ROWS_A_TASK = 500_000


# --- joins ---------------------------------------------------------------------------------


def hot_keys(df: DataFrame, id: str, share: float = 0.001) -> list:
    """Keys that hold more than ``share`` of the rows, so at most 1 / share of them.

    One pass with a mergeable frequent-items sketch; nothing is shuffled by key. The result
    only steers how rows are spread, so its being approximate never changes a join's rows.
    """
    kept = df.where(F.col(id).isNotNull())
    most = int(1 / share) + 1
    if 10 * most > TRACKED_MOST:
        raise ValueError(f"share must be at least {10 / TRACKED_MOST:g}")
    found = kept.agg(
        F.expr(f"approx_top_k(`{id}`, {most}, {10 * most})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [t["item"] for t in (found["top"] or []) if t["count"] > share * found["n"]]


def _spread(df: DataFrame, id: str, own: list, other: list, salts: int, own_salt: str, other_salt: str) -> DataFrame:
    """Give rows of own hot keys one salt; repeat rows of the other side's hot keys for each."""
    # A task's retry sees the same partition number, so the salt is stable; and it differs
    # between map partitions, so even identical rows are spread.
    pick = F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.lit(salts)).cast("int")
    one = F.when(F.col(id).isin(own), pick).otherwise(F.lit(0)) if own else F.lit(0)
    out = df.withColumn(own_salt, one)
    if not other:
        return out.withColumn(other_salt, F.lit(0))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return out.withColumn(other_salt, F.explode(F.when(F.col(id).isin(other), every).otherwise(F.array(F.lit(0)))))


def equi_join(left: DataFrame, right: DataFrame, on: str, skew: str = "aqe", salts: int = 64, share: float = 0.001) -> DataFrame:
    """Inner join on one key.

    ``skew="aqe"`` leaves splitting of hot partitions to adaptive execution. ``"salt"`` looks
    for hot keys first and splits each over ``salts`` partitions, repeating only the matching
    rows of the other side; use it where the plan around the join keeps AQE from splitting.
    """
    if skew == "aqe":
        return left.join(right, on, "inner")
    if skew != "salt":
        raise ValueError(f"unknown skew mode {skew!r}")
    hot_l, hot_r = hot_keys(left, on, share), hot_keys(right, on, share)
    if not hot_l and not hot_r:
        return left.join(right, on, "inner")
    a = _spread(left, on, hot_l, hot_r, salts, "_salt_l", "_salt_r")
    b = _spread(right, on, hot_r, hot_l, salts, "_salt_r", "_salt_l")
    return a.join(b, [on, "_salt_l", "_salt_r"], "inner").drop("_salt_l", "_salt_r")


def _renamed(company: DataFrame, partner: DataFrame, on: str) -> tuple[DataFrame, DataFrame, list[str]]:
    merged = merged_columns(company.columns, partner.columns, on)
    c = company.select(on, *[F.col(x).alias(out) for party, x, out in merged if party == COMPANY])
    p = partner.select(on, *[F.col(x).alias(out) for party, x, out in merged if party != COMPANY])
    return c, p, [out for _, _, out in merged]


def psi_join(company: DataFrame, partner: DataFrame, on: str = "id", skew: str = "aqe", **options) -> DataFrame:
    """Aligned table: id, company's columns, partner's columns.

    Duplicate ids multiply. Null ids never match. Either side is broadcast only if Spark's
    own size estimate is under its threshold.
    """
    c, p, names = _renamed(company, partner, on)
    return equi_join(c, p, on, skew, **options).select(on, *names)


def psi_cardinality(company: DataFrame, partner: DataFrame, on: str = "id") -> DataFrame:
    """Number of aligned rows.

    Joins per-key counts, so a hot key is one row on either side and no pair is formed.
    """
    c = company.groupBy(on).agg(F.count(F.lit(1)).alias("_c"))
    p = partner.groupBy(on).agg(F.count(F.lit(1)).alias("_p"))
    pairs = F.coalesce(F.sum(F.col("_c") * F.col("_p")), F.lit(0)).cast("bigint")
    return c.join(p, on, "inner").agg(pairs.alias("n"))


def key_intersection(company: DataFrame, partner: DataFrame, on: str = "id") -> DataFrame:
    """Distinct ids held by both. Copies are dropped before the shuffle, so hot ids are harmless."""
    return company.select(on).distinct().join(partner.select(on).distinct(), on, "left_semi")


def psi_public_columns(
    company: DataFrame, partner: DataFrame, company_public: list[str], partner_public: list[str], on: str = "id", skew: str = "aqe"
) -> DataFrame | None:
    """Public columns of aligned rows, company's left of partner's; None if a side has none."""
    if not company_public or not partner_public:
        return None
    return psi_join(company.select(on, *company_public), partner.select(on, *partner_public), on, skew)


# --- row identity ----------------------------------------------------------------------------


def number_copies(df: DataFrame, out: str = "copy") -> DataFrame:
    """Number equal rows 0, 1, 2, ... in any order.

    Equal rows are first counted with map-side combining, so a group of copies is never
    held by one task; a group over a million rows is cut into chunks that are spread before
    they are written out again.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= COPY_CHUNK)
    few = few.select(*df.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias(out))
    many = counted.where(F.col("_n") > COPY_CHUNK)
    many = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(COPY_CHUNK).cast("bigint"))))
    many = many.repartition(*df.columns, "_from")
    last = F.least(F.col("_from") + COPY_CHUNK, F.col("_n")) - 1
    many = many.select(*df.columns, F.explode(F.sequence(F.col("_from"), last)).alias(out))
    return few.unionByName(many)


def _row_mark(df: DataFrame, on: str, out: str) -> DataFrame:
    content = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    marked = number_copies(df)
    return marked.withColumn(out, F.concat_ws(".", content, F.col("copy"))).drop("copy")


def _place_mark(df: DataFrame, on: str, out: str) -> DataFrame:
    """Rows that can match, with their place; written, so that the places stay."""
    return materialise(df.where(F.col(on).isNotNull()).withColumn(out, F.monotonically_increasing_id().cast("string")), "marked")


def tasks_for(*tables: DataFrame) -> int:
    """Partitions that get about ``ROWS_A_TASK`` rows of the tables each, and at least one a core."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_TASK))


def psi_row_index(
    company: DataFrame,
    partner: DataFrame,
    seed: str | int,
    on: str = "id",
    unique_ids: bool = False,
    skew: str = "aqe",
    marks: str = "place",
    tasks: int | None = None,
) -> DataFrame:
    """Aligned table with a ``row_id`` that both parties' outputs share.

    With unique ids the row id is a digest of the id. Otherwise each party marks its own rows
    before the join, so that every aligned row gets its own id, equal rows included. The mark is
    the row's place in a table that is written once (``marks="place"``: the join's own exchanges
    and no others), or a digest of its content and a copy number (``"content"``), which are the
    same in every run, at the price of grouping both sides by all columns. The seed is a secret:
    who knows it can test ids against row ids.

    ``tasks`` is for callers that group the rows by id: the join and what follows then run in so many
    partitions (see ``tasks_for``). Adaptive execution would size them by the few bytes a mark takes, and
    a digest takes ten times as many; it neither merges nor splits the given ones.
    """
    if marks not in ("place", "content"):
        raise ValueError(f"unknown marks {marks!r}")
    if tasks and (unique_ids or skew != "aqe"):
        raise ValueError("tasks are for marked rows without salts")
    if unique_ids:
        joined = psi_join(company, partner, on, skew)
        names = [c for c in joined.columns if c != on]
        return joined.select(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(on).cast("string")), 256).alias("row_id"), on, *names)
    c, p, names = _renamed(company, partner, on)
    mark = _place_mark if marks == "place" else _row_mark
    c, p = mark(c, on, "_cm"), mark(p, on, "_pm")
    if tasks:
        c, p = c.repartition(tasks, on), p.repartition(tasks, on)
    joined = equi_join(c, p, on, skew)
    row_id = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(on).cast("string"), "_cm", "_pm"), 256)
    return joined.select(row_id.alias("row_id"), on, *names)


def dense_row_index(indexed: DataFrame, out: str = "pos") -> DataFrame:
    """Positions 0..n-1 in the order of ``row_id``, for consumers that need arrays."""
    return global_position(indexed, "row_id", out=out)


# --- blinded ids -------------------------------------------------------------------------------


def salted_token(id: Column, salts: Iterable[str]) -> Column:
    """SHA-256 over both parties' secret salts and the id. No Python involved."""
    return F.when(id.isNotNull(), F.sha2(F.concat(*[F.lit(s) for s in salts], id.cast("string")), 256))


def hash_to_group(id: Column) -> Column:
    """Id to a group element: a SHA-512 digest, which counts modulo the prime as a point's x-coordinate.

    Every number is one of Curve25519 or of its twist, and both serve: a ladder over x-coordinates
    never leaves the one it starts in.
    """
    return F.unhex(F.sha2(id.cast("string"), 512))


def blind(token: Column, secret: int) -> Column:
    """Multiply group elements by a party's secret. Blinding by two parties commutes.

    The secret travels in the function's closure and is not part of the plan. The function
    counts as non-deterministic only to keep the optimizer from moving a copy of it into the
    join's null filter, which would do the costly work twice.
    """
    if not isinstance(secret, int) or not usable(secret):
        raise ValueError("a secret is a positive integer that no group order divides")

    @F.pandas_udf("binary")
    def raise_to_secret(tokens: pd.Series) -> pd.Series:
        out, known = tokens.astype(object), tokens.notna()
        points = multiples([int.from_bytes(t, "big") % PRIME for t in tokens[known]], secret)
        out[known] = pd.Series([x.to_bytes(TOKEN_BYTES, "big") for x in points], out.index[known], object)
        return out

    return raise_to_secret.asNondeterministic()(token)


def _blinded_side(df: DataFrame, on: str, first: int, second: int, skew: str) -> DataFrame:
    # Blinding costs a millisecond, a shuffled row microseconds: blind distinct ids only,
    # and spread them by number, since a partitioning by id would be merged into the distinct and
    # then into few tasks, as ids are small.
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ids = df.select(on).where(F.col(on).isNotNull()).distinct().repartition(tasks)
    element = blind(blind(hash_to_group(F.col(on)), first), second)
    # As text, since the sketch of frequent items that salted joins use takes no binary values.
    tokens = ids.select(on, F.hex(element).alias("token"))
    return equi_join(df, tokens, on, skew).drop(on)


def psi_blinded_join(
    company: DataFrame,
    partner: DataFrame,
    company_secret: int | str,
    partner_secret: int | str,
    on: str = "id",
    mode: str = "salted",
    skew: str = "aqe",
) -> DataFrame:
    """Aligned table without ids, compared on tokens made from both parties' secrets.

    ``mode="salted"`` hashes with both salts (a trusted runner knows both) and needs no
    Python. ``mode="two_party"`` blinds points of a curve with each party's secret in turn, so
    neither party alone can make or undo a token; it is the costly mode.
    """
    c, p, names = _renamed(company, partner, on)
    if mode == "salted":
        salts = [str(company_secret), str(partner_secret)]
        c = c.withColumn("token", salted_token(F.col(on), salts)).drop(on)
        p = p.withColumn("token", salted_token(F.col(on), salts)).drop(on)
    elif mode == "two_party":
        c = _blinded_side(c, on, int(company_secret), int(partner_secret), skew)
        p = _blinded_side(p, on, int(partner_secret), int(company_secret), skew)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return equi_join(c, p, "token", skew).select(*names)
