"""Two-party views of the test tables, as DataFrames and as SQL prefixes.

A: orders and order lines, label at partner. B: documents and labels, label at partner.
C: customers and their orders, label at company. D: as A, for regression.
E: embeddings. F: order lines (ids repeat) and orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..spec import Party


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _mean_of_hundredths(c: str) -> Column:
    """Mean over integer hundredths: the same in every engine, whatever the order of adding."""
    return F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double") / (F.lit(100.0) * F.count(F.lit(1)))


def company_a(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("c0"), F.month("o_orderdate").cast("double").alias("c1")
    )


def partner_a(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    return grouped.agg(
        F.sum("l_quantity").alias("p0"),
        _mean_of_hundredths("l_discount").alias("p1"),
        F.count(F.lit(1)).cast("double").alias("p2"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("y"),
    )


def company_b(spark: SparkSession, sf: str) -> DataFrame:
    spaces = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("c0"), spaces.cast("double").alias("c1")
    )


def partner_b(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("p0"), F.col("quality").cast("double").alias("y")
    )


def company_c(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("c0"),
        F.col("c_nationkey").cast("double").alias("c1"),
        F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0).alias("y"),
    )


def partner_c(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"))
    return grouped.agg(F.count(F.lit(1)).cast("double").alias("p0"), _mean_of_hundredths("o_totalprice").alias("p1"))


def company_d(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.month("o_orderdate").cast("double").alias("c0"), F.col("o_totalprice").alias("y")
    )


def partner_d(spark: SparkSession, sf: str) -> DataFrame:
    return partner_a(spark, sf).drop("y")


def company_f(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("c0"))


def partner_f(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p0"))


def parties(spark: SparkSession, sf: str, name: str) -> tuple[Party, Party]:
    sides = {"a": (company_a, partner_a), "b": (company_b, partner_b), "c": (company_c, partner_c), "d": (company_d, partner_d)}
    company, partner = sides[name]
    return Party.of(company(spark, sf)), Party.of(partner(spark, sf))


def stored(spark: SparkSession, sf: str, name: str) -> tuple[Party, Party]:
    """Parties whose aggregated side is written once: binning and training read it many times."""
    company, partner = parties(spark, sf, name)
    return company, Party.of(materialise(partner.df, "partner"))


def joined(spark: SparkSession, sf: str, name: str = "a") -> DataFrame:
    company, partner = parties(spark, sf, name)
    return company.df.join(partner.df, "id")


def scaled_a(spark: SparkSession, sf: str) -> DataFrame:
    """A with features of similar size, for the linear models."""
    return joined(spark, sf, "a").select(
        "id",
        (F.col("c0") / 200000.0).alias("c0"),
        (F.col("c1") / 12.0).alias("c1"),
        (F.col("p0") / 100.0).alias("p0"),
        (F.col("p1") * 10.0).alias("p1"),
        (F.col("p2") / 5.0).alias("p2"),
        "y",
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """E as (i, j, v)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return e.select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))


def wide_e(spark: SparkSession, sf: str, width: int = 64) -> DataFrame:
    """E as columns x0..x63."""
    e = table(spark, sf, "embeddings")
    return e.selectExpr("vec_id AS id", "label", *[f"CAST(embedding[{j}] AS DOUBLE) AS x{j}" for j in range(width)])


FEATURES_A = ["c0", "c1", "p0", "p1", "p2"]
FEATURES_D = ["c0", "p0", "p1", "p2"]

_PARTNER_LINES = (
    "select l_orderkey as id, sum(l_quantity) as p0, "
    "cast(sum(cast(round(l_discount * 100) as bigint)) as double) / (100.0E0 * count(*)) as p1, cast(count(*) as double) as p2"
)

SQL_A = f"""
co as (select o_orderkey as id, o_totalprice as c0, cast(month(o_orderdate) as double) as c1 from orders),
pa as ({_PARTNER_LINES}, cast(max(case when l_returnflag = 'R' then 1 else 0 end) as double) as y from lineitem group by l_orderkey),
j as (select co.id, c0, c1, p0, p1, p2, y from co join pa on co.id = pa.id)"""

SQL_A_SCALED = SQL_A + """,
s as (select id, c0 / 200000.0E0 as c0, c1 / 12.0E0 as c1, p0 / 100.0E0 as p0, p1 * 10.0E0 as p1, p2 / 5.0E0 as p2, y from j)"""

SQL_B = """
co as (select doc_id as id, cast(n_chars as double) as c0, cast(length(text) - length(replace(text, ' ', '')) as double) as c1 from documents),
pa as (select doc_id as id, cast(toxic as double) as p0, cast(quality as double) as y from labels),
j as (select co.id, c0, c1, p0, y from co join pa on co.id = pa.id)"""

SQL_C = """
co as (select c_custkey as id, c_acctbal as c0, cast(c_nationkey as double) as c1,
              case when c_mktsegment = 'BUILDING' then 1.0E0 else 0.0E0 end as y from customer),
pa as (select o_custkey as id, cast(count(*) as double) as p0,
              cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / (100.0E0 * count(*)) as p1 from orders group by o_custkey),
j as (select co.id, c0, c1, y, p0, p1 from co join pa on co.id = pa.id)"""

SQL_D = f"""
co as (select o_orderkey as id, cast(month(o_orderdate) as double) as c0, o_totalprice as y from orders),
pa as ({_PARTNER_LINES} from lineitem group by l_orderkey),
j as (select co.id, c0, y, p0, p1, p2 from co join pa on co.id = pa.id)"""

SQL_E = """
e as (select vec_id as i, unnest(range(len(embedding))) as j, cast(unnest(embedding) as double) as v, label as y from embeddings)"""

SQL_F = """
co as (select l_orderkey as id, l_quantity as c0 from lineitem),
pa as (select o_orderkey as id, o_totalprice as p0 from orders),
j as (select co.id, c0, p0 from co join pa on co.id = pa.id)"""
