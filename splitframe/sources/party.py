"""Reading party tables, aligned pairs and generated examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import keyed_digest, keyed_unit, random_key
from ..operators.prep import find_label_party, merged_columns, stack_rows
from ..spec import COMPANY, LABEL, Party

# Fixed value: generated features lie in [0, 100).
FEATURE_RANGE = 100.0


def scan_party_csv(
    spark: SparkSession, path: str, id: str | None = None, float32: bool = False, label: str = LABEL, public: tuple[str, ...] = ()
) -> Party:
    """Party table from CSV with a header: id as text, public columns int, the rest numeric.

    ``id=None`` takes the first column. Types come from this rule, not from reading the data.
    """
    df = spark.read.option("header", True).csv(path)
    return _typed(df, id or df.columns[0], float32, label, public)


def scan_party_parquet(
    spark: SparkSession, path: str, id: str | None = None, float32: bool = False, label: str = LABEL, public: tuple[str, ...] = ()
) -> Party:
    """Party table from Parquet, with the same typing."""
    df = spark.read.parquet(path)
    return _typed(df, id or df.columns[0], float32, label, public)


def _typed(df: DataFrame, id: str, float32: bool, label: str, public: tuple[str, ...]) -> Party:
    if id not in df.columns:
        raise ValueError(f"no id column {id!r}")

    def cast(c: str):
        if c == id:
            return F.col(c).cast("string").alias(c)
        if c in public:
            return F.col(c).cast("int").alias(c)
        # Single precision is a rounding of the values; arithmetic stays in double.
        number = F.col(c).cast("float") if float32 else F.col(c)
        return number.cast("double").alias(c)

    return Party.of(df.select(*map(cast, df.columns)), id, label, public)


def scan_aligned_pair(company: Party, partner: Party, label: str = LABEL) -> tuple[DataFrame, list[str], list[str], str]:
    """Validation data of both parties, joined on the id.

    Returns the joined table, company's and partner's feature names in it, and the party that
    holds the label. Rows are matched by id, since files give no safe row order.
    """
    holder = find_label_party(company.df, partner.df, label)
    merged = merged_columns(company.df.columns, partner.df.columns, company.spec.id)
    right = partner.df.withColumnRenamed(partner.spec.id, company.spec.id)
    pick = lambda df, side: df.select(
        company.spec.id, *[F.col(x).alias(out) for party, x, out in merged if (party == COMPANY) == side]
    )
    joined = pick(company.df, True).join(pick(right, False), company.spec.id)
    own = [out for party, _, out in merged if party == COMPANY and out != label]
    theirs = [out for party, _, out in merged if party != COMPANY and out != label]
    return joined, own, theirs, holder


def gen_party_tables(
    spark: SparkSession, common: int, company_only: int, partner_only: int, company_features: int = 2, partner_features: int = 3, seed: str | int = 0
) -> tuple[DataFrame, DataFrame]:
    """Two random tables with a known overlap, rows shuffled.

    Keys are 20 characters, features uniform in [0, 100). All of it derives from the seed and
    a row number in Spark, so both tables name the same common keys at any size.
    """

    def rows(start: int, count: int, first: int, width: int) -> DataFrame:
        ids = spark.range(start, start + count)
        values = [(keyed_unit(seed, F.col("id"), F.lit(f"x{j}")) * FEATURE_RANGE).alias(f"x{j}") for j in range(first, first + width)]
        return ids.select(random_key(seed, F.col("id")).alias("key"), *values)

    def table(start: int, count: int, first: int, width: int, party: str) -> DataFrame:
        both = stack_rows(rows(0, common, first, width), rows(start, count, first, width))
        return both.withColumnRenamed("key", "id").orderBy(keyed_digest(seed, F.lit(party), F.col("id")))

    company = table(common, company_only, 0, company_features, "company")
    partner = table(common + company_only, partner_only, company_features, partner_features, "partner")
    return company, partner
