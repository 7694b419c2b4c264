import pytest
from pyspark.sql import functions as F

from splitframe.operators import shares


def table(spark):
    values = [(i, float(v)) for i, v in enumerate([-32768, 32767, 0.25, -1.5, 1e6, -1e-3])] + [(6, None)]
    return spark.createDataFrame(values, "row_id bigint, x double")


def test_split_adds_up(spark):
    first, second = shares.share_split(table(spark), ["x"], "seed")
    got = {r["row_id"]: r["x"] for r in shares.share_reconstruct(first, second).collect()}
    for r in table(spark).collect():
        assert got[r["row_id"]] == (None if r["x"] is None else pytest.approx(r["x"], abs=1e-9))


def test_masks_are_integers_in_range_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("z"))
    first, _ = shares.share_split(df, ["x", "z"], 1)
    again, _ = shares.share_split(df.repartition(5), ["x", "z"], 1)
    other, _ = shares.share_split(df, ["x", "z"], 2)
    low, high, whole, same = first.agg(F.min("x"), F.max("x"), F.min(F.col("x") == F.floor("x")), F.count_if(F.col("x") == F.col("z"))).first()
    assert -32768 <= low < -30000 and 30000 < high <= 32767 and whole and same < 10
    assert first.exceptAll(again).count() == 0
    assert first.join(other.withColumnRenamed("x", "o"), "row_id").where(F.col("x") == F.col("o")).count() < 10


@pytest.mark.parametrize("unique", [True, False])
def test_psi_shares_add_up_to_the_join(spark, unique):
    company = spark.createDataFrame([("a", 1.5, 7), ("b", 2.5, 8), ("c", 0.0, 9)], "id string, x double, bin int")
    partner = spark.createDataFrame([("b", -3.0), ("c", 4.0), ("d", 5.0)], "id string, z double")
    ours, theirs = shares.psi_shares(company, partner, 3, unique_ids=unique, public=("bin",))
    assert "id" not in ours.columns and "id" not in theirs.columns
    table = shares.share_reconstruct(ours, theirs, keep=("bin",))
    assert sorted((r["bin"], round(r["x"], 6), round(r["z"], 6)) for r in table.collect()) == [(8, 2.5, -3.0), (9, 0.0, 4.0)]


def test_linear_operations_on_shares(spark):
    df = table(spark).where("x is not null")
    first, second = shares.share_split(df, ["x"], 4)
    tripled = shares.share_reconstruct(shares.share_scale(first, ["x"], 3.0), shares.share_scale(second, ["x"], 3.0))
    moved = shares.share_reconstruct(shares.share_shift(first, ["x"], 10.0), second)
    zero = shares.share_reconstruct(shares.share_sub(first, first), shares.share_sub(second, second))
    want = {r["row_id"]: r["x"] for r in df.collect()}
    for got, f in ((tripled, lambda v: 3 * v), (moved, lambda v: v + 10), (zero, lambda v: 0.0)):
        assert all(r["x"] == pytest.approx(f(want[r["row_id"]]), abs=1e-8) for r in got.collect())


def test_group_sum_reveals_totals_only(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    first, second = shares.share_split(df, ["x"], 5)
    got = {r["g"]: r["x"] for r in shares.share_group_sum(first, second, df, ["g"], ["x"]).collect()}
    assert got == {g: pytest.approx(sum(i for i in range(100) if i % 3 == g)) for g in range(3)}
