import re

import pytest
from pyspark.sql import functions as F

from splitframe.operators import align
from splitframe.workload.fixtures import company_f, partner_f
from splitframe.workload.registry import QUERIES


def pair(spark, a, b):
    return spark.createDataFrame(a, "id string, x double"), spark.createDataFrame(b, "id string, z double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_duplicates_multiply(spark):
    a, b = pair(spark, [("k", 1.0), ("k", 2.0)], [("k", 3.0), ("k", 4.0), ("k", 5.0)])
    assert align.psi_join(a, b).count() == 6
    assert align.psi_cardinality(a, b).first()["n"] == 6


def test_tasks_of_marked_rows_follow_their_number(spark, sf, monkeypatch):
    company, partner = company_f(spark, sf), partner_f(spark, sf)
    monkeypatch.setattr(align, "ROWS_A_TASK", 500)
    tasks = align.tasks_for(company, partner)
    assert tasks == -(-(company.count() + partner.count()) // 500) > 8
    got = QUERIES["psi_row_index_duplicates"](spark, sf)
    assert f"hashpartitioning(id, {tasks})" in re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())
    assert rows(got.select("id", "n", "row_ids")) == rows(company.groupBy("id").agg(F.count("c0").alias("n"), F.count("c0")))
    assert rows(align.psi_row_index(company, partner, "s", tasks=tasks).drop("row_id")) == rows(align.psi_join(company, partner))
    with pytest.raises(ValueError, match="without salts"):
        align.psi_row_index(company, partner, "s", skew="salt", tasks=tasks)


def test_null_ids_never_match(spark):
    a, b = pair(spark, [(None, 1.0), ("k", 2.0)], [(None, 3.0), ("k", 4.0)])
    assert rows(align.psi_join(a, b)) == [("k", 2.0, 4.0)]
    assert rows(align.psi_blinded_join(a, b, "s1", "s2")) == [(2.0, 4.0)]
    assert rows(align.psi_blinded_join(a, b, 12345, 6789, mode="two_party")) == [(2.0, 4.0)]
    assert rows(align.key_intersection(a, b)) == [("k",)]


def test_empty_intersection(spark):
    a, b = pair(spark, [("a", 1.0)], [("b", 1.0)])
    assert align.psi_join(a, b).count() == 0
    assert align.psi_cardinality(a, b).first()["n"] == 0


def test_common_column_names_get_the_party(spark):
    a = spark.createDataFrame([("k", 1.0)], "id string, x double")
    b = spark.createDataFrame([("k", 2.0)], "id string, x double")
    assert align.psi_join(a, b).columns == ["id", "company_x", "partner_x"]


@pytest.mark.parametrize("hot_side", ["left", "right", "both"])
def test_salted_join_equals_plain_join_with_a_hot_key(spark, hot_side):
    n = 60 if hot_side == "both" else 2000
    # A third of the rows share one key, and all of those are equal.
    hot = spark.range(3 * n).select(F.when(F.col("id") < n, "hot").otherwise(F.col("id").cast("string")).alias("id"))
    hot = hot.withColumn("x", F.when(F.col("id") == "hot", 1.0).otherwise(F.col("id").try_cast("double")))
    thin = spark.createDataFrame([("hot", 1.0), ("hot", 2.0), (str(n + 5), 3.0)], "id string, z double")
    a = hot if hot_side != "right" else thin
    b = {"left": thin, "right": hot, "both": hot.withColumnRenamed("x", "z")}[hot_side]
    assert align.hot_keys(hot, "id", 0.1) == ["hot"]
    plain = align.equi_join(a, b, "id")
    salted = align.equi_join(a, b, "id", "salt", salts=7, share=0.1)
    assert rows(salted) == rows(plain)
    assert salted.columns == plain.columns


def test_hot_rows_are_spread_over_salts(spark):
    df = spark.range(800).select(F.lit("hot").alias("id"), F.lit(1.0).alias("x")).repartition(8)
    spread = align._spread(df, "id", ["hot"], [], 4, "own", "other")
    assert spread.select("own").distinct().count() == 4


def test_row_ids_of_copies_are_distinct_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(align, "COPY_CHUNK", 7)
    a, b = pair(spark, [("k", 1.0)] * 20 + [("m", None)] * 2, [("k", 2.0)] * 3 + [("m", 1.0)])
    placed = align.psi_row_index(a, b, "seed")
    assert placed.count() == 62 and placed.select("row_id").distinct().count() == 62
    # The ids are those of the written places, however often they are computed.
    assert rows(placed) == rows(placed)
    with pytest.raises(ValueError):
        align.psi_row_index(a, b, "seed", marks="none")
    indexed = align.psi_row_index(a, b, "seed", marks="content")
    assert indexed.count() == 62
    assert indexed.select("row_id").distinct().count() == 62
    again = align.psi_row_index(a.repartition(3), b.repartition(2), "seed", marks="content")
    assert rows(indexed) and {r["row_id"] for r in indexed.collect()} == {r["row_id"] for r in again.collect()}


def test_number_copies_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(align, "COPY_CHUNK", 10)
    df = spark.createDataFrame([("a",)] * 35 + [("b",)] * 10 + [("c",)], "id string")
    got = align.number_copies(df)
    assert rows(got) == sorted([("a", i) for i in range(35)] + [("b", i) for i in range(10)] + [("c", 0)])


def test_blinding_commutes(spark):
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    token = align.hash_to_group(F.col("id"))
    one = align.blind(align.blind(token, 1234567), 7654321)
    two = align.blind(align.blind(token, 7654321), 1234567)
    got = ids.select("id", one.alias("one"), two.alias("two"), token.alias("t")).collect()
    assert all(r["one"] == r["two"] for r in got)
    assert [r["one"] is None for r in got] == [r["id"] is None for r in got]
    assert all(r["one"] != r["t"] for r in got if r["id"])


def test_blinded_ids_are_computed_once_and_in_many_tasks(spark):
    a, b = pair(spark, [("a", 1.0)], [("a", 1.0)])
    joined = align.psi_blinded_join(a, b, 3, 5, mode="two_party")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("raise_to_secret(raise_to_secret") == 2
    assert "Repartition" in plan


def test_public_columns_missing_on_one_side(spark):
    a, b = pair(spark, [("a", 1.0)], [("a", 1.0)])
    assert align.psi_public_columns(a, b, ["x"], []) is None


def test_secrets_are_not_in_the_plan(spark):
    a, b = pair(spark, [("a", 1.0)], [("a", 1.0)])
    joined = align.psi_blinded_join(a, b, 998877665544332211, 112233445566778899, mode="two_party")
    assert "998877665544332211" not in joined._jdf.queryExecution().toString()


@pytest.mark.parametrize("mode, secrets", [("salted", ("s1", "s2")), ("two_party", (1234567, 7654321))])
def test_blinded_join_takes_hot_ids(spark, mode, secrets):
    a, b = pair(spark, [("hot", float(i)) for i in range(40)] + [("k", 1.0), ("m", 2.0)], [("hot", 3.0), ("k", 4.0)])
    plain = rows(align.psi_join(a, b).drop("id"))
    assert rows(align.psi_blinded_join(a, b, *secrets, mode=mode, skew="salt")) == plain
