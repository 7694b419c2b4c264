import pytest
from pyspark.sql import functions as F

from splitframe import Party, shared_dir
from splitframe.operators import position, prep


def people(spark, n=100):
    return spark.range(n).select((F.col("id") * 7 % n).alias("id"), F.col("id").cast("string").alias("s")).repartition(6)


def test_positions_are_dense_and_ordered(spark):
    got = position.global_position(people(spark), "id").collect()
    assert sorted((r["pos"], r["id"]) for r in got) == [(i, i) for i in range(100)]


def test_positions_by_text_with_hot_key(spark):
    df = spark.range(90).select(F.when(F.col("id") < 30, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = {r["pos"]: (r["k"], r["id"]) for r in position.global_position(df, "k", "id").collect()}
    assert [got[i] for i in range(90)] == sorted(got.values())


def test_slices_read_only_their_rows(spark):
    placed = position.position_rows(people(spark), "id")
    for low, high in ((0, 10), (7, 63), (99, 100), (50, 50), (90, 500)):
        assert sorted(r["id"] for r in placed.slice(low, high).collect()) == list(range(low, min(high, 100)))
    plan = placed.slice(3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(_mid" in plan


def test_empty_table_has_no_positions(spark):
    placed = position.position_rows(people(spark).where("id < 0"), "id")
    assert placed.rows == 0 and placed.slice(0, 5).count() == 0


@pytest.mark.parametrize("n, train", [(189, 141), (379, 284), (575, 431), (768, 576), (4, 3), (1, 0)])
def test_split_sizes(spark, n, train):
    assert prep.train_rows(n) == train


def test_ordered_split_keeps_the_order(spark):
    train, test = prep.ordered_train_test_split(people(spark, 10), "id")
    assert sorted(r["id"] for r in train.collect()) == list(range(7))
    assert sorted(r["id"] for r in test.collect()) == [7, 8, 9]


def test_hashed_split_covers_every_row_once(spark):
    train, test = prep.hashed_train_test_split(people(spark, 2000), "id", 1)
    assert train.count() + test.count() == 2000 and train.join(test, "id").count() == 0
    assert 400 < test.count() < 600


def test_batch_larger_than_the_table(spark):
    assert [r["batch"] for r in prep.batch_assign(people(spark, 3), "id", batch_size=64).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        prep.batch_assign(people(spark, 3), "id", batch_size=0)


def test_sample_batches_differ_by_step_and_repeat(spark):
    df = people(spark)
    draw = lambda step: sorted(r["id"] for r in prep.sample_batch(df, "id", 1, step, 20).collect())
    assert draw(1) == draw(1) and draw(1) != draw(2) and len(set(draw(1))) == 20


def test_parties_sample_separately(spark):
    df = people(spark, 3000)
    a, b = (prep.party_sample(df, "id", 1, p) for p in ("company", "partner"))
    assert 2600 < a.count() < 2800 and 2300 < a.join(b, "id").count() < 2550


def test_label_holder(spark):
    x, y = spark.createDataFrame([(1, 2.0)], "id int, x double"), spark.createDataFrame([(1, 0.0)], "id int, y double")
    assert prep.find_label_party(y, x) == "company"
    assert prep.find_label_party(x, y) == "partner"
    with pytest.raises(ValueError):
        prep.find_label_party(x, x)


def test_one_hot(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "y int")
    assert [r["y_vec"] for r in prep.one_hot_label(df).collect()] == [[0, 0, 1], [1, 0, 0], [0, 1, 0]]
    coded = df.select(prep.one_hot(F.col("y"), [1, 3], off=-1).alias("v")).collect()
    assert [r["v"] for r in coded] == [[-1, 1], [1, -1], [-1, -1]]


def test_too_many_classes(spark):
    with pytest.raises(ValueError):
        prep.label_classes(people(spark), "id", 5)
    assert len(prep.label_classes(people(spark, 50), "id")) == 50


def test_one_hot_of_any_number_of_classes(spark):
    df = spark.createDataFrame([(c, "x") for c in (7, 3, None, 7, 5)], "y int, at string").withColumn("size", F.lit(1))
    got = prep.one_hot_label(df, sparse=True)
    assert sorted(((r["y"] or 0), r["y_vec"]["at"], r["y_vec"]["size"], r["at"]) for r in got.collect() if r["y"]) == [(3, 0, 3, "x"), (5, 1, 3, "x"), (7, 2, 3, "x"), (7, 2, 3, "x")]
    assert [r["y_vec"]["at"] for r in got.where("y is null").collect()] == [None]
    assert {r["y"]: r["y_vec"] for r in prep.one_hot_label(df).collect()} == {7: [0, 0, 1], 3: [1, 0, 0], 5: [0, 1, 0], None: [0, 0, 0]}
    given = prep.one_hot_label(df, classes=[7, 5], sparse=True).collect()
    assert {r["y"]: r["y_vec"]["at"] for r in given} == {7: 0, 5: 1, 3: None, None: None}
    assert prep.one_hot_label(df.where("false")).collect() == []


@pytest.mark.parametrize("size", [0, 1, 70, 199, 200, 500])
def test_large_samples_are_the_same_rows(spark, size):
    df = people(spark, 200)
    want = sorted(r["id"] for r in prep.sample_batch(df, "id", 1, 2, size).collect())
    assert sorted(r["id"] for r in prep.sample_batch(df, "id", 1, 2, size, top_rows=-1).collect()) == want and len(want) == min(size, 200)


def test_shares_are_not_rounded(spark):
    df = people(spark, 30_000)
    assert 0 < df.count() - prep.party_sample(df, "id", 1, "company", 0.9996).count() < 60
    train, test = prep.hashed_train_test_split(df, "id", 1, 0.00004)
    assert test.count() < 10 and train.count() + test.count() == 30_000


def test_party_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3, 0.0)], "id int, x double, b int, y double")
    spec = Party.of(df, public=("b",)).spec
    assert (spec.features, spec.public, spec.label) == (("x",), ("b",), "y")
    assert Party.of(df.drop("y")).spec.label is None


def test_party_apply_counts_results(spark):
    with pytest.raises(ValueError):
        prep.party_apply(people(spark), lambda df: (df, df), num_returns=3)


def test_intermediate_tables_go_to_the_named_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_internal_names_of_positions_may_be_taken(spark):
    from splitframe.operators.position import position_rows

    df = spark.createDataFrame([(i, f"m{i}", f"p{i}", f"s{i}") for i in range(20)], "id int, _mid string, _Part string, _start string")
    placed = position_rows(df.repartition(3), "id")
    got = placed.with_position("pos").collect()
    assert {tuple(r) for r in got} == {(i, f"m{i}", f"p{i}", f"s{i}", i) for i in range(20)}
    assert sorted(r["_mid"] for r in placed.slice(3, 6).collect()) == ["m3", "m4", "m5"]
