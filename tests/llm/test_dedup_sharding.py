import hashlib
import random

from pyspark.sql import functions as F

from splitframe.llm.dedup import exact_duplicates
from splitframe.llm.sharding import Splitters, _quantiles, shard, write_shards
from tests.llm.helpers import documents, empty, nasty


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_names_are_exact_for_many_small_blocks(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abC") for _ in range(rng.choice([0, 3, 4, 8, 9, 17, 33]))) for _ in range(300)]
    texts += ["abcdabcdabcd", "abcdabcd", "dcbaabcd", "abcddcba", None] * 5
    got = {r["doc_id"]: r for r in exact_duplicates(documents(spark, texts), block_bytes=4).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lowered(t), []).append(i)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_dedup_edges(spark):
    got = exact_duplicates(nasty(spark)).collect()
    assert len(got) == 11
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(kept) == [2, 4, 5, 6, 7, 8, 9]  # one of the repeated rows; 4 for the empty texts
    assert exact_duplicates(empty(spark)).count() == 0


def shards_of(df, n=8):
    return shard(df, n, F.xxhash64(F.coalesce("text", F.lit(""))), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("bigint"), F.xxhash64("doc_id"))


def test_shards_are_even_gapless_and_hold_groups_together(spark):
    rng = random.Random(2)
    texts = ["x" * rng.randrange(400) + str(i) for i in range(3000)] + ["light copies"] * 8 + ["hot text of many copies " * 4] * 4000
    df = documents(spark, texts)
    got = shards_of(df).collect()
    assert len(got) == len(texts)
    sums, slots, where = [0] * 8, [[] for _ in range(8)], {}
    for r in got:
        sums[r["shard"]] += len(r["text"]) + 16
        slots[r["shard"]].append(r["slot"])
        where.setdefault(r["text"], set()).add(r["shard"])
    assert max(sums) < 1.06 * sum(sums) / 8 and min(sums) > 0.94 * sum(sums) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert len(where["light copies"]) == 1 and len(where[texts[-1]]) > 2
    again = shards_of(df.repartition(3)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_sharding_edges(spark, tmp_path):
    got = shards_of(nasty(spark), 3)
    assert got.count() == 11 and set(got.columns) == set(nasty(spark).columns)
    others = [c for c in nasty(spark).columns if c not in ("shard", "slot")]
    assert sorted(map(str, got.select(others).collect())) == sorted(map(str, nasty(spark).select(others).collect()))
    write_shards(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 11
    assert shards_of(empty(spark)).count() == 0


def test_overfull_ranges_are_subdivided_until_none_is_left(spark):
    # Almost all weight in few keys close together, and units of many equal rows.
    rows = [(k, k, 1) for k in range(2000)] + [(5000 + k % 40, k, 500) for k in range(2000)] + [(7000, 7, 100)] * 3000
    df = spark.createDataFrame(rows, "k bigint, t bigint, s bigint")
    got = shard(df, 16, F.col("k"), F.col("s"), F.col("t")).groupBy("shard").agg(F.sum("s").alias("w"), F.count_distinct("k", "t").alias("units")).collect()
    share = sum(r[2] for r in rows) / 16
    assert sum(r["w"] for r in got) == 16 * share
    assert all(r["w"] < 1.15 * share for r in got if r["units"] > 1) and max(r["w"] for r in got) <= 300_000 + 0.15 * share
    assert _quantiles([(1, 1, 1.0), (2, 5, 9.0), (2, 5, 9.0), (3, 0, 1.0)], 4.0) == [(2, 5), (2, 6), (3, 0)]


def test_find_counts_bounds_at_or_below():
    import numpy as np

    rng = random.Random(3)
    pairs = sorted({(rng.randrange(5), rng.randrange(5)) for _ in range(9)})
    rows = [(a, b) for a in range(-1, 6) for b in range(-1, 6)]
    found = Splitters.of(pairs).find(np.array([a for a, _ in rows]), np.array([b for _, b in rows]))
    assert found.tolist() == [sum(p <= r for p in pairs) for r in rows]
