import random
import re

from pyspark.sql import functions as F

from splitframe.llm.mixing import mix, mixed_documents, permuted
from tests.llm.helpers import documents, empty, nasty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Sources in the order of their weights; reshares what is over until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        got = {s: cap * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if got[s] > cap * sizes[s] + 1e-9}
        if not over:
            return got
        capped |= over


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 257):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    names = ["b", "a", None, "é", "c", "B"]
    texts = [" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(400)]
    sources = [names[min(5, int(rng.expovariate(0.7)))] for _ in texts]
    df = documents(spark, texts, sources)
    made = mix(df, block=16, shards=4)
    got = made.taken().collect()
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r["size"] == len(WORD.findall(texts[r["id"]])) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert {(r["id"], r["taken"]) for r in mix(df, block=16, shards=4).taken().collect()} == {(r["id"], r["taken"]) for r in got}
    counts = made.shard_counts().collect()
    assert sum(r["count"] for r in counts) == made.slots.count() and {r["shard"] for r in counts} == {0, 1, 2, 3}
    out = mixed_documents(df, block=16, shards=4).collect()
    words = {}
    for r in out:
        n = len(WORD.findall(r["text"]))
        assert n and r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + n
    assert words == {r["id"]: r["taken"] for r in got if r["taken"]}


def test_mixing_edges(spark):
    got = mix(nasty(spark)).taken().collect()
    assert len(got) == 11 and {r["taken"] for r in got if r["id"] in (3, 4, 5)} == {0}
    out = mixed_documents(nasty(spark))
    assert out.columns == nasty(spark).columns and all(r[c] == "x" for r in out.collect() for c in ("_row", "_first", "_words", "_size"))
    assert mix(empty(spark)).taken().count() == 0 and mixed_documents(empty(spark)).count() == 0
