import pytest

import corpus_pipeline
from splitframe.llm.common import bucket
from splitframe.llm.queries import ORACLES, QUERIES
from splitframe.session import materialise
from tests.check_oracles import compare, connect
from tests.llm.helpers import empty, nasty
from tests.llm.test_pairs import brute


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


def test_ten_queries():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, before, sf), name)
        kept[name] = (before, after)
        before = after
    assert all(kept[n][1].columns == columns for n in list(kept)[:-1])
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    # Labels that the classifier has not seen.
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(bucket(4) == 2).collect()
    stays = ids(kept["quality"][1])
    assert sum((r["doc_id"] in stays) == bool(r["quality"]) for r in labels) >= 0.9 * len(labels)
    rows = sorted(kept["near_duplicates"][0].select("doc_id", "text").collect())
    sets, roots = brute([r["text"] for r in rows], 5, 80)
    assert ids(kept["near_duplicates"][1]) == {rows[i]["doc_id"] for i in set(roots)}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaking = {r["doc_id"] for r in kept["benchmark_leaks"][0].collect() if any(i in r["text"] for i in items)}
    assert ids(kept["benchmark_leaks"][0]) - ids(kept["benchmark_leaks"][1]) >= leaking
    given, mixed = kept["mixture"][0].collect(), kept["mixture"][1].collect()
    words = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(given)) <= 0.5 * len({r["source"] for r in given}) + 1
    last = kept["shards"][1]
    assert last.count() == len(mixed) and set(last.columns) == {*columns, "shard", "slot"}


def test_stages_bear_anything(spark, sf):
    for docs in (nasty(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, sf), name)
            docs.count()
