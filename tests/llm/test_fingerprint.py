import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from splitframe.llm import fingerprint as fp
from tests.llm.helpers import documents, empty, nasty


def hashes(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    runs = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({" ".join(words)} if words else set())
    return {hashlib.md5(r.encode()).hexdigest()[:16] for r in runs}


def sketch(text):
    every = hashes(text)
    return sorted({h for h in every if int(h, 16) < 16**16 / 8} | ({min(every)} if every else set()))


def like(a, b):
    x, y = ({h for h in s if h < "2"} for s in (a, b))
    if not x and not y:
        x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    """Rows (id, text) to fingerprints, by the law of `with_next`."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest(r[1].encode(), 42) >> 11))
    out = []
    for (i, t), (_, x) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + x[:half]
        a, b, c = sketch(t), sketch(edited), sketch(x)
        out.append((str(i), len(t), edited, "".join(a), "".join(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out)


def run(docs):
    rows = fp.edited_fingerprints(docs).select(
        F.col("given.doc_id").alias("i"), "n_chars", "edited", fp.written("fp"), fp.written("edited_fp"), "near_edited", "near_next"
    )
    return sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in rows.collect())


def stored(df, folder):
    df.write.parquet(str(folder / "docs"))
    return df.sparkSession.read.parquet(str(folder / "docs"))


def test_every_kind_of_row(spark, tmp_path):
    docs = stored(nasty(spark).withColumns({c: F.lit("x") for c in ("given", "key", "tie", "part", "sent", "fp", "edited", "next_text")}), tmp_path)
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_and_single(spark):
    assert run(empty(spark)) == []
    for text in ("", "word", "a b c d e f g"):
        assert run(documents(spark, [text])) == brute([(0, text)])


@pytest.mark.parametrize("hot", ["null", "id"])
def test_one_key_fills_several_ranges(spark, tmp_path, hot):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(400)]
    ids = [rng.choice([None if hot == "null" else 77, i]) for i in range(400)]
    rows = list(zip(ids, texts))
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), tmp_path)
    assert run(docs) == brute(rows)


def test_search_of_ranges(spark):
    cuts = sorted(random.Random(1).sample(range(10_000), 700))
    rows = spark.range(-5, 10_100, 7).select("id", fp._range_of(F.col("id"), cuts, 16).alias("n")).collect()
    assert all(r["n"] == sum(c <= r["id"] for c in cuts) for r in rows)


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    long = [rng.choice(words) for _ in range(20_000)]
    rows = [(" ".join(long), " ".join(long[4000:7000])), ("a b", "a  b"), ("a b", "c d"), ("", " "), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", fp.fingerprint(F.col("a")).alias("x"), fp.fingerprint(F.col("b")).alias("y"))
    got = df.select(fp.likeness(F.col("x"), F.col("y")).alias("l"), fp.containment(F.col("y"), F.col("x")).alias("c"),
                    fp.containment(F.col("x"), F.col("y")).alias("d"), fp.merged(F.col("x"), F.col("y")).alias("m"), "x", "y", fp.parsed(fp.written(F.col("x"))).alias("p")).collect()
    assert got[0]["c"] == 1.0 and abs(got[0]["l"] - 0.15) < 0.02 and abs(got[0]["d"] - 0.15) < 0.02
    assert [(r["l"], r["c"]) for r in got[1:]] == [(1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert all(r["p"] == r["x"] for r in got)
    for r, (a, b) in zip(got, rows):
        every = hashes(a) | hashes(b)
        assert r["m"] == sorted({h for h in every if h < "2"} | ({min(every)} if every else set()))
