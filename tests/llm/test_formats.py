import base64
import glob
import hashlib
import random
import struct

import zstandard
from pyspark.sql import functions as F

from splitframe.llm.chat import escape, format_paths, linear_tree, masked_text, read_turns, reply_paths, unescape
from splitframe.llm.warc import archive, decide, read_archives, write_archives

NODES = "tree struct<id:bigint>, node bigint, parent bigint, role string, text string, score double"


def test_escapes_are_reversible(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("<|\\n>im_endé\n") for _ in range(rng.randrange(12))) for _ in range(2000)] + ["<|im_start|>", "\\<\\|", "<\\|"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in rows)


def read(nodes, branches=1):
    out = format_paths(reply_paths(nodes, branches), nodes)
    return out.select("tree.id", "branch", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("spans")).alias("loss")).collect()


def test_best_branch_of_a_tree(spark):
    rows = [
        (1, None, "user", "q", 0.0),
        (2, 1, "assistant", "a", 1.0),
        (3, 1, "assistant", "b<|im_end|>", 2.0),
        (4, 2, "user", "c", 5.0),
        (5, 3, "user", "d", 1.0),
        (6, 5, "assistant", "e\\", None),
        (7, 99, "user", "lost parent", 0.5),
        (8, 9, "user", "circle", 9.0),
        (9, 8, "user", "circle", 9.0),
        (10, 9, "user", "hangs on a circle", 9.0),
    ]
    nodes = spark.createDataFrame([((1,), *r) for r in rows] + [((None,), 1, None, "user\n<|x", "alone", 0.0)], NODES)
    got = {(r["id"], r["branch"]): r for r in read(nodes, 3)}
    said = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert said == {
        (1, 1): [("user", "q"), ("assistant", "a"), ("user", "c")],
        (1, 2): [("user", "q"), ("assistant", "b<|im_end|>"), ("user", "d"), ("assistant", "e\\")],
        (1, 3): [("user", "lost parent")],
        (None, 1): [("user\n<|x", "alone")],
    }
    assert got[1, 2]["loss"] == "b<|im_end|>e\\" and got[None, 1]["loss"] == ""
    assert {(r["id"], r["branch"]) for r in read(nodes)} == {(1, 1), (None, 1)}


def test_long_chain_and_ties(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(300)] + [(8, 1, "user", "b"), (8, 1, "user", "a"), (8, 1, "user", "a"), (8, None, None, None), (None, 1, "user", "x")]
    nodes = linear_tree(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r["id"]: [t["text"] for t in r["turns"]] for r in read(nodes)}
    assert got == {7: [f"t{t}" for t in range(300)], 8: ["", "a", "a", "b"], None: ["x"]}
    assert read(linear_tree(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))) == []


PAGES = "page_id bigint, html string, id string, payload string, digest string, size string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], PAGES)


def test_archives(spark, tmp_path):
    rng = random.Random(13)
    gap = "P*M\x18\x00\x00\x00\x00"
    html = ["<p>" + " ".join(rng.choice("abcdef") * 3 for _ in range(rng.randrange(200))) for _ in range(300)]
    html += ["", None, gap * 3, "same page " * 9, "same page " * 9, "same page " * 9, "é" * 300000, "".join(chr(rng.randrange(32, 0x2000)) for _ in range(200000)), "ab", "ab"]
    rows = list(enumerate(html)) + [(None, "same page " * 9), (None, None), (5, html[5]), (9, "other")]
    df = pages(spark, rows)
    path = str(tmp_path / "a")
    write_archives(decide(df).repartition(3), path, sample_bytes=20_000)
    got = read_archives(spark, path).collect()
    payload = lambda h: (h or "").encode()
    same = {}
    for i, h in rows:
        same.setdefault(payload(h), []).append(-1 if i is None else i)
    want = []
    for i, h in rows:
        top = max(same[payload(h)])
        revisit = (-1 if i is None else i) != top
        digest = base64.b32encode(hashlib.sha1(payload(h)).digest()).decode()
        want.append((i, len(payload(h)), digest, "revisit" if revisit else "response", top if revisit else None, None if revisit else payload(h)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:5] + (r["payload"] and bytes(r["payload"]) if r["payload"] is not None else None,) for r in got), key=key) == sorted(want, key=key)
    for f in glob.glob(path + "/part-*"):
        data = open(f, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        whole = zstandard.ZstdDecompressor(dict_data=words).stream_reader(data, read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"\r\nWARC-Type: ") > 50


def test_small_payloads_are_never_revisits(spark):
    got = archive(pages(spark, [(1, "ab"), (2, "ab"), (3, "abc"), (4, "abc")]), least=3).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    assert archive(pages(spark, [])).count() == 0
