import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from splitframe.llm import prefix_trie as trie
from splitframe.llm import repair
from splitframe.llm.queries import damaged, op12_prefix_trie, op13_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EXTRA = ("key", "conv", "pos", "place", "depth", "parent", "words", "block", "acts", "part", "_mid", "_part", "_start", "codes", "tie", "copy", "kind")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talk(n, seed, long=0):
    """Conversations that share beginnings, with nulls, ties, repeated rows and, if wanted, a long one."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, rng.choice(["Hello there.", "Yes", "No!", " \t", "a b\nc?", "", None])))
    for t in range(long):
        rows.append((n + 1, t, rng.choice(["user", "assistant", None]), rng.choice(["Hm.", f"word {t}.", "cut"])))
    rows += [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, "user", "other"), (None, 1, "user", "lost."), (20, 0, "user", "x" * 50_000 + ".")]
    return rows


def stored(spark, rows, folder):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in EXTRA})
    df.repartition(3).write.parquet(str(folder / "conversations.parquet"))
    return str(folder)


# -- prefix trie --------------------------------------------------------------------------


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", sha(text or ""), text or ""))
    convs = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    again = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, path in again.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(again[c]) == len(p))))
        out.append(
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), sum(q not in children for q in below), sum((len(members[q]) - 1) * words(q) for q in below), sha(ends))
        )
    return sorted(out, key=str)


def run_trie(spark, sf):
    return sorted((tuple(r) for r in op12_prefix_trie(spark, sf).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, tmp_path, monkeypatch, seed):
    rows = talk(70, seed, long=40)
    sf = stored(spark, rows, tmp_path)
    monkeypatch.setattr(trie, "FREQUENT", 6)
    # Short blocks: running sums go over several.
    monkeypatch.setattr(trie._running, "__defaults__", None)
    plain = trie._running
    monkeypatch.setattr(trie, "_running", lambda rows, by, at, sums, block: plain(rows, by, at, sums, 4))
    assert run_trie(spark, sf) == brute_trie(rows)


def test_trie_of_copies(spark, tmp_path):
    rows = [(c, t, "user", f"said {t}") for c in range(0, 400, 2) for t in range(2)] + [(401, 0, "user", "said 0")]
    sf = stored(spark, rows, tmp_path)
    assert run_trie(spark, sf) == brute_trie(rows)


def test_trie_of_turnless_and_empty(spark, tmp_path):
    # One turn each, which the rebuild takes away, and no conversation to lend any.
    lost = [c for c in range(1, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0]
    sf = stored(spark, [(c, 0, "user", "alone") for c in lost], tmp_path / "a")
    got = run_trie(spark, sf)
    assert got == [(min(lost), 0, None, len(lost), 0, 1, 0, sha(",".join(map(str, lost))))]
    assert run_trie(spark, stored(spark, [], tmp_path / "b")) == []


# -- repair -------------------------------------------------------------------------------


def damage(rows):
    blank = lambda x: " " if x is None else str(x)
    out = {}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, blank(r[2]) + ":" + sha(blank(r[3]))))
    for c, turn, role, text in order:
        role, text = blank(role), blank(text)
        kind = zlib.crc32(f"{blank(c)}:{blank(turn)}".encode()) % 20
        held = out.setdefault(c, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return out


def cheapest(rows, faults):
    """Least (cost, edits, result) by a forward search over states."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def relax(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(3):
            for s, (c, e, said) in list(table.items()):
                relax(table, after[s], (c + 3, e + "I", said + (full[after[s]] + ":",)))

    for (_, role, text), fault in zip(rows, faults):
        inserted(best)
        new = {}
        for s, (c, e, said) in best.items():
            relax(new, s, (c + 4, e + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (role[:1] == "s" and s == "") or role[:1] == after[s]:
                relax(new, role[:1], (c + more, e + "K", said + (f"{role}:{text}",)))
            relax(new, after[s], (c + 3 + more, e + "R", said + (f"{full[after[s]]}:{text}",)))
        best = new
    inserted(best)
    return min((v for s, v in best.items() if s in ("", "a")), key=lambda v: v[:2])


def brute_repair(rows):
    out = []
    for c, held in damage(rows).items():
        faults, seen = [], set()
        for _, role, text in held:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        cost, edits, said = cheapest(held, faults)
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, sha("\n".join(said))))
    return sorted(out, key=str)


def run_repair(spark, sf):
    return sorted((tuple(r) for r in op13_repair(spark, sf).collect()), key=str)


def test_repair_by_brute_force(spark, tmp_path):
    rows = talk(150, 4, long=700)
    assert run_repair(spark, stored(spark, rows, tmp_path)) == brute_repair(rows)


@pytest.mark.parametrize("chunk, passes", [(1, 4), (3, 0), (3, 1), (7, 4)])
def test_chunks_give_the_same(spark, tmp_path, chunk, passes):
    # Conversation 5 has roles that cannot stay: costs only swap, and no vectors become parallel.
    rows = talk(20, 6, long=50) + [(5, 100 + t, "tool", f"{t}.") for t in range(33)]
    sf = stored(spark, rows, tmp_path)
    turns = damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    got = {r["conv"]: (r["cost"], r["audit"], r["repaired_sha256"]) for r in repair.repair_report(turns, chunk, passes).collect()}
    assert got == {"" if r[0] is None else str(r[0]): r[6:] for r in brute_repair(rows) if r[7]}


def test_repair_of_nothing(spark, tmp_path):
    assert run_repair(spark, stored(spark, [], tmp_path / "a")) == []
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = run_repair(spark, stored(spark, [(c, 0, "user", "x") for c in gone], tmp_path / "b"))
    assert got == sorted(((c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in gone), key=str)


def test_repaired_turns(spark):
    rows = [("1", 0, "user", "Hi.", "", 0), ("1", 1, "user", "cut", "", 0), ("1", 2, "assistant", "Yes.", "", 0)]
    turns = spark.createDataFrame(rows, "conv string, turn bigint, role string, text string, tie string, copy int")
    edits = repair.repair_edits(turns).collect()
    assert "".join(r["edit"] for r in edits) == "KDK" and sum(r["cost"] for r in edits) == 4
    assert [(r["role"], r["text"]) for r in edits if r["role"]] == [("user", "Hi."), ("assistant", "Yes.")]
