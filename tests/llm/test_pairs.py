import random

from pyspark.sql import functions as F

import splitframe.llm.decontaminate as decontamination
import splitframe.llm.jaccard as jaccard
from splitframe.llm.components import components
from splitframe.llm.decontaminate import decontaminate, leaks, tokens
from splitframe.llm.jaccard import jaccard_components, keep_one
from tests.llm.helpers import documents, empty, nasty


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(100, 140)]
    links = chain + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute(texts, k, percent):
    sets = shingle_sets(texts, k)
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, b in enumerate(sets):
        for i in range(j):
            a = sets[i]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return sets, [top(i) for i in range(len(texts))]


def near_copies(rng, n, edits):
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def corpus(rng):
    passage = " ".join(f"shared{i}" for i in range(30))
    texts = near_copies(rng, 90, 3) + near_copies(rng, 60, 9) + near_copies(rng, 12, 2)
    texts += [passage + " " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts += [" ".join(rng.choice("xyz") for _ in range(rng.randrange(12))) for _ in range(120)]
    texts += [texts[0]] * 9 + [texts[0].upper(), None, "", "one", "One", "one two"]
    rng.shuffle(texts)
    return texts


def test_jaccard_equals_brute_force(spark, monkeypatch):
    texts = corpus(random.Random(10))
    df = documents(spark, texts)
    for k, percent, frequent in ((3, 90, 32), (5, 80, 4), (3, 80, 2)):
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        sets, want = brute(texts, k, percent)
        got = {r["id"]: r for r in jaccard_components(df, k=k, percent=percent).collect()}
        assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        first = {}
        for i, s in enumerate(sets):
            assert got[i]["class_id"] == (first.setdefault(s, i) if s else i)
    kept = {r["doc_id"] for r in keep_one(df, k=3, percent=80).collect()}
    assert kept == set(want)


def test_columns_in_any_order_of_frequency(spark, monkeypatch):
    """With few columns allowed to go last, and broadcasts refused, the rows stay the same."""
    texts = corpus(random.Random(11))
    df = documents(spark, texts)
    want = {(r["id"], r["component_id"]) for r in jaccard_components(df).collect()}
    for name, value in (("FREQUENT", 1), ("LAST", 3), ("BROADCAST_IDS", 0)):
        monkeypatch.setattr(jaccard, name, value)
    assert {(r["id"], r["component_id"]) for r in jaccard_components(df).collect()} == want


def test_rows_of_long_lists_meet_once(spark, monkeypatch):
    """Long texts below the threshold share hundreds of columns, but meet at the first one only."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(2000)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(len(copy)), 60):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    met, meetings = [], jaccard._meetings
    monkeypatch.setattr(jaccard, "_meetings", lambda *a: met.append(meetings(*a)) or met[-1])
    got = {r["id"]: r["component_id"] for r in jaccard_components(documents(spark, texts), k=3, percent=80).collect()}
    assert got == dict(enumerate(brute(texts, 3, 80)[1]))
    pairs = 40 * 39 // 2
    assert pairs // 2 < met[-1].distinct().count() <= pairs
    assert met[-1].count() < 1.2 * pairs


def test_jaccard_edges(spark):
    got = jaccard_components(nasty(spark)).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[1] == by[2] == by[None] == {(4, 1)} and by[3] == {(0, 3)} and by[4] == {(0, 4)}
    kept = keep_one(nasty(spark))
    assert {r["_row"] for r in kept.collect()} == {"x", None}
    assert kept.columns == nasty(spark).columns and kept.count() == 11 - 4  # two copies of 2, the null id, and 7
    assert jaccard_components(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0


ITEM = "Maria buys 3 red apples and 4 green pears at the old market, then Maria gives 3 apples to Peter who walks 12 km home."
SAME = "said before. " + ITEM + " And so on."
OTHER = "well Susan buys 7 red apples and 9 green pears at the old market, then Susan gives 7 apples to Robert who walks 25 km home ok"
MIXED = "well Susan buys 7 red apples and 9 green pears at the old market, then Helen gives 8 apples to Robert who walks 25 km home ok"


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def test_tokens(spark):
    got = documents(spark, ["It costs 3.50 dollars, or 5kg; É Tom's x"]).select(tokens(F.col("text")).alias("t")).first()["t"]
    assert got == ["\x01ait", "costs", "\x01n3_50", "\x01udollars", "or", "\x01n5", "\x01ukg", "é", "\x01atom", "s", "x"]


def test_leaks_by_template_and_slots(spark):
    bench = items(spark, ITEM, "Short exact question here", "two words", None)
    part = " ".join(ITEM.split()[4:20])
    texts = [SAME, OTHER, MIXED, part, "some short Exact question here now", "short question here", "two words", None, "", "clean " * 500, ITEM.upper(), ITEM.lower()]
    got = {(r["row"] & 0xFFFF, r["item_id"]): r for r in leaks(documents(spark, texts).coalesce(1), bench).collect()}
    rows = documents(spark, texts).coalesce(1)
    assert {k for k in got} == {(0, 0), (1, 0), (3, 0), (4, 1), (10, 0), (11, 0)} and got[10, 0]["exact"]
    assert got[0, 0]["exact"] and not got[1, 0]["exact"] and got[0, 0]["covered"] == got[0, 0]["item_tokens"]
    kept = {r["doc_id"] for r in decontaminate(rows, bench).collect()}
    assert kept == {2, 5, 6, 7, 8, 9}
    short = items(spark, "a short but telling question")
    assert {r["row"] & 0xFFFF for r in leaks(documents(spark, ["x a short but telling question y", "short but telling"]).coalesce(1), short).collect()} == {0}


def leaked(spark, texts, *bench):
    """Numbers of the texts that repeat an item."""
    return {r["row"] & 0xFFFF for r in leaks(documents(spark, texts).coalesce(1), items(spark, *bench)).collect()}


def test_leaks_that_are_not_one_to_one(spark):
    cased = "The old keeper counts every lamp along the stony pier while The young keeper sleeps until dawn comes"
    assert leaked(spark, ["x " + cased.replace("while The", "while the") + " y"], cased) == {0}
    sums = "a farmer puts 3 boxes and 4 bags upon the cart and drives along the river to the mill"
    assert leaked(spark, [sums.replace("3", "5").replace("4", "5")], sums) == {0}
    roles = "a farmer puts 3 boxes upon the cart and takes 3 apples out before driving along the river to the mill"
    assert leaked(spark, [roles.replace("3 boxes", "4 boxes").replace("3 apples", "6 apples")], roles) == {0}
    long = "Maria walks along the quiet river every single morning before the sun comes up over the hills and then Maria goes home"
    other = long.replace("then Maria", "then Helen")
    assert leaked(spark, [other], long) == {0}
    assert leaked(spark, [MIXED], ITEM) == set()


def test_lists_of_other_numbers_or_names_are_no_leaks(spark):
    numbers = " ".join(map(str, range(100, 120)))
    names = "Ada Ben Cleo Dan Eva Finn Gus Hal Ina Jon Kim Leo Mia Ned Ola"
    others = ["7 " * 3 + " ".join(map(str, range(500, 900))), "Abe Bea Cal Dee Eli Fay Gil Hop Ivy Jay Kay Lou Max Nan Oz", " ".join(map(str, range(104, 400, 2)))]
    assert leaked(spark, [f"a {numbers} b", f"so {names} too", *others], numbers, names) == {0, 1}
    asked = "In which year did 12 ships with 340 sailors leave the harbour of Genoa for 3 months"
    assert leaked(spark, [asked.replace("12", "15").replace("340", "77").replace("Genoa", "Cadiz")], asked) == {0}


def test_leaks_around_words_put_in_or_left_out(spark):
    story = "a young keeper counts every lamp along the stony pier at dusk and then writes down each of their numbers inside a book"
    words = story.split()
    people = "Maria walks along the quiet river before sunrise and then Maria rests a while under an old oak"
    texts = [
        " ".join([*words[:12], "slowly", *words[12:]]),
        " ".join([*words[:11], *words[12:]]),
        "so " + people.replace("Maria", "Ana Lucia"),
        "so " + people.replace("then Maria", "then Ana Lucia").replace("Maria walks", "Helen walks"),
        " ".join([*words[:12], *["other"] * 60, *words[12:]]),
    ]
    assert leaked(spark, texts, story, people) == {0, 1, 2}


def test_leaks_of_every_benchmark_row(spark):
    texts = ["which planet has the largest moon", "the answer is a rocky giant", "no number stands for this item"]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (1, None)], "item_id bigint, text string")
    docs = documents(spark, texts + ["something else is said here"]).coalesce(1)
    assert {(r["row"], r["item_id"], r["exact"]) for r in leaks(docs, bench).collect()} == {(0, 1, True), (1, 1, True), (2, None, True)}


def test_leaks_edges(spark, monkeypatch):
    import splitframe.llm.decontaminate as d

    bench = items(spark, "one two three four five six", "long words follow each other here long words follow each")
    want = sorted(map(tuple, leaks(nasty(spark), bench).collect()))
    assert len({w[0] for w in want}) == 6
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, leaks(nasty(spark), bench).collect())) == want
    for docs, b in ((empty(spark), bench), (nasty(spark), items(spark))):
        assert leaks(docs, b).count() == 0 and decontaminate(docs, b).count() == docs.count()
    left = decontaminate(nasty(spark), bench)
    assert left.columns == nasty(spark).columns and {r["_row"] for r in left.collect()} <= {"x", None}


def test_windows_are_hashed_in_generated_code(spark):
    rows = spark.createDataFrame([(1, list("abcde")), (2, list("bcd")), (3, list("ab"))], "row bigint, tokens array<string>")
    windows = decontamination._windows(rows, "row", 3)
    assert "slice(" not in windows._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["row"], r["pos"]): r["h"] for r in windows.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0)}
    assert got[1, 1] == got[2, 0] and len(set(got.values())) == 3


def test_only_texts_with_enough_windows_are_tokenised_again(spark, monkeypatch):
    plans = {}

    def spied(df, label, *rest):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, label, *rest)

    written = decontamination.materialise
    monkeypatch.setattr(decontamination, "materialise", spied)
    item = "one long question about many small things that nobody ever asked before today at noon"
    docs = documents(spark, ["nothing of it", f"they said {item} and left"])
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert leaks(docs, items).count() == 1
    plan = plans["span-texts"]
    assert plan.index("regexp_replace") < plan.index("Join LeftSemi") and "regexp_replace" not in plan[plan.index("Join LeftSemi") :]
