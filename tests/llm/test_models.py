import math
import random
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import splitframe.llm.lm as lm
from splitframe.llm.common import bucket
from splitframe.llm.quality import fit_quality, train_ftrl, word_shape
from splitframe.llm.queries import QUERIES
from splitframe.llm.common import Vocabulary
from splitframe.llm.toxicity import Automaton, _Cache, _Hits, _marks, evidence, fit_toxicity, learn, plain_words, quoted, words_of
from tests.llm.helpers import documents, empty, nasty


def test_buckets(spark):
    got = spark.range(200).select("id", bucket(7, "id").alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


def accuracy(spark, sf, name, label):
    scored = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    return scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_quality_on_held_out_labels(spark):
    assert accuracy(spark, "/root/testdata/sf0.01", "op2_quality", "quality") > 0.95


def test_toxicity_on_held_out_labels(spark):
    assert accuracy(spark, "/root/testdata/sf0.01", "op6_toxicity", "toxic") > 0.93


def test_ftrl_separates():
    rng = random.Random(5)
    rows = [(np.array(sorted({y, *(rng.randrange(2, 50) for _ in range(3))})), np.ones(4)[: len({y})], y) for y in (0, 1) for _ in range(5)]
    rows = [(a, np.ones(len(a)), y) for a, _, y in rows] * 5
    w, b = train_ftrl(rows, 50)
    assert all((w[a].sum() + b > 0) == bool(y) for a, _, y in rows)


def test_shapes():
    assert [word_shape(x.encode()) for x in ("Word", "WORD!!!", "é9-", "***", "")] == ["Aaa", "AA!!", "a9-", "**", ""]


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (6, None), (8, 0)], "id bigint, label int")
    none = spark.createDataFrame([], "id bigint, label int")
    for fit in (fit_quality, fit_toxicity):
        for known in (labels, none):
            got = nasty(spark).withColumn("p", fit(nasty(spark), known).score(F.col("text"))).collect()
            assert len(got) == 11 and all(0 <= r["p"] <= 1 for r in got)
        assert empty(spark).withColumn("p", fit(empty(spark), none).score(F.col("text"))).count() == 0


def edits(a, b):
    """Inserted, lost, changed and swapped letters."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = ["abcab", "bbbbb", "abc", "acbabca"]
    for automaton in (Automaton(terms, ["cac"]), Automaton(terms, ["cac"], most_states=5)):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(4000)]
        for w in words:
            want = 2 if w in terms or w.startswith("cac") else int(any(len(t) > 4 and edits(t, w) < 2 for t in terms))
            assert automaton.match(w) == want, w


def test_misspelt_terms_and_quotations(spark):
    rng = random.Random(7)
    plain = [" ".join(rng.choice("alpha beta gamma delta river stone".split()) for _ in range(20)) for _ in range(80)]
    rows = [(p.encode(), 0) for p in plain[:60]] + [((p + " you scoundrel").encode(), 1) for p in plain[60:]]
    model = learn(rows)
    assert "scoundrel" in model.terms or "scoun" in " ".join(model.stems)
    model = learn(rows + [((p + " rascals").encode(), 1) for p in plain[:20]])
    texts = ["a rascals here", "a racsals here", 'they said "rascals" to us', "nothing here", None]
    got = [r["p"] for r in documents(spark, texts).select(model.score(F.col("text")).alias("p")).collect()]
    assert got[0] > 0.5 and got[3] < 0.5 and got[4] < 0.5
    words = 'she wrote “you rascals” and left'.encode().split()
    assert quoted(words, 3) and not quoted("you rascals are here".encode().split(), 1)


def predicted(model, text):
    return float(np.dot(evidence(text.encode(), _Hits(model)), model.weights)) >= 0


def said(rng, n):
    return [" ".join(rng.choice("alpha beta gamma delta river stone".split()) for _ in range(20)) for _ in range(n)]


def test_plain_words_are_those_not_quoted():
    rng = random.Random(12)
    for _ in range(60):
        words = [rng.choice(["a", "b", "c", '"d', 'e".', "said", "f", "g"]).encode() for _ in range(rng.randrange(40))]
        assert plain_words(words, _Cache(_marks)) == {w for i, w in enumerate(words) if not quoted(words, i)}


def test_terms_that_clean_texts_quote():
    rng = random.Random(13)
    rows = [((p + " you scoundrel go away").encode(), 1) for p in said(rng, 60)]
    rows += [((p + ' they yelled "scoundrel" at us').encode(), 0) for p in said(rng, 30)] + [(p.encode(), 0) for p in said(rng, 90)]
    model = learn(rows)
    assert predicted(model, "the scoundrel is here") and not predicted(model, 'somebody yelled "scoundrel" at us')


def test_misspelt_terms_among_ordinary_words():
    rng = random.Random(14)
    texts = said(rng, 150)
    rows = [((p + " you " + t).encode(), 1) for p, t in zip(texts[:90], ["clown", "scum", "loser"] * 30)]
    rows += [((p + " you see a crown blown closer or lower to scam the sum").encode(), 0) for p in texts[90:]]
    model = learn(rows)
    assert {"clown", "scum", "loser"} <= set(model.terms)
    assert all(predicted(model, "what a " + w) for w in ("clwon", "losser", "scumm", "clown"))
    assert not any(predicted(model, "what a " + w) for w in ("crown", "closer", "scam", "sum"))


def test_long_runs_are_read_whole():
    rng = random.Random(15)
    rows = [((p + " you scoundrel").encode(), 1) for p in said(rng, 60)] + [(p.encode(), 0) for p in said(rng, 60)]
    model = learn(rows)
    for joint in ("\u00a0", "\u3000", "/", ".", "-", "<br>"):
        run = joint.join(["river", "stone"] * 90)
        for term, kind in (("scoundrel", 2), ("scuondrel", 1), ("s.c.o.u.n.d.r.e.l", 2), ("river", 0)):
            words = words_of((run + joint + term + joint + run).encode())
            assert max(_Hits(model).of(words)) == kind, (joint, term)
        assert predicted(model, run + joint + "scoundrel" + joint + run) and not predicted(model, run)
    joined = [("\u00a0".join((p * 4 + " you rascal").split()).encode(), 1) for p in said(rng, 60)]
    assert predicted(learn(joined + [(p.encode(), 0) for p in said(rng, 60)]), "a rascal")
    assert word_shape(b"ab/" * 40 + b"99") == "aa/" * 40 + "99"


def test_one_law_for_runs_of_any_length():
    rng = random.Random(16)
    rows = [((p + " you scoundrel").encode(), 1) for p in said(rng, 60)] + [(p.encode(), 0) for p in said(rng, 60)]
    model = learn(rows)
    for joint in ("/", "\u00a0", ".", "-", "\u200b"):
        for n in range(1, 60):
            assert evidence(joint.join(["scoundrel"] * n).encode(), _Hits(model))[1] == 1 - 0.5**n, (joint, n)
            kept = joint.join(["river"] * n)
            for text, want in ((f"he said: scoundrel{joint}{kept}", (0, 0.5)), (f"{kept}{joint}scoundrel{joint}{kept}", (0.5, 0))):
                got = evidence(text.encode(), _Hits(model))
                assert (got[1], got[3]) == want, text
    for spelt in ("scoun-drel", "sc-oun-drel", "scoun\u200bdrel", "s-c-o-u-n-d-r-e-l"):
        for run in (spelt, "river/" + spelt, "/".join(["river"] * 90 + [spelt])):
            assert evidence(run.encode(), _Hits(model))[1:] == (0.5, 0, 0), run
    assert [w.decode() for w in words_of("don't it’s «a-b» ... x".encode())] == ["don't", "it\0s", "s", "«a-\0b»", "b»", "...", "x"]


def test_vocabulary_is_bounded_by_words_and_bytes():
    words = Vocabulary(limit=10, most_bytes=100)
    for text in ([b"a"] * 5, [bytes([65 + i]) for i in range(12)], [b"x" * 200], [b"y", b"x" * 200, b"y"]):
        numbers = words.numbers(text)
        assert [int(words.hashes[n]) for n in numbers] == [xxhash.xxh64_intdigest(w) for w in text]
        assert words.lengths[numbers].tolist() == [len(w) for w in text]
    assert len(words) == 2 and words.held == 201


def brute(texts, train):
    words = [(t or "").lower().split() + [None] for t in texts]
    counts = Counter()
    for w, t in zip(words, train):
        line = [None, *w]
        if t:
            counts.update((x,) for x in w)
            counts.update(zip(line, w))
            counts.update(zip(line, w, w[1:]))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    mass = n + sum(len(g) == 1 for g in counts) + 1

    def likely(gram, strengths):
        """By the recursion over contexts, without states or arcs."""
        if len(gram) == 1:
            return (counts[gram] + 1) / mass
        shorter, k = likely(gram[1:], strengths), strengths[len(gram) - 2]
        return shorter if k == math.inf else (counts[gram] + k * shorter) / (counts[gram[:-1]] + k)

    out = []
    for w in words:
        line = [None, *w]
        grams = [tuple(line[max(0, i - 2) : i + 1]) for i in range(1, len(line))]
        by = [sum(math.log10(likely(g, s)) for g in grams) for s in lm.STRENGTHS]
        out.append((len(w), sum(counts[x,] > 0 for x in w), n, sum(math.log10(likely((x,), None)) for x in w), by))
    return out


def test_lm_equals_brute_force(spark):
    rng = random.Random(8)
    said = ["the cat sat on the mat", "A Dog ran", "to be or not"]
    texts = [" ".join([rng.choice(said), *(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))]) for _ in range(400)] + ["", None]
    df = documents(spark, texts)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    want = brute(texts, train)
    for size in (1 << 24, 400):
        got = {r["id"]: r for r in lm.score_corpus(df, bucket(7) == 2, block_bytes=size).collect()}
        chosen = {min(range(len(lm.STRENGTHS)), key=lambda i: abs(w[4][i] - got[k]["score"])) for k, w in enumerate(want) if w[0] > 5}
        assert len(chosen) == 1
        i = chosen.pop()
        for k, w in enumerate(want):
            r = got[k]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (*w[:3], not train[k])
            assert abs(r["base_score"] - w[3]) < 1e-8 and abs(r["score"] - w[4][i]) < 1e-8
    held = [k for k, t in enumerate(train) if not t]
    assert sum(got[k]["score"] for k in held) > sum(got[k]["base_score"] for k in held)


def test_lm_traversal_is_an_automaton(monkeypatch):
    """States, arcs and failure arcs as dictionaries, one token after the other, against the traversal in pieces."""
    import numpy as np

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([0, 1, 2, 3, 40, 90]))) for _ in range(120)]
    train = [rng.random() < 0.4 for _ in texts]
    counts = Counter()
    for text, learnt in zip(texts, train):
        line = ["$", *text.split(), "$"]
        if learnt:
            counts.update((w,) for w in line[1:])
            counts.update(zip(line, line[1:]))
            counts.update(zip(line, line[1:], line[2:]))
    entered, taken = [], []
    for text in texts:
        state = ("$",)
        for w in [*text.split(), "$"]:
            entered.append(len(state))
            while state and not counts[*state, w]:
                state = state[1:]
            taken.append(len(state) if counts[*state, w] else -1)
            state = (*state, w) if counts[*state, w] else ()
            while len(state) > 2 or (len(state) == 2 and w == "$"):
                state = state[1:]

    def block():
        made = lm._Block()
        for text, learnt in zip(texts, train):
            made.add(text.encode(), learnt)
        return made

    totals = [c for _, c in block().keys()]
    whole = None
    for piece, part in ((256, 1 << 17), (5, 1), (2, 60), (10**6, 7)):
        monkeypatch.setattr(lm, "PIECE", piece)
        monkeypatch.setattr(lm, "SLICE", part)
        now = block()
        met = lm._Automaton(now, totals)
        got = met.traverse()
        assert got[0].tolist() == entered and got[1].tolist() == taken
        weighed = met.weigh(now.starts, now.learnt, 500.0)
        whole = whole or weighed
        assert all(np.allclose(x, y) for x, y in zip(whole, weighed)) and len(weighed[0]) == len(texts)
    assert {0, 1, 2} <= set(taken) and any(a < b for a, b in zip(taken, entered))


def test_lm_edges(spark):
    got = lm.score_corpus(nasty(spark), bucket(7) == 2).collect()
    assert len(got) == 11 and {r["n_tokens"] for r in got if r["id"] in (3, 4, 5)} == {1}
    assert lm.score_corpus(empty(spark), bucket(7) == 2).count() == 0
    assert all(r["base_score"] == 0 for r in lm.score_corpus(nasty(spark), F.lit(True)).collect())


def test_quality_features_by_plain_python():
    import math
    import re
    import unicodedata
    from collections import Counter

    import numpy as np
    import xxhash

    from splitframe.llm import quality

    full = 2**64

    def mix(a, b):
        x = (a * 0x9E3779B97F4A7C15 + b) % full
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 % full
        return x ^ (x >> 32)

    def shape(word):
        kinds = ""
        for c in word.decode("utf-8", "replace"):
            kind = unicodedata.category(c)
            kinds += "A" if kind == "Lu" else "a" if kind[0] in "LM" else "9" if kind[0] == "N" else c
        return re.sub(r"(.)\1+", r"\1\1", kinds, flags=re.DOTALL)

    def plain(text, bits):
        words = text.split()
        h = [xxhash.xxh64_intdigest(w.lower()) for w in words]
        s = [xxhash.xxh64_intdigest(shape(w).encode(), 3) for w in words]
        s = [x ^ 0x5851F42D4C957F2D if i and words[i] == words[i - 1] else x for i, x in enumerate(s)]
        two = [mix(a, b) for a, b in zip(s, s[1:])]
        grams = [h, [mix(a, b) for a, b in zip(h, h[1:])], s, two, [mix(a, b) for a, b in zip(two, s[2:])]]
        out = Counter()
        for kind, found in enumerate(grams):
            for key, n in Counter((g + kind) % full >> (64 - bits) for g in found).items():
                out[key] += math.sqrt(n / len(found))
        return dict(out)

    texts = ["One two two  THREE\n3.5 aaab", "é É Ⅷ ½ \U0001f600\U0001f600\U0001f600 x", "one", "", " \t", "word/" * 5000 + " end", "a b " * 400]
    weights = np.random.default_rng(1).normal(size=1 << 12)
    words = quality._Words()
    words.limit = 5
    for text in [t.encode() for t in texts * 2]:
        at, values = quality.features(text, words, 12)
        want = plain(text, 12)
        assert at.tolist() == sorted(want) and np.allclose(values, [want[k] for k in sorted(want)])
        assert np.isclose(weights[at] @ values, sum(weights[k] * v for k, v in want.items()))
