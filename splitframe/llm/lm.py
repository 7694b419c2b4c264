"""Language-model scores by a weighted backoff automaton over words, pairs and triples.

States are the contexts that training texts hold: the empty one, single words, and pairs of adjacent
words. A state has an arc for every word that followed it, to the longest context that ends there,
and a failure arc to the context without its first word. Reading a word adds the weights of the
failure arcs taken and of the arc found, so arcs that training never saw cost nothing to keep.

The automaton has no bound, so no task holds it: the corpus is cut into blocks, and each block asks
for the counts of its own n-grams, which are all the arcs and states that its texts can meet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import Vocabulary, mixed

_NONE = float("inf")
#: Strengths that training chooses from: how much weight, in counts, the shorter context has in
#: contexts of one word and of two; infinity means that the longer context is not used.
STRENGTHS = ((4.0, 1.0), (16.0, 4.0), (64.0, 16.0), (128.0, 32.0), (256.0, 64.0), (1024.0, 256.0), (128.0, _NONE), (_NONE, _NONE))
#: Hash of the end of a text, which is no word.
END = np.uint64(xxhash.xxh64_intdigest(b" "))
#: Tokens, at least two, that one traversal reads one after the other; the pieces of a block advance together.
PIECE = 256
#: Tokens, in whole texts, that are weighed at a time.
SLICE = 1 << 17


def _packed(keys: np.ndarray) -> bytes:
    """Sorted hashes by their differences, byte planes together."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstd.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and how often each occurs."""
    every = np.sort(hashes)
    first = np.ones(len(every), bool)
    first[1:] = every[1:] != every[:-1]
    at = np.flatnonzero(first)
    return every[at], np.diff(np.append(at, len(every)))


def _press(numbers: np.ndarray) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(numbers.astype(np.int64).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zstd.decompress(data), np.int64)


@dataclass
class _Block:
    """The tokens of the texts of a block, one text after the other, each closed by its end."""

    tokens: list[np.ndarray] = field(default_factory=list)
    train: list[bool] = field(default_factory=list)
    known: Vocabulary = field(default_factory=Vocabulary)

    def add(self, text: bytes, train: bool) -> None:
        numbers = self.known.numbers(text.lower().split())
        self.tokens.append(np.append(self.known.hashes[numbers], END))
        self.train.append(train)

    def grams(self) -> list[np.ndarray]:
        """Hashes of the word, pair and triple that end at each token; the last only at ``deep`` ones.

        The end before a text is the start of the next one, and no context reaches beyond it.
        """
        self.sizes = np.array([len(t) for t in self.tokens])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        words = np.concatenate(self.tokens)
        self.tokens, self.known = [], Vocabulary()
        self.learnt = np.repeat(np.array(self.train), self.sizes)
        self.ends = words == END
        before = np.concatenate([[END], words[:-1]])
        self.deep = np.flatnonzero(before != END)
        pairs = mixed(before, words)
        return [words, pairs, mixed(pairs[self.deep - 1], words[self.deep])]

    def keys(self):
        """For words, pairs and triples: the sorted hashes, and their counts in training texts."""
        every = self.grams()
        for kind in range(3):
            hashes, every[kind] = every[kind], None
            learnt, counts = _distinct(hashes[self.learnt if kind < 2 else self.learnt[self.deep]])
            keys, _ = _distinct(hashes)
            out = np.zeros(len(keys), np.int64)
            out[np.searchsorted(keys, learnt)] = counts
            yield keys, out


class _Automaton:
    """The part of the automaton that the texts of a block can meet.

    Arcs are kept by the place where a text meets them: ``arcs[d][i]`` counts the n-gram of d + 1 words
    that ends at token i, which is the arc of the token from its context of d words, and the state
    that this arc leads to. An n-gram without a count is neither arc nor state.
    """

    def __init__(self, texts: _Block, totals: list[np.ndarray]):
        self.arcs = []
        for kind, hashes in enumerate(texts.grams()):
            keys, at = np.unique(hashes, return_inverse=True)
            if len(keys) != len(totals[kind]):
                raise ValueError("the table of documents changed while it was read")
            found = totals[kind][at]
            if kind == 2:
                found, met = np.zeros(len(texts.ends), np.int64), found
                found[texts.deep] = met
            self.arcs.append(found)
        self.ends = texts.ends

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """Depth of the state that each token is read in, and of the context whose arc reads it (-1: none).

        One pass from left to right carries the state. The automaton is in the same state after two
        tokens wherever it started, so a block is read in pieces of ``PIECE`` tokens, each after the two
        tokens before it, and the pieces advance together.
        """
        n = len(self.ends)
        width = -(-n // PIECE)
        entered, taken = np.zeros(n, np.int8), np.zeros(n, np.int8)
        # The first piece starts in the state after an end.
        depth = np.zeros(width, np.int8)
        depth[0] = self.first
        for step in range(-2, PIECE):
            at = np.arange(width) * PIECE + step
            live = (at >= 0) & (at < n)
            at, d = at[live], depth[live]
            arc = d.copy()
            for context in (2, 1, 0):
                arc[(arc == context) & (self.arcs[context][at] == 0)] -= 1  # the failure arc
            if step >= 0:
                entered[at], taken[at] = d, arc
            # An arc from the empty context leads to the word's state, longer ones to the pair's; after an end, nothing but it matters.
            depth[live] = np.where(self.ends[at], np.minimum(arc + 1, 1), np.minimum(arc + 1, 2))
        return entered, taken

    @property
    def first(self) -> int:
        """Depth of the state after an end: 0 if training texts have none."""
        return int((self.arcs[0][self.ends] > 0).any())

    def weigh(self, starts: np.ndarray, learnt: np.ndarray, mass: float) -> tuple[np.ndarray, ...]:
        """Sums over each text: tokens known, log10(count + 1), and log10 probabilities for each
        strength, from all counts and, over training texts, with the token itself left out.

        With counts c and strengths j and k, the arc of w from the empty context weighs
        p(w) = (c(w) + 1) / mass, from v p(w|v) = (c(vw) + j p(w)) / (c(v) + j), and from uv
        (c(uvw) + k p(w|v)) / (c(uv) + k). The failure arcs of v and uv weigh j / (c(v) + j) and
        k / (c(uv) + k). Probabilities are products of weights.
        """
        word, pair, _ = self.arcs
        # Counts of the states; after an end there is no longer one.
        one = np.concatenate([[word[self.ends][-1]], word[:-1]])
        two = np.concatenate([[0], np.where(self.ends, 0, pair)[:-1]])
        every = (*self.arcs, one, two, *self.traverse(), learnt)
        first = np.flatnonzero(np.diff(starts // SLICE, prepend=-1))
        parts = []
        for a, b in zip(first, [*first[1:], len(starts)]):
            i, j = starts[a], starts[b] if b < len(starts) else len(word)
            parts.append(_weigh(*(x[i:j] for x in every), starts[a:b] - i, mass))
        return tuple(np.concatenate(x) for x in zip(*parts))


def _weigh(word, pair, triple, one, two, entered, taken, learnt, starts, mass: float) -> tuple[np.ndarray, ...]:
    """``_Automaton.weigh`` for a run of texts; ``one`` and ``two`` count the states they are read in."""
    single = (word + 1) / mass
    total = lambda x: np.add.reduceat(x, starts)
    scores, left_out = [], []
    for j, k in STRENGTHS:
        weight, fails, other = single, np.ones(len(word)), single
        for d, strength, arcs, state in ((1, j, pair, one), (2, k, triple, two)):
            if strength == _NONE:
                continue
            weight = np.where(taken >= d, (arcs + strength * weight) / (state + strength), weight)
            fails = np.where((entered >= d) & (taken < d), fails * strength / (state + strength), fails)
            other = (np.maximum(arcs - 1, 0) + strength * other) / (np.maximum(state - 1, 0) + strength)
        scores.append(total(np.log10(weight * fails)))
        left_out.append(total(np.log10(other) * learnt))
    return total((word > 0).astype(np.int64)), total(np.log10(word + 1)), np.stack(scores, 1), np.stack(left_out, 1)


def _asks(buckets: int):
    """For each block: its keys and counts by bucket of their hashes. Rows of a block follow each other."""

    def rows_of(block: int, texts: _Block):
        edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
        out = []
        for kind, (keys, counts) in enumerate(texts.keys()):
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            out += [(kind, b, block, _packed(keys[i:j]), _press(counts[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        names = ["kind", "bucket", "block", "keys", "counts"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    def asks(batches):
        block, texts = None, None
        for batch in batches:
            for b, train, text in zip(*(batch.column(i) for i in range(3))):
                if b.as_py() != block:
                    if texts:
                        yield rows_of(block, texts)
                    block, texts = b.as_py(), _Block()
                texts.add(text.as_py(), train.as_py())
        if texts:
            yield rows_of(block, texts)

    return asks


def _answers(batches):
    """Sum the counts of each bucket, and give each block those of its keys, in its order.

    Rows come sorted by (kind, bucket). Also a row for each bucket, without a block: the number
    of keys with a count and the sum of counts.
    """
    names = ["kind", "bucket", "block", "totals", "types", "tokens"]
    schema = pa.schema(list(zip(names, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))))

    def close(kind, bucket, held):
        keys, counts = [k for _, k, _ in held], np.concatenate([c for _, _, c in held])
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, counts, minlength=len(found)).astype(np.int64)
        out, start = [(kind, bucket, None, None, int((sums > 0).sum()), int(sums.sum()))], 0
        for block, k, _ in held:
            out.append((kind, bucket, block, _press(sums[at[start : start + len(k)]]), None, None))
            start += len(k)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    now, held = None, []
    for batch in batches:
        for kind, bucket, block, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (kind, bucket) != now:
                if held:
                    yield close(*now, held)
                now, held = (kind, bucket), []
            held.append((block, _unpacked(keys), _numbers(counts)))
    if held:
        yield close(*now, held)


def _scores(mass: float):
    """Texts of a block, then the counts it asked for, give the scores of its texts."""
    names = ["id", "held_out", "n_tokens", "n_known", "known", "scores", "left_out"]

    def close(ids, held, texts, counts):
        met = _Automaton(texts, [np.concatenate([np.empty(0, np.int64), *c]) for c in counts])
        known, logs, scores, left_out = met.weigh(texts.starts, texts.learnt, mass)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(STRENGTHS)).cast(pa.list_(pa.float64())) for x in (scores, left_out)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(texts.sizes.astype(np.int64)), pa.array(known), pa.array(logs), *lists], names=names)

    def scored(batches):
        now, state = None, None
        for batch in batches:
            for block, kind, id_, held, text, totals in zip(*(batch.column(i) for i in (0, 1, 3, 4, 5, 6))):
                if block.as_py() != now:
                    if state:
                        yield close(*state)
                    now, state = block.as_py(), ([], [], _Block(), ([], [], []))
                ids, helds, texts, counts = state
                if kind.as_py() < 0:
                    ids.append(id_.as_py())
                    helds.append(held.as_py())
                    texts.add(text.as_py(), not held.as_py())
                else:
                    counts[kind.as_py()].append(_numbers(totals.as_py()))
        if state:
            yield close(*state)

    return scored


def score_corpus(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20, bucket_bytes: int = 3 << 20
) -> DataFrame:
    """Train on the rows of ``docs`` that are not ``held_out`` and score all of them.

    Gives (id, held_out, n_tokens, n_known, train_tokens, base_score, score). Tokens are words,
    A to Z lower-cased, and one end for each text. ``base_score`` is the add-one unigram model's
    log10 probability, ``score`` that of the automaton, with the strengths of smoothing under which
    training tokens, each left out in turn, are likeliest; pairs alone and words alone are among
    the choices.

    A null or empty text has only its end; a null ``held_out`` counts as held out. Without
    training rows the base gives every token one. Rows may repeat. ``docs`` should be a stored
    table: its rows' places make the blocks, of about ``block_bytes`` of text. Counts are summed in
    buckets for about ``bucket_bytes`` of text, so a task holds one block or one bucket.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        text.alias("text"),
    )
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    size = size or 0
    rows_a_block = max(0, min(14, int(np.log2(max(1.0, block_bytes * max(n, 1) / max(size, 1))))))
    buckets = max(64, size // bucket_bytes)
    placed = rows.withColumn("block", F.shiftright("row", rows_a_block))
    asked = placed.select("block", (~F.col("held_out")).alias("train"), "text").mapInArrow(
        _asks(buckets), "kind int, bucket int, block bigint, keys binary, counts binary"
    )
    answers = (
        asked.repartition("kind", "bucket")
        .sortWithinPartitions("kind", "bucket", "block")
        .mapInArrow(_answers, "kind int, bucket int, block bigint, totals binary, types bigint, tokens bigint")
    )
    answers = materialise(answers, "counts")
    types, tokens = answers.where("kind = 0 and block is null").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = types or 0, tokens or 0
    mass = float(tokens + types + 1)
    none = lambda kind: F.lit(None).cast(kind)
    texts = placed.select("block", F.lit(-1).alias("kind"), F.lit(-1).alias("bucket"), "id", "held_out", "text", none("binary").alias("totals"))
    given = answers.where("block is not null").select(
        "block", "kind", "bucket", none("bigint").alias("id"), none("boolean").alias("held_out"), none("binary").alias("text"), "totals"
    )
    scored = (
        texts.unionByName(given)
        .repartition("block")
        .sortWithinPartitions("block", "kind", "bucket")
        .mapInArrow(
            _scores(mass), "id bigint, held_out boolean, n_tokens bigint, n_known bigint, known double, scores array<double>, left_out array<double>"
        )
    )
    scored = materialise(scored, "scores")
    sums = scored.where(~F.col("held_out")).agg(*[F.sum(F.col("left_out")[i]) for i in range(len(STRENGTHS))]).first()
    best = len(STRENGTHS) - 1 if sums[0] is None else max(range(len(STRENGTHS)), key=lambda i: sums[i])
    return scored.select(
        "id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("known") - F.col("n_tokens") * F.lit(float(np.log10(mass)))).alias("base_score"),
        F.col("scores")[best].alias("score"),
    )
