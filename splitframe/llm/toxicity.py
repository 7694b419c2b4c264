"""Toxic terms and their misspellings, and what stands around them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import sample_labelled

#: Labelled rows that a model is fitted on at most.
LABELLED = 6_000
#: Words of a stem's length; words before and after a term that are looked at.
STEMS, WINDOW = range(3, 8), 8
#: Letters of a term from which on misspellings are matched: of three, most short words would be one.
FUZZY = 4

# Quotation marks, and words that report what others say.
OPENING, CLOSING = "\"'“„«‘`", "\"'”“»’`"
REPORTING = frozenset("said says say wrote writes called calls quoted quote quoting word term slur insult".split())

#: Bytes of the longest word that a vocabulary keeps; longer ones are looked at anew each time.
CACHED = 400
#: Pieces of a run that may be one word spelt apart; between a piece and those after it stands ``NEXT``.
JOINED, NEXT = 4, b"\0"

_CORE = regex.compile(r"[\p{L}\p{M}\p{N}]+")
# A word spelt with a mark after each letter, or a word, with the marks around it.
_PIECE = regex.compile(r"[\p{P}\p{S}]*+(?:(?<![\p{L}\p{M}\p{N}])(?:\p{L}\p{M}*+[\p{P}\p{S}]){2,}\p{L}\p{M}*+(?![\p{L}\p{M}\p{N}])|[\p{L}\p{M}\p{N}]++)[\p{P}\p{S}]*+")


# One ASCII word with marks around it, or an apostrophe in it and no other marks.
_ONE = re.compile(rb"[!-/:-@\[-`{-~]*[0-9A-Za-z]+[!-/:-@\[-`{-~]*|[0-9A-Za-z]+'[0-9A-Za-z]+[.,;:!?]?").fullmatch


def words_of(text: bytes) -> list[bytes]:
    """Each word of a text, in order, also of runs joined by other space than ASCII or by marks.

    A run gives its pieces, whatever its length. A piece is followed by the next ones of its run, up
    to ``JOINED`` in all, as they may spell one word apart; apostrophes between two pieces are
    left out, as they quote nothing. Runs without letters and digits stay as they are.
    """
    out = []
    for w in text.split():
        if _ONE(w):
            out.append(w)
        else:
            out += _short_pieces(w) if len(w) <= CACHED else _pieces(w)
    return out


def _pieces(run: bytes) -> list[bytes]:
    found = list(_PIECE.finditer(run.decode("utf-8", "replace")))
    pieces = [m.group() for m in found]
    for i, (a, b) in enumerate(zip(found, found[1:])):
        if a.end() == b.start() and pieces[i][-1] in "'’" and _CORE.match(pieces[i][-2:-1]):
            pieces[i] = pieces[i][:-1]
    pieces = [p.encode() for p in pieces]
    return [NEXT.join(pieces[i : i + JOINED]) for i in range(len(pieces))] or [run.replace(NEXT, b" ")]


_short_pieces = lru_cache(10_000)(_pieces)


class Automaton:
    """Levenshtein automata of all terms at once: sets of (trie node, edits) are its states.

    States are made as words ask for them. A term of ``fuzzy_from`` letters or more also accepts
    one inserted, lost, changed or swapped letter; a stem accepts any word
    that begins with it.
    """

    def __init__(self, terms: list[str], stems: list[str], fuzzy_from: int = 5, most_states: int = 50_000):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]
        self.most_states = most_states
        for words, mark in ((terms, 1), (stems, 2)):
            for word in words:
                node = 0
                for c in word:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.end.append(0)
                    node = self.next[node][c]
                self.end[node] |= mark
                if mark == 1 and len(word) >= fuzzy_from:
                    self.end[node] |= 4
        # Only nodes that lead to a fuzzy term may spend an edit.
        self.fuzzy = [bool(e & 4) for e in self.end]
        for node in reversed(range(len(self.next))):
            self.fuzzy[node] |= any(self.fuzzy[x] for x in self.next[node].values())
        self._forget()

    def _forget(self):
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items) -> int:
        items = set(items)
        for node, edits, held in list(items):
            if not edits and not held and self.fuzzy[node]:  # a letter of the term is lost
                items.update((x, 1, "") for x in self.next[node].values() if self.fuzzy[x])
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, held in self.sets[state]:
            if self.end[node] & 2 and not edits and not held:
                out.add((node, 0, ""))
            if held:
                if held == c:
                    out.add((node, edits, ""))
                continue
            if c in self.next[node]:
                out.add((self.next[node][c], edits, ""))
            if not edits and self.fuzzy[node]:
                out.add((node, 1, ""))
                for letter, x in self.next[node].items():
                    if self.fuzzy[x]:
                        out.add((x, 1, ""))
                        if c in self.next[x]:
                            out.add((self.next[x][c], 1, letter))
        return self._state(out)

    def match(self, word: str) -> int:
        """2 for a term or stem, 1 for a term with one edit, else 0."""
        if len(self.sets) > self.most_states:
            self._forget()
        state = self.start
        for c in word:
            move = self.moves[state]
            if c not in move:
                move[c] = self._move(state, c)
            state = move[c]
            if not self.sets[state]:
                return 0
        found = 0
        for node, edits, held in self.sets[state]:
            if held:
                continue
            if not edits and self.end[node] & 3:
                return 2
            if edits and self.end[node] & 4:
                found = 1
        return found


def _cores(piece: bytes) -> list[str]:
    """The piece without punctuation around it, and its parts if there is some inside."""
    parts = _CORE.findall(piece.decode("utf-8", "replace").lower())
    return parts if len(parts) < 2 else [*parts, "".join(parts)]


def _own(word: bytes) -> str:
    """A word without the pieces that follow it in its run."""
    return word.split(NEXT, 1)[0].decode("utf-8", "replace")


def _spelt(word: bytes) -> list[str]:
    """Cores of the word, and what it spells with one or more of the pieces after it."""
    first, *rest = word.split(NEXT)
    cores = _cores(first)
    for at in range(len(rest)):
        cores.append("".join(_CORE.findall(b"".join([first, *rest[: at + 1]]).decode("utf-8", "replace").lower())))
    return cores


class _Cache(dict):
    """Values of ``make`` by word; starts anew when it holds ``limit`` words."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) > self.limit:
            self.clear()
        value = self.make(word)
        if len(word) <= CACHED:
            self[word] = value
        return value


class _Hits(dict):
    """What each word is, by :meth:`Automaton.match`; bounded like a vocabulary."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.automaton = Automaton(list(model.terms), list(model.stems), FUZZY)
        self.clean = model.clean

    def kind(self, cores: list[str]) -> int:
        found = 0
        for core in cores:
            kind = self.automaton.match(core)
            found = max(found, 0 if kind == 1 and core in self.clean else kind)
        return found

    def __missing__(self, word: bytes) -> int:
        first, *rest = word.split(NEXT)
        found = self.kind(_cores(first))
        for at, piece in enumerate(rest):
            if found or self.kind(_cores(piece)):  # a term of its own is counted at its own place
                break
            found = self.kind(_spelt(NEXT.join([first, *rest[: at + 1]]))[-1:])
        if len(word) <= CACHED:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int8, len(words))


def quoted(words: list[bytes], at: int) -> bool:
    """Whether quotation marks enclose word ``at`` within the window, or it is reported."""
    around = [_own(w) for w in words[max(0, at - WINDOW) : at + WINDOW + 1]]
    mid = min(at, WINDOW)
    opened = any(w[0] in OPENING for w in around[: mid + 1])
    closed = any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in CLOSING for w in around[mid:])
    before = {c for w in around[max(0, mid - 3) : mid] for c in _CORE.findall(w.lower())}
    return (opened and closed) or bool(before & REPORTING)


def _marks(word: bytes) -> tuple[bool, bool, bool]:
    """Whether a word opens a quotation, closes one, or reports."""
    w = _own(word)
    end = w.rstrip(".,;:!?")[-1:]
    return w[0] in OPENING, bool(end) and end in CLOSING, not REPORTING.isdisjoint(_CORE.findall(w.lower()))


def plain_words(words: list[bytes], marks: _Cache) -> set[bytes]:
    """The words that have a place at which :func:`quoted` does not mark them."""
    if not words:
        return set()
    n = len(words)
    # Sums before each place tell whether a stretch holds a mark.
    sums = np.zeros((n + 1, 3), np.int64)
    np.cumsum(np.array([marks[w] for w in words], np.int64), axis=0, out=sums[1:])
    at = np.arange(n)
    opened = sums[at + 1, 0] > sums[np.maximum(at - WINDOW, 0), 0]
    closed = sums[np.minimum(at + WINDOW + 1, n), 1] > sums[at, 1]
    reported = sums[at, 2] > sums[np.maximum(at - 3, 0), 2]
    return {words[i] for i in np.flatnonzero(~((opened & closed) | reported))}


def evidence(text: bytes, hits: _Hits) -> tuple[float, float, float, float]:
    """1, and for plain, misspelt and quoted terms 1 - 2**-count."""
    words = words_of(text)
    found = hits.of(words)
    counts = [0, 0, 0]
    for i in np.flatnonzero(found):
        counts[2 if quoted(words, i) else 0 if found[i] == 2 else 1] += 1
    return (1.0, *(1 - 0.5**n for n in counts))


#: Prior weights of bias, plain, misspelt and quoted terms, and how firmly they are held.
PRIOR, HELD = np.array([-3.0, 10.0, 8.0, 2.0]), 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """Terms, stems, words near terms that clean texts use, and four weights."""

    terms: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()
    clean: frozenset[str] = frozenset()
    weights: tuple[float, ...] = tuple(PRIOR)

    def score(self, text: Column) -> Column:
        """Probability that a whole text is toxic. Null counts as empty; a text without words or
        terms gets the bias alone."""
        model = self

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            hits, w = _hits(model), np.array(model.weights)
            x = np.array([evidence(t, hits) for t in texts]).reshape(-1, 4) @ w
            return pd.Series(1 / (1 + np.exp(-np.clip(x, -35, 35))))

        return scored(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


_kept: list[tuple[ToxicityModel, _Hits]] = []


def _hits(model: ToxicityModel) -> _Hits:
    if not _kept or _kept[0][0] != model:
        _kept[:] = [(model, _Hits(model))]
    return _kept[0][1]


def learn_terms(rows: list[tuple[bytes, int]]) -> tuple[list[str], list[str]]:
    """Words and word beginnings that set toxic texts apart, as (terms, stems).

    Texts that explain most of the toxic ones not yet explained come first; words that hardly
    any clean text has are also taken if chance cannot have made them. Equal texts count once.
    Quoted uses count on neither side: what they say is left to the weights.
    """
    texts = {}
    for text, label in rows:
        texts.setdefault((text, label), None)
    toxic, clean = [t for t, y in texts if y], [t for t, y in texts if not y]
    if not toxic:
        return [], []
    share = min(0.5, max(len(toxic) / (len(toxic) + len(clean)), 1e-4))
    rare = max(2, round(4 / -log10(share)))
    sure = max(rare, round(10 / -log10(share)), round(0.02 * len(toxic)))

    def keys(word: bytes) -> list[str]:
        cores = [c for c in _spelt(word) if not c.isdigit()]
        return cores + [c[:k] + "*" for c in cores for k in STEMS if len(c) > k]

    made, marks = _Cache(keys), _Cache(_marks)
    seen = Counter()
    for text in toxic:
        seen.update(set().union(*map(made.__getitem__, plain_words(words_of(text), marks))))
    where = {k: set() for k, n in seen.items() if n >= rare}
    wanted = _Cache(lambda word: [k for k in keys(word) if k in where])
    for i, text in enumerate(toxic):
        for k in set().union(*map(wanted.__getitem__, plain_words(words_of(text), marks))):
            where[k].add(i)
    against = Counter()
    for text in clean:
        against.update(set().union(*filter(None, map(wanted.__getitem__, plain_words(words_of(text), marks)))))
    fit = {k: v for k, v in where.items() if against[k] * 20 <= len(v)}
    chosen, open_ = [], set(range(len(toxic)))
    while fit:
        best = max(fit, key=lambda k: (len(fit[k] & open_) - 5 * against[k], k[-1] != "*", len(k), k))
        if len(fit[best] & open_) < rare:
            break
        chosen.append(best)
        open_ -= fit[best]
        fit = {k: v for k, v in fit.items() if k != best and (len(v & open_) >= rare or len(v) >= sure)}
    begun = tuple(k[:-1] for k in chosen if k[-1] == "*")
    for k, v in sorted(fit.items(), key=lambda x: -len(x[1])):
        if len(v) >= sure and k[-1] != "*" and not k.startswith(begun):
            chosen.append(k)
    return [k for k in chosen if k[-1] != "*"], [k[:-1] for k in chosen if k[-1] == "*"]


def learn(rows: list[tuple[bytes, int]]) -> ToxicityModel:
    """Terms, then words close to them that clean texts use, then weights near their prior.

    Such words are no misspellings, unless clean texts only quote them.
    """
    terms, stems = learn_terms(rows)
    automaton, marks = Automaton(terms, stems, FUZZY), _Cache(_marks)
    close = _Cache(lambda w: [c for c in _spelt(w) if automaton.match(c) == 1])
    near = set()
    for text, label in rows:
        if not label:
            near.update(*filter(None, map(close.__getitem__, plain_words(words_of(text), marks))))
    model = ToxicityModel(tuple(terms), tuple(stems), frozenset(near))
    hits = _Hits(model)
    x, y = np.array([evidence(t, hits) for t, _ in rows]).reshape(-1, 4), np.array([y for _, y in rows], float)
    w = PRIOR.copy()
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - y) + HELD * (w - PRIOR)
        bend = (x * (p * (1 - p))[:, None]).T @ x + HELD * np.eye(4)
        w = w - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return ToxicityModel(model.terms, model.stems, model.clean, tuple(w.tolist()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED) -> ToxicityModel:
    """Fit on at most ``most`` labelled documents; ``labels`` is (id, label), label 1 for toxic.

    One task learns from the bounded sample. Without toxic examples there are no terms and every
    text has one low score.
    """

    words = ("terms", "stems")

    def fitted(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        rows.sort()
        model = learn([(t, y) for _, t, y in rows])
        yield pa.RecordBatch.from_pylist(
            [{**{k: list(getattr(model, k)) for k in words}, "clean": sorted(model.clean), "weights": list(model.weights)}],
            schema=pa.schema([*((k, pa.list_(pa.string())) for k in (*words, "clean")), ("weights", pa.list_(pa.float64()))]),
        )

    sample = sample_labelled(docs, labels, id_col, text_col, most).repartition(1)
    row = sample.mapInArrow(fitted, "terms array<string>, stems array<string>, clean array<string>, weights array<double>").first()
    if row is None:
        return ToxicityModel()
    return ToxicityModel(*(tuple(row[k]) for k in words), frozenset(row["clean"]), tuple(row["weights"]))
