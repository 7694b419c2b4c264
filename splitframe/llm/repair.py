"""Structure repair of conversations by a parallel Viterbi with rank convergence.

The cheapest edits that make the roles of a conversation alternate are a shortest path through four
states (nothing yet, after system, after user, after assistant). Rows are cut into chunks of 256; a
chunk's backward costs are min-plus products of one small matrix a row. Every chunk starts from a
speculative cost vector behind its last row; fix-up passes hand each chunk the vector that the next
one found and run it again unless the vector differs from the one used by a constant only. Mostly a
few rows make all vectors parallel, so few chunks run twice. Conversations that still change after
``PASSES`` (as where no row can be kept, and costs only swap) get whole chunk matrices, whose
products with one vector are streamed. With all vectors known, every chunk traces the least edits in
ASCII order from each state it could be entered in; the states are stitched from the front.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.position import position_rows
from ..session import materialise
from .streams import batches_of, rows_of

CHUNK = 256
PASSES = 4

# States, and what edits cost. A kept or rerolled row that is cut short costs CUT more.
START, SYSTEM, USER, ANSWER = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"

_FAR = 1 << 50
_AFTER = {START: USER, SYSTEM: USER, USER: ANSWER, ANSWER: USER}
_SAID = {USER: "user", ANSWER: "assistant"}
# Codes: 3 * role + kind; roles s, u, a, other; kinds sound, truncated, must go. 12 is no row.
_NO_ROW = 12


def _kept(role: int, state: int) -> int | None:
    """State after a kept row, if it may be kept."""
    if role == 0:
        return SYSTEM if state == START else None
    after = _AFTER[state]
    return after if (role, after) in ((1, USER), (2, ANSWER)) else None


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs [code, state, state] of a row with any inserts before it, of a keep, and of a rerole."""
    keep, role_ = np.full((13, 4), _FAR), np.full((13, 4), _FAR)
    step = np.full((13, 4, 4), _FAR)
    for code in range(12):
        role, kind = divmod(code, 3)
        more = CUT if kind == 1 else 0
        for s in range(4):
            step[code, s, s] = DELETE
            if kind < 2:
                role_[code, s] = REROLE + more
                step[code, s, _AFTER[s]] = min(step[code, s, _AFTER[s]], REROLE + more)
                to = _kept(role, s)
                if to is not None:
                    keep[code, s] = more
                    step[code, s, to] = min(step[code, s, to], more)
    step[12] = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for code in range(12):
        direct = step[code].copy()
        for s in range(4):
            one, two = _AFTER[s], _AFTER[_AFTER[s]]
            step[code, s] = np.minimum.reduce([direct[s], INSERT + direct[one], 2 * INSERT + direct[two]])
    return step, keep, role_


STEP, KEEP, TURN = _tables()
_NEXT = np.array([_AFTER[s] for s in range(4)])
_KEPT = np.array([[(_kept(min(c // 3, 3), s) or 0) for s in range(4)] for c in range(13)])
#: Cost from each state to the end when no row is left: inserts until a pair is whole.
END = np.array([0, 2 * INSERT, INSERT, 0])


def _padded(codes: list[list[int]]) -> np.ndarray:
    out = np.full((len(codes), max(map(len, codes), default=0)), _NO_ROW, np.int64)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


def _flat(v: np.ndarray) -> np.ndarray:
    """Vectors less their minimum: equal if they differ by a constant."""
    return v - v.min(axis=-1, keepdims=True)


def backward(codes: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs to the end [chunk, place, state] of chunks at once, from the vectors behind them."""
    out = np.empty((len(codes), codes.shape[1] + 1, 4), np.int64)
    out[:, -1] = behind
    for i in range(codes.shape[1] - 1, -1, -1):
        out[:, i] = (STEP[codes[:, i]] + out[:, i + 1, None, :]).min(axis=2)
    return out


def _choices(codes: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is done at each place in each state, as 3 * inserts + (0 delete, 1 keep, 2 rerole), and the state after.

    Of equal costs the first of D, I, K, R in ASCII order; an insert leads to the choice of its state.
    """
    here, then = costs[:, :-1], costs[:, 1:]
    rows = np.arange(len(codes))[:, None, None], np.arange(codes.shape[1])[None, :, None]
    keep_to, turn_to = _KEPT[codes], np.broadcast_to(_NEXT, here.shape)
    delete = here == DELETE + then
    insert = ~delete & (here == INSERT + here[..., _NEXT])
    keep = KEEP[codes] + then[(*rows, keep_to)] == here
    does = np.where(delete, 0, np.where(keep, 1, 2))
    after = np.where(delete, np.arange(4), np.where(keep, keep_to, turn_to))
    # No row: nothing is done.
    none = (codes == _NO_ROW)[..., None]
    does, after, insert = np.where(none, 0, does), np.where(none, np.arange(4), after), insert & ~none
    for _ in range(2):
        more = 3 + does[..., _NEXT]
        does, after = np.where(insert, more, does), np.where(insert, after[..., _NEXT], after)
    return does, after


def traced(codes: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Actions [chunk, state entered in, place] and states left in [chunk, state entered in]."""
    does, after = _choices(codes, costs)
    state = np.broadcast_to(np.arange(4), (len(codes), 4)).copy()
    acts = np.empty((len(codes), 4, codes.shape[1]), np.int64)
    for i in range(codes.shape[1]):
        acts[:, :, i] = np.take_along_axis(does[:, i], state, 1)
        state = np.take_along_axis(after[:, i], state, 1)
    return acts, state


# -- chunks as rows -----------------------------------------------------------------------

_SPAN = [("conv", pa.string()), ("chunk", pa.int64())]


def _per_chunk(fn: Callable[[dict, np.ndarray], Iterable[list]], fields: list[tuple[str, pa.DataType]]):
    """Arrow function that gives each chunk the values of ``fn(columns, codes)`` after its name."""
    schema = pa.schema(_SPAN + fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                t = whole.slice(at, 2_000).to_pydict()
                yield from batches_of(zip(t["conv"], t["chunk"], *fn(t, _padded(t["codes"]))), schema)

    return run


def _front(t: dict, codes: np.ndarray) -> list:
    """Vector before each chunk, from the vector behind it."""
    return [_flat(backward(codes, np.array(t["behind"], np.int64))[:, 0]).tolist()]


def _matrices(t: dict, codes: np.ndarray) -> list:
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
    ahead = [backward(codes, np.broadcast_to(unit[s], (len(codes), 4)))[:, 0] for s in range(4)]
    return [np.stack(ahead, axis=2).reshape(len(codes), 16).tolist()]


def _traces(t: dict, codes: np.ndarray) -> list:
    """Actions for the state entered in, and the states left in for all four."""
    acts, left = traced(codes, backward(codes, np.array(t["behind"], np.int64)))
    entered = t.get("entered") or [START] * len(codes)
    return [[a[s, : len(c)].tolist() for a, s, c in zip(acts, entered, t["codes"])], left.tolist()]


def _stitch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk matrices, last chunk first, to the vectors behind the chunks."""
    schema = pa.schema([*_SPAN, ("behind", pa.list_(pa.int64()))])

    def vectors() -> Iterator[tuple]:
        conv, v = None, END
        for row in rows_of(batches):
            v = END if row["conv"] != conv else v
            conv = row["conv"]
            yield conv, row["chunk"], v.tolist()
            v = _flat((np.array(row["matrix"]).reshape(4, 4) + v).min(axis=1))

    yield from batches_of(vectors(), schema)


def _enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States left in for each state entered in, first chunk first, to the states entered in."""
    schema = pa.schema([*_SPAN, ("entered", pa.int64())])

    def states() -> Iterator[tuple]:
        conv, state = None, START
        for row in rows_of(batches):
            state = START if row["conv"] != conv else state
            conv = row["conv"]
            yield conv, row["chunk"], state
            state = row["left"][state]

    yield from batches_of(states(), schema)


def _level(vector: Column) -> Column:
    """As `_flat`, for an array column."""
    return F.transform(vector, lambda x: x - F.array_min(vector))


def _behind(chunks: DataFrame, passes: int) -> DataFrame:
    """Chunks of conversations that have several, with the cost vector behind each, up to a constant."""
    vectors = "conv string, chunk bigint, front array<bigint>"
    front = _per_chunk(_front, [("front", pa.list_(pa.int64()))])
    end = F.lit(END.tolist()).cast("array<bigint>")
    now = chunks.withColumn("behind", end)
    now = materialise(now.join(now.mapInArrow(front, vectors), ["conv", "chunk"]), "speculated")
    for _ in range(passes):
        ahead = now.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("front").alias("found"))
        next_ = now.join(ahead, ["conv", "chunk"], "left").withColumn("found", F.coalesce("found", end))
        next_ = next_.withColumn("again", _level(F.col("found")) != _level(F.col("behind")))
        next_ = materialise(next_.withColumn("behind", F.when(F.col("again"), F.col("found")).otherwise(F.col("behind"))), "fixed")
        wrong = next_.where("again").select("conv", "chunk", "codes", "behind")
        # A conversation is done when no chunk of it was wrong.
        if wrong.isEmpty():
            return next_.select("conv", "chunk", "codes", "behind")
        rerun = wrong.mapInArrow(front, vectors).withColumnRenamed("front", "newly")
        now = next_.join(rerun, ["conv", "chunk"], "left").withColumn("front", F.coalesce("newly", "front"))
        now = materialise(now.drop("newly", "found", "again"), "speculated")
    ahead = now.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("front").alias("found"))
    open_ = now.join(ahead, ["conv", "chunk"], "left").where(_level(F.coalesce("found", end)) != _level(F.col("behind"))).select("conv").distinct()
    open_ = materialise(open_, "open")
    rest = now.select("conv", "chunk", "codes").join(open_, "conv", "left_semi")
    products = rest.mapInArrow(_per_chunk(_matrices, [("matrix", pa.list_(pa.int64()))]), "conv string, chunk bigint, matrix array<bigint>")
    ordered = products.repartition("conv").sortWithinPartitions("conv", F.col("chunk").desc())
    exact = rest.join(ordered.mapInArrow(_stitch, "conv string, chunk bigint, behind array<bigint>"), ["conv", "chunk"])
    return now.select("conv", "chunk", "codes", "behind").join(open_, "conv", "left_anti").unionByName(exact)


def _actions(chunks: DataFrame, passes: int) -> DataFrame:
    """``conv``, ``chunk``, ``acts`` (3 * inserts before the row + 0 delete, 1 keep, 2 rerole)."""
    several = materialise(chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv"), "several")
    kinds, fields = "conv string, chunk bigint, acts array<bigint>, left array<bigint>", [("acts", pa.list_(pa.int64())), ("left", pa.list_(pa.int64()))]
    trace = _per_chunk(_traces, fields)
    alone = chunks.join(several, "conv", "left_anti").withColumn("behind", F.lit(END.tolist()).cast("array<bigint>"))
    done = alone.mapInArrow(trace, kinds).select("conv", "chunk", "acts")
    known = materialise(_behind(chunks.join(several, "conv", "left_semi"), passes), "behind")
    ordered = known.mapInArrow(trace, kinds).select("conv", "chunk", "left").repartition("conv").sortWithinPartitions("conv", "chunk")
    entered = ordered.mapInArrow(_enter, "conv string, chunk bigint, entered bigint")
    return done.unionByName(known.join(entered, ["conv", "chunk"]).mapInArrow(trace, kinds).select("conv", "chunk", "acts"))


# -- turns --------------------------------------------------------------------------------


def ends_well(text: Column) -> Column:
    """Whether the last character besides ASCII white space is one of ``.!?``."""
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")


_EDITS = pa.schema(
    [
        ("conv", pa.string()),
        ("edit", pa.string()),
        ("fault", pa.string()),
        ("turn", pa.int64()),
        ("given_role", pa.string()),
        ("role", pa.string()),
        ("text", pa.string()),
        ("cost", pa.int64()),
    ]
)
EDITS = "conv string, edit string, fault string, turn bigint, given_role string, role string, text string, cost bigint"


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Actions and rows of conversations in order, to one row an edit; nothing but a chunk's actions is held."""

    def inserts(conv: str, state: int, n: int) -> Iterator[tuple]:
        for _ in range(n):
            state = _AFTER[state]
            yield conv, "I", None, None, None, _SAID[state], "", INSERT

    def edits() -> Iterator[tuple]:
        conv, state, acts, again, at = None, START, [], [], 0
        for row in rows_of(batches):
            if row["conv"] != conv:
                if conv is not None:
                    yield from inserts(conv, state, int(END[state]) // INSERT)
                conv, state = row["conv"], START
            if row["acts"] is not None:
                acts, again, at = row["acts"], row["again"], 0
                continue
            before, does = divmod(acts[at], 3)
            fault = "duplicate" if again[at] else row["fault"]
            at += 1
            yield from inserts(conv, state, before)
            for _ in range(before):
                state = _AFTER[state]
            cut = CUT if fault == "truncated" else 0
            given = conv, "DKR"[does], fault, row["turn"], row["role"]
            if does == 0:
                yield *given, None, None, DELETE
            elif does == 1:
                state = _kept("sua".find(row["role"][:1]), state)
                yield *given, row["role"], row["text"], cut
            else:
                state = _AFTER[state]
                yield *given, _SAID[state], row["text"], REROLE + cut
        if conv is not None:
            yield from inserts(conv, state, int(END[state]) // INSERT)

    yield from batches_of(edits(), _EDITS)


_REPORT = pa.schema(
    [("conv", pa.string())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
REPORT = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _reported(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to one row a conversation."""

    def closed(conv: str, x: dict) -> tuple:
        gaps = 0 if x["first"] is None else x["turn"] - x["first"] + 1 - x["turns"]
        faults = [x["faults"].get(f, 0) for f in ("blank", "duplicate", "truncated")]
        return conv, gaps, *faults, x["illegal"], x["cost"], x["audit"].decode(), x["sha"].hexdigest()

    def reports() -> Iterator[tuple]:
        conv, x = None, {}
        for row in rows_of(batches):
            if row["conv"] != conv:
                if conv is not None:
                    yield closed(conv, x)
                conv = row["conv"]
                x = dict(first=None, turn=None, turns=0, faults={}, illegal=0, cost=0, audit=bytearray(), sha=hashlib.sha256(), role=None, said=False)
            x["audit"] += row["edit"].encode()
            x["cost"] += row["cost"]
            if row["role"] is not None:
                x["sha"].update(f"{chr(10) if x['said'] else ''}{row['role']}:{row['text']}".encode())
                x["said"] = True
            if row["edit"] == "I":
                continue
            if row["fault"]:
                x["faults"][row["fault"]] = x["faults"].get(row["fault"], 0) + 1
            if x["role"] is not None:
                x["illegal"] += (x["role"][:1] + row["given_role"][:1]) not in ("su", "ua", "au")
            x["role"] = row["given_role"]
            if row["turn"] is not None and row["turn"] != x["turn"]:
                x["first"] = row["turn"] if x["first"] is None else x["first"]
                x["turn"], x["turns"] = row["turn"], x["turns"] + 1
        if conv is not None:
            yield closed(conv, x)

    yield from batches_of(reports(), _REPORT)


def repair_edits(turns: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """The cheapest edits of every conversation, one row an edit, in order within partitions.

    ``turns``: ``conv`` (string), ``turn``, ``role`` and ``text`` (neither null), ``tie`` and
    ``copy``, which order rows of one turn. Turns without a number come first. The first fault
    of a row counts: ``blank`` (nothing but ASCII white space), ``duplicate`` (role and text
    occurred before in the conversation), ``truncated`` (does not end in ``.!?``). Keeping costs 0,
    reroling to user or assistant 3, deleting 4, which blank and duplicate rows must be, inserting
    a user or assistant turn without text 3; a truncated row that stays costs 3 more. The initials
    of the roles that result are a system turn, if any, and pairs of user and assistant, or nothing.
    Ties go to the edits whose initials come first in ASCII order. Columns: ``EDITS``; ``role`` and
    ``text`` are those of the repaired conversation (null for a deleted row). No row, no edit.
    """
    order = ["conv", "turn", "tie", "copy"]
    rows = position_rows(turns.select(*order, "role", "text"), *order).with_position("pos")
    content = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    fault = F.when(F.rtrim(F.col("text"), F.lit(SPACE)) == "", "blank").when(~ends_well(F.col("text")), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marks = materialise(rows.select("conv", "pos", content.alias("content"), fault.alias("fault"), role.alias("r")), "marks")
    firsts = marks.groupBy("conv", "content").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    again = F.col("first").isNull() & (F.col("fault") != "blank")
    kind = F.when(again | (F.col("fault") == "blank"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    marks = marks.join(firsts, "pos", "left").select("conv", "pos", (3 * F.col("r") + kind).cast("bigint").alias("code"), again.alias("again"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "code", "again")))
    chunks = marks.groupBy("conv", F.floor(F.col("pos") / chunk).alias("chunk")).agg(packed.alias("p"))
    chunks = materialise(chunks.select("conv", "chunk", F.col("p.code").alias("codes"), F.col("p.again").alias("again")), "chunks")

    acts = _actions(chunks.select("conv", "chunk", "codes"), passes).join(chunks.select("conv", "chunk", "again"), ["conv", "chunk"])
    acts = acts.select("conv", (F.col("chunk") * chunk).alias("pos"), F.lit(0).alias("part"), "acts", "again")
    said = rows.select("conv", "pos", F.lit(1).alias("part"), "turn", "role", "text", fault.alias("fault"))
    # A chunk's actions come just before its rows.
    stream = acts.unionByName(said, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "pos", "part")
    return stream.select("conv", "acts", "again", "turn", "role", "text", "fault").mapInArrow(_edited, EDITS)


def repair_report(turns: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """One row a conversation that has rows: ``REPORT``; ``turns`` as for ``repair_edits``.

    ``gaps``: numbers missing between the least and the greatest turn; ``illegal``: adjacent roles
    whose initials are not su, ua or au; ``audit``: initials of the edits in order;
    ``repaired_sha256``: of ``role:text`` of the repaired conversation, joined by line feeds.
    """
    return repair_edits(turns, chunk, passes).mapInArrow(_reported, REPORT)
