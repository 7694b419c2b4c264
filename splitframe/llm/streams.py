"""Runs of rows in a sorted stream: groups of any size in bounded memory, for tasks on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa

BATCH = 5_000


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def batches_of(rows: Iterable[tuple], schema: pa.Schema, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches that are bounded in rows and, by their texts, in bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
        if len(held) >= BATCH or weight >= most_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def id_pieces(batches: Iterable[pa.RecordBatch], most: int = 4_096) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) sorted by both, to pieces (key, first id, ids joined by commas) of at most ``most`` ids."""
    schema = pa.schema([("key", pa.string()), ("first", pa.int64()), ("piece", pa.string())])

    def pieces() -> Iterator[tuple]:
        key, ids = None, []
        for row in rows_of(batches):
            if ids and (row["key"] != key or len(ids) >= most):
                yield key, ids[0], ",".join(map(str, ids))
                ids = []
            key = row["key"]
            ids.append(row["id"])
        if ids:
            yield key, ids[0], ",".join(map(str, ids))

    yield from batches_of(pieces(), schema)


def piece_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, piece) in order, to one SHA-256 a key over its pieces joined by commas."""
    schema = pa.schema([("key", pa.string()), ("digest", pa.string())])

    def digests() -> Iterator[tuple]:
        key, state = None, None
        for row in rows_of(batches):
            if state is not None and row["key"] == key:
                state.update(b",")
            else:
                if state is not None:
                    yield key, state.hexdigest()
                key, state = row["key"], hashlib.sha256()
            state.update(row["piece"].encode())
        if state is not None:
            yield key, state.hexdigest()

    yield from batches_of(digests(), schema)
