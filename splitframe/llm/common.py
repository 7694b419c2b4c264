"""Small helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bucket(mod: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def unit(*cols: Column | str) -> Column:
    """A reproducible number in [0, 1) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit mix of two arrays of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Vocabulary(dict):
    """Numbers for byte words as they come, with the hash and length of each.

    Lives in one task and starts anew when ``limit`` words or ``most_bytes`` bytes of words are
    known, so between texts its memory is bounded; nothing that leaves the task depends on the numbers.
    """

    def __init__(self, limit: int = 80_000, most_bytes: int = 8_000_000):
        super().__init__()
        self.limit, self.most_bytes = limit, most_bytes
        self._forget()

    def _forget(self):
        self.clear()
        self.held = 0
        self.hashes = np.empty(1024, np.uint64)
        self.lengths = np.empty(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty(n, np.uint64)])
            self.lengths = np.concatenate([self.lengths, np.empty(n, np.int64)])
        self.hashes[n] = xxhash.xxh64_intdigest(word)
        self.lengths[n] = len(word)
        self.held += len(word)
        self[word] = n
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit or self.held > self.most_bytes:
            self._forget()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
