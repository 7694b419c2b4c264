"""Keyed hashes: tokens, repeatable random numbers and random keys.

Everything here is a pure function of ``(seed, row id, purpose)``. ``rand()`` is avoided on
purpose: two outputs of one table must still agree when a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key alphabet, key length and the size of the share domain.
KEY_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
KEY_LENGTH = 20
SHARE_DOMAIN = 65536


def key_to_token(key: Column, bits: int = 512) -> Column:
    """Digest of an id as hex text (null ids stay null and so never match)."""
    return F.sha2(key.cast("string"), bits)


def keyed_digest(seed: str | int, *parts: Column | str) -> Column:
    """SHA-256 hex digest over the seed and the given parts, separated by ``|``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)


def digest_word(digest: Column, word: int = 0) -> Column:
    """The ``word``-th group of 32 bits of a hex digest as a non-negative bigint."""
    return F.conv(F.substring(digest, word * 8 + 1, 8), 16, 10).cast("bigint")


def keyed_int(low: int, high: int, seed: str | int, *parts: Column | str) -> Column:
    """Repeatable integer in ``[low, high)``, a range of at most 2**32 numbers."""
    if not 0 < high - low <= 2**32:
        raise ValueError("the range must hold 1 to 2**32 integers")
    return F.pmod(digest_word(keyed_digest(seed, *parts)), F.lit(high - low)) + F.lit(low)


def keyed_unit(seed: str | int, *parts: Column | str) -> Column:
    """Repeatable double in ``[0, 1)`` with 32 random bits."""
    return digest_word(keyed_digest(seed, *parts)) / F.lit(float(2**32))


def share_mask(seed: str | int, row_id: Column | str, column: str) -> Column:
    """Uniform integer mask in ``[-32768, 32768)`` for one cell."""
    half = SHARE_DOMAIN // 2
    return keyed_int(-half, half, seed, row_id, F.lit(column))


def random_key(seed: str | int, row: Column | str) -> Column:
    """Random key of 20 characters out of ``[A-Z0-9]``; three hex digits pick a character."""
    digest = keyed_digest(seed, row)
    picks = [
        F.substring(
            F.lit(KEY_ALPHABET),
            F.pmod(F.conv(F.substring(digest, 3 * i + 1, 3), 16, 10).cast("int"), F.lit(len(KEY_ALPHABET))) + 1,
            F.lit(1),
        )
        for i in range(KEY_LENGTH)
    ]
    return F.concat(*picks)
