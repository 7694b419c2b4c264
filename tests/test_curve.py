import random

import pytest
from pyspark.sql import functions as F

from splitframe.operators import align, curve


def plain(u, times):
    """The ladder on Python integers, one point at a time."""
    x2, z2, x3, z3 = 1, 0, u, 1
    for bit in bin(times)[2:]:
        if bit == "1":
            x2, z2, x3, z3 = x3, z3, x2, z2
        aa, bb, da, cb = (x2 + z2) ** 2, (x2 - z2) ** 2, (x3 - z3) * (x2 + z2), (x3 + z3) * (x2 - z2)
        x3, z3 = (da + cb) ** 2 % curve.PRIME, u * (da - cb) ** 2 % curve.PRIME
        x2, z2 = aa * bb % curve.PRIME, (aa - bb) * (aa + 121_665 * (aa - bb)) % curve.PRIME
        if bit == "1":
            x2, z2, x3, z3 = x3, z3, x2, z2
    return x2 * pow(z2, curve.PRIME - 2, curve.PRIME) % curve.PRIME


def little(text):
    return int.from_bytes(bytes.fromhex(text), "little")


def test_published_vector():
    """RFC 7748, section 5.2; its scalars are decoded with three low bits cleared and bit 254 set."""
    scalar = little("a546e36bf0527c9d3b16154b82465edd62144c0ac1fc5a18506a2244ba449ac4") & (2**255 - 8) | 2**254
    u = little("e6db6867583030db3594c1a424b15f7c726624ec26b3353b10a903a6d0ab1c4c") % 2**255
    assert curve.multiples([u], scalar // 8) == [little("c3da55379de9c6908e94ea4df28d084f32eccf03491c71f754b4075577a28552")]


def test_many_points_at_once_are_exact(monkeypatch):
    monkeypatch.setattr(curve, "AT_ONCE", 150)
    dice = random.Random(7)
    edge = [0, 1, 2, 9, curve.PRIME - 1, curve.PRIME - 2, 2**255 - 2**234, 2**21 - 1, 2**22]
    points = edge + [dice.randrange(curve.PRIME) for _ in range(300)]
    for secret in (1, 3, 2**256 - 189, dice.randrange(2**256)):
        assert curve.multiples(points, secret) == [plain(u, 8 * secret) for u in points]


def test_limbs_keep_their_sums_under_53_bits():
    widths = [b - a for a, b in zip(curve.PLACES, curve.PLACES[1:])]
    most = [2 * 1.02 * 2.0 ** (w - 1 + p) for w, p in zip(widths, curve.PLACES)]
    for k, place in enumerate(curve.PLACES[:-1]):
        low = sum(most[i] * most[k - i] for i in range(k + 1))
        high = sum(most[i] * most[k + 12 - i] for i in range(k + 1, 12))
        assert (low + 19 * 2.0**-255 * high) / 2.0**place < 2**52


def test_tokens_are_short_and_secrets_must_keep_ids_apart(spark):
    ids = spark.range(3000).select(F.col("id").cast("string"))
    tokens = [r["t"] for r in ids.select(align.blind(align.hash_to_group(F.col("id")), 12345).alias("t")).collect()]
    assert {len(t) for t in tokens} == {32} and len(set(tokens)) == 3000
    for secret in (0, -5, curve.ORDERS[0], 2 * curve.ORDERS[1]):
        with pytest.raises(ValueError):
            align.blind(F.col("t"), secret)
