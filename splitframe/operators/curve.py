"""Curve25519 by x-coordinates, for many points and one secret at once.

A coordinate is twelve float64 limbs of 21 or 22 bits a point, the limb of place ``i`` being a multiple
of ``2**PLACES[i]``, so that products need no shifts. Every sum stays under 53 bits, so all is exact.
"""

from __future__ import annotations

import numpy as np

PRIME = 2**255 - 19
# Curve and twist have eight and four times a prime number of points: multiples of eight lose the rest.
COFACTOR = 8
ORDERS = (2**252 + 27742317777372353535851937790883648493, 2**253 - 55484635554744707071703875581767296995)
TOKEN_BYTES = 32

LIMBS = 12
PLACES = [-(-255 * i // LIMBS) for i in range(LIMBS + 1)]
_A24 = 121_665
# What leaves the top comes back at the bottom.
_WRAP = 19.0 * 2.0**-255
# Added and taken off again, these round a limb to a multiple of the next limb's unit.
_ROUND = np.array([[3.0 * 2.0 ** (51 + p)] for p in PLACES[1:]])
# Points worked on at once: what a product reads and writes stays in the cache.
AT_ONCE = 2048


def _carried(x: np.ndarray, passes: int = 2) -> np.ndarray:
    """``x`` in place, with limbs of at most half their range, or little more."""
    for _ in range(passes):
        over = x + _ROUND
        over -= _ROUND
        x -= over
        x[1:] += over[:-1]
        x[0] += over[-1] * _WRAP
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product; both sides may be sums of two carried numbers."""
    wide = np.zeros((2 * LIMBS, a.shape[1]))
    part = np.empty_like(b)
    for i in range(LIMBS):
        np.multiply(a[i], b, out=part)
        wide[i : i + LIMBS] += part
    low, high = wide[:LIMBS], wide[LIMBS:]
    high *= _WRAP
    low += high
    return _carried(low)


def _squared(a: np.ndarray) -> np.ndarray:
    wide = np.zeros((2 * LIMBS, a.shape[1]))
    twice, part = a + a, np.empty_like(a)
    for i in range(LIMBS):
        rest = part[: LIMBS - i]
        np.multiply(twice[i], a[i:], out=rest)
        rest[0] *= 0.5
        wide[2 * i : i + LIMBS] += rest
    low, high = wide[:LIMBS], wide[LIMBS:]
    high *= _WRAP
    low += high
    return _carried(low)


def _limbs(numbers: np.ndarray) -> np.ndarray:
    """Limbs of Python integers from 0 to ``2**255``."""
    spans = zip(PLACES, PLACES[1:])
    return _carried(np.stack([((numbers >> lo) & ((1 << (hi - lo)) - 1)).astype(float) * 2.0**lo for lo, hi in spans]))


def _numbers(limbs: np.ndarray) -> np.ndarray:
    """Python integers of limbs, below the prime."""
    units = [(x * 2.0**-lo).astype(np.int64).astype(object) << lo for x, lo in zip(limbs, PLACES)]
    return sum(units) % PRIME


def _quotients(x: list[int], z: list[int]) -> list[int]:
    """``x / z`` by one inversion; 0 where z is 0."""
    before, total = [], 1
    for n in z:
        before.append(total)
        total = total * (n or 1) % PRIME
    rest, out = pow(total, -1, PRIME), [0] * len(z)
    for i in range(len(z) - 1, -1, -1):
        if z[i]:
            out[i] = x[i] * before[i] * rest % PRIME
            rest = rest * z[i] % PRIME
    return out


def usable(secret: int) -> bool:
    """Whether multiples by the secret keep different points apart."""
    return secret > 0 and all(secret % n for n in ORDERS)


def multiples(points: list[int], secret: int) -> list[int]:
    """x-coordinates of the points with the given ones, taken ``8 * secret`` times: Montgomery's ladder."""
    return [x for i in range(0, len(points), AT_ONCE) for x in _multiples(points[i : i + AT_ONCE], COFACTOR * secret)]


def _multiples(points: list[int], times: int) -> list[int]:
    x1 = _limbs(np.array(points, object))
    one, none = np.zeros_like(x1), np.zeros_like(x1)
    one[0] = 1.0
    x2, z2, x3, z3 = one, none, x1, one
    for bit in bin(times)[2:]:
        if bit == "1":
            x2, z2, x3, z3 = x3, z3, x2, z2
        a, b, c, d = x2 + z2, x2 - z2, x3 + z3, x3 - z3
        da, cb, aa, bb = _times(d, a), _times(c, b), _squared(a), _squared(b)
        e = aa - bb
        x3, z3 = _squared(da + cb), _times(x1, _squared(da - cb))
        x2, z2 = _times(aa, bb), _times(e, _carried(aa + _A24 * e))
        if bit == "1":
            x2, z2, x3, z3 = x3, z3, x2, z2
    return _quotients(list(_numbers(x2)), list(_numbers(z2)))
