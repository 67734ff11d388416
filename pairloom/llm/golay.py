"""The binary Golay code: 23 bits, 4,096 code words, every word within three bits of one."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
BITS, DATA, CHECK = 23, 12, 11


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of every 12 data bits; the error pattern of every 11-bit syndrome."""
    checks = np.arange(1 << DATA, dtype=np.int64) << CHECK
    for bit in range(BITS - 1, CHECK - 1, -1):
        checks ^= np.where(checks >> bit & 1, GENERATOR << (bit - CHECK), 0)
    errors = np.zeros(1 << CHECK, dtype=np.int64)
    for size in (1, 2, 3):
        for places in combinations(range(BITS), size):
            e = sum(1 << p for p in places)
            errors[checks[e >> CHECK] ^ (e & (1 << CHECK) - 1)] = e
    return checks, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the code word nearest to each 23-bit word."""
    checks, errors = tables()
    return (words ^ errors[checks[words >> CHECK] ^ (words & (1 << CHECK) - 1)]) >> CHECK


def nearby(words: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices that words within one flipped bit decode to: (n, 6) indices and which of them count.

    There is one index for words within two bits of a code word and at most six for the rest.
    Two words within one bit of each other: the index of either is among the other's. Two
    words within two bits: they share one.
    """
    flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(found, place, 1), np.take_along_axis(new, place, 1)
