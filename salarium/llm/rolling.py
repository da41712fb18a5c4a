"""Hashes of all substrings of a byte array by prefix sums.

The hash of bytes ``a .. b`` is the sum of a value for each byte times the
power of its place, modulo 2^64, divided by the power of ``a``: one
subtraction and one product for any substring.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
LEAST_POWERS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A value for each byte, from a rule.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, LEAST_POWERS)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up[:len(data)], dtype=np.uint64)))
