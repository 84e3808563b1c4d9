"""The seeded generator of :func:`text.prng_draws`, for the driver and for tests."""

from __future__ import annotations

import math

_UNIT = 1 << 32
_OTHER_SEED = 0x6D2B79F5  # stands for zero, on which xorshift would stay


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for unit in memoryview(raw).cast("H"):
        h = (h ^ unit) * 0x01000193 % _UNIT
    return h


class Prng:
    """xorshift32 from a number or a non-empty string."""

    def __init__(self, seed: int | float | str):
        if isinstance(seed, str):
            if not seed:
                raise ValueError("a seed string must not be empty")
            seed = fnv1a(seed)
        elif not math.isfinite(seed):
            raise ValueError("a seed must be finite")
        self.initial = self.state = int(seed) % _UNIT or _OTHER_SEED

    def uint32(self) -> int:
        x = self.state
        x ^= x << 13 & _UNIT - 1
        x ^= x >> 17
        self.state = (x ^ x << 5) % _UNIT
        return self.state

    def float(self) -> float:
        return self.uint32() / _UNIT

    def below(self, most: int) -> int:
        if most <= 0:
            raise ValueError("the bound must be positive")
        return int(self.float() * most)

    def between(self, low: int, high: int) -> int:
        if high <= low:
            raise ValueError("the upper bound must be larger than the lower one")
        return low + self.below(high - low)
