"""Numpy kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: About so many bytes of text are worked on at once; one longer text is worked on alone.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(seed: int) -> np.ndarray:
    """A pseudorandom 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 7919 + 1))


def chunks(texts: list, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` characters together."""
    low = total = 0
    for i, x in enumerate(texts):
        total += len(x)
        if total >= size:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


class Prefix:
    """Polynomial digests of byte ranges mod 2**64 from one running sum."""

    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            m = max(n + 1, CHUNK + CHUNK // 2)
            up, down = np.full(m, self.base, U64), np.full(m, self.inverse, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down

    def sums(self, data: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Running sums s with s[i] over data[:i]."""
        up, _ = self.powers(len(data))
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digest of data[start:end] for each pair; equal bytes give equal digests."""
        _, down = self.powers(len(sums))
        return (sums[end] - sums[start]) * down[start]
