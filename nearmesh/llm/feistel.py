"""Keyed Feistel permutations of [0, n), by cycle-walking.

``Permutation`` works on Python integers of any size (pseudonyms); the numpy
form ``permute`` on int64 arrays (training order). Both are bijections for every
key and every n >= 1.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64


class Permutation:
    """Keyed bijection of the integers 0 .. n-1."""

    def __init__(self, n: int, key: bytes, rounds: int = 8):
        if n < 1:
            raise ValueError("a permutation needs a domain of at least 1")
        self.n, self.key, self.rounds = n, key, rounds
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.width = (self.half + 7) // 8

    def _round(self, i: int, right: int) -> int:
        data = i.to_bytes(1, "big") + self.n.to_bytes((self.n.bit_length() + 7) // 8, "big") + right.to_bytes(self.width, "big")
        h = hashlib.blake2b(data, key=self.key[:64], digest_size=min(64, self.width + 8))
        return int.from_bytes(h.digest(), "big") & self.mask

    def _once(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for i in range(self.rounds):
            left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def _back(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for i in reversed(range(self.rounds)):
            left, right = right ^ self._round(i, left), left
        return left << self.half | right

    def __call__(self, x: int) -> int:
        x = self._once(x)
        while x >= self.n:  # walk the cycle until it is back in the domain
            x = self._once(x)
        return x

    def inverse(self, x: int) -> int:
        x = self._back(x)
        while x >= self.n:
            x = self._back(x)
        return x


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _keys(n: int, key: int, rounds: int) -> np.ndarray:
    seed = hashlib.blake2b(f"{key}:{n}".encode(), digest_size=8).digest()
    with np.errstate(over="ignore"):
        return mix64(np.frombuffer(seed, ">u8").astype(_U) + _U(0x9E3779B97F4A7C15) * np.arange(1, rounds + 1, dtype=_U))


def permute(x: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """Places of the indices ``x`` (0 <= x < n) under the permutation of ``key``; or the way back."""
    half = _U(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (_U(1) << half) - _U(1)
    keys = _keys(n, key, rounds)
    out = np.asarray(x, dtype=np.int64).astype(_U)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & mask)
        v = left << half | right
        out[todo] = v
        todo = todo[v >= _U(n)]
    return out.astype(np.int64)
