"""Vectorised hashing of every window of many concatenated sequences.

``Rolling`` holds the prefix sums of a polynomial over the symbols modulo the prime
2**61 - 1, so the hash of any window is two look-ups; windows of one length are
compared by the finished value.  (Modulo 2**64 every base has sequences that
collide whatever their symbols are.)  Two different windows of m symbols are equal
with probability m / 2**61 at most, over the choice of the base.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
PRIME = (1 << 61) - 1
BASE = 0x9E3779B97F4A7C15 % PRIME
_INVERSE = pow(BASE, -1, PRIME)
# Powers kept for the life of a worker; longer sequences make their own.
KEPT_POWERS = 1 << 22
CHUNK = 1 << 14  # what a step works on stays in the processor's cache
_POWERS: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo the prime."""
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (a0, a1), (b0, b1) = _halves(a), _halves(b)
    middle = a0 * b1 + a1 * b0
    ll = a0 * b0
    # 2**64 is 8, and bits from 61 on count from 0 again
    total = ((a1 * b1) << U(3)) + (middle >> U(29)) + ((middle & U(0x1FFFFFFF)) << U(32))
    return _reduced(_reduced(total) + (ll & U(PRIME)) + (ll >> U(61)))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x & U(0xFFFFFFFF), x >> U(32)


def product(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo the prime of values below it, a chunk at a time."""
    out = np.empty(len(a), U)
    for lo in range(0, len(a), CHUNK):
        part = slice(lo, lo + CHUNK)
        out[part] = _product(a[part], b[part] if isinstance(b, np.ndarray) else b)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    size = 1 << max(12, (n - 1).bit_length())
    have = np.ones(size if size <= KEPT_POWERS else n, U)
    done = 1
    while done < len(have):
        more = min(done, len(have) - done)
        have[done:done + more] = product(have[:more], U(pow(base, done, PRIME)))
        done += more
    if size <= KEPT_POWERS:
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of each value over all 64 bits (a bijection)."""
    h = h ^ (h >> U(31))
    h *= U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


class Rolling:
    """Window hashes over ``symbols`` (uint64, all sequences end to end)."""

    def __init__(self, symbols: np.ndarray):
        self._sum(symbols, lambda x, power: _halves(_product(_reduced(x), power)))

    @classmethod
    def of_bytes(cls, text: np.ndarray) -> Rolling:
        """The same over bytes (the symbol of a byte is its value plus one): the
        products are small enough to be summed before they are reduced."""
        out = cls.__new__(cls)

        def terms(x, power):
            x = x.astype(U) + U(1)
            low, high = _halves(power)
            return x * low, x * high

        out._sum(text, terms)
        return out

    def _sum(self, symbols: np.ndarray, terms) -> None:
        n = len(symbols)
        powers, carry = _powers(BASE, n), U(0)
        self.sums = np.zeros(n + 1, U)
        for lo in range(0, n, CHUNK):
            low, high = (np.cumsum(x) for x in terms(symbols[lo:lo + CHUNK], powers[lo:lo + CHUNK]))
            # high counts 2**32; its bits from 29 on count from 0 again
            part = _reduced(_reduced(low + ((high & U(0x1FFFFFFF)) << U(32))) + (high >> U(29)) + carry)
            self.sums[lo + 1:lo + 1 + len(part)] = part
            carry = part[-1]
        self.back = _powers(_INVERSE, max(n, 1))

    def at(self, pos: np.ndarray, length) -> np.ndarray:
        """Hashes of the windows ``[pos, pos + length)``."""
        out = np.empty(len(pos), U)
        for lo in range(0, len(pos), CHUNK):
            part = slice(lo, lo + CHUNK)
            start = pos[part]
            end = start + (length[part] if isinstance(length, np.ndarray) else length)
            out[part] = mix(_product(_reduced(self.sums[end] + (U(PRIME) - self.sums[start])), self.back[start]))
        return out

    def every(self, length: int) -> np.ndarray:
        """Hashes of all windows of one length, by start (sequence borders not
        respected: the caller masks them)."""
        return self.at(np.arange(max(0, len(self.sums) - length)), length)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Boolean mask of the positions inside any window ``[start, start + length)``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, total), -1)
    return np.cumsum(edge[:total]) > 0
