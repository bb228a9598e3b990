"""64-bit hashes of words, and mixers that deal them anew."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


class WordHash:
    """64-bit hashes of words, those of up to `remembered` words remembered."""

    def __init__(self, remembered: int = 150_000):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        return np.fromiter(map(known.__getitem__, words), _U, len(words))

    @staticmethod
    def within(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int = 500_000) -> np.ndarray:
        """64-bit hashes of the words that lie in an array of code points, A-Z as a-z: other ones than `of` gives, without a look-up for each word.

        A word's hash is a polynomial of its code points' hashes: a difference of two sums up to a place, moved to the word's begin by a
        power of the inverse. It is done for words within about `size` code points at a time.
        """
        out, a = np.empty(len(begins), _U), 0
        while a < len(begins):
            b = max(a + 1, int(np.searchsorted(ends, begins[a] + size, "right")))
            low, high = int(begins[a]), int(ends[b - 1])
            up, down = _powers(max(size, high - low))
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(_of_code_points()[codes[low:high]] * up[: high - low], out=sums[1:])
            out[a:b] = (sums[ends[a:b] - low] - sums[begins[a:b] - low]) * down[begins[a:b] - low]
            a = b
        return mixed(out, 6)


@lru_cache(maxsize=1)
def _of_code_points() -> np.ndarray:
    codes = np.arange(1, 0x110001, dtype=_U)
    codes[65:91] = codes[97:123]
    return mixed(mixed(codes, 0), 1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse."""
    base = 0xD1342543DE82EF95
    found = np.full((2, n), base, _U)
    found[1] = pow(base, -1, 1 << 64)
    found[:, 0] = 1
    return np.cumprod(found[0]), np.cumprod(found[1])


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes dealt anew, by the k-th of eight mixers; one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(31))) * _U(_MIX[k % 8])
    return h ^ (h >> _U(29))
