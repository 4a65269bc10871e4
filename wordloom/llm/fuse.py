"""Static binary-fuse filters: a few bytes per key answer "surely not there" or "perhaps there".

Three places of one fingerprint table, which lie in neighbouring segments, combine by XOR to a key's
fingerprint. Building peels keys that are alone in a place, all such keys of a round at once.
"""

from __future__ import annotations

import math

import numpy as np

from .words import mix

_U = np.uint64
KIND = np.uint16


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for n keys."""
    if n < 2:
        return 4, 3
    length = 1 << max(2, min(18, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(3, -(-round(n * factor) // length))


def _places(hashes: np.ndarray, length: int, segments: int) -> np.ndarray:
    start = ((hashes >> _U(32)) * _U((segments - 2) * length)) >> _U(32)
    mask = _U(length - 1)
    one = (start + _U(length)) ^ ((hashes >> _U(18)) & mask)
    two = (start + _U(2 * length)) ^ (hashes & mask)
    return np.stack((start, one, two)).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> _U(48)).astype(KIND)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, number of segments and table of a set of 64-bit keys."""
    keys = np.unique(keys.astype(_U))
    n = len(keys)
    length, segments = _shape(n)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += max(1, segments // 8)
        hashes = mix(keys ^ mix(np.array([seed], _U))[0])
        places = _places(hashes, length, segments)
        size = length * segments
        degree = np.bincount(places.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # XOR of the keys' numbers in each place
        for line in places:
            np.bitwise_xor.at(held, line, np.arange(n))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        left = n
        singles = np.flatnonzero(degree == 1)
        while len(singles):
            found, first = np.unique(held[singles], return_index=True)
            rounds.append((found, singles[first]))
            left -= len(found)
            for line in places:
                np.subtract.at(degree, line[found], 1)
                np.bitwise_xor.at(held, line[found], found)
            touched = np.unique(places[:, found])
            singles = touched[degree[touched] == 1]
        if left:
            continue
        table = np.zeros(size, KIND)
        prints = _prints(hashes)
        for found, at in reversed(rounds):
            own = prints[found].copy()
            for line in places:
                # The key's free place still holds 0 and does not count.
                own ^= table[line[found]]
            table[at] = own
        return seed, length, segments, table.tobytes()
    raise RuntimeError("no seed gives a filter for these keys")


def contains(filter_: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """True for every key that was built in, and for about one in 65,536 others."""
    seed, length, segments, data = filter_
    table = np.frombuffer(data, KIND)
    hashes = mix(keys.astype(_U) ^ mix(np.array([seed], _U))[0])
    zero, one, two = _places(hashes, length, segments)
    return (table[zero] ^ table[one] ^ table[two]) == _prints(hashes)
