"""Hashed word shingles of whole texts, many texts at a time: the common ground of the word-based operators."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Also all other ASCII bytes that are neither letters nor digits.
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[:128] = [not chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of the hash base and of its inverse, as far as any text so far needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_powers = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i], times down-power i, the hash of bytes i to j."""
    up, _ = _powers.to(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers.to(len(h))
    return mix((h[ends] - h[starts]) * down[starts])


#: A prime, and two bases, for hashes that have no equal sums as powers modulo 2**64 have for some long strings.
_PRIME = np.uint64(2**31 - 1)
_PRIME_BASES = (1_220_703_133, 48_271)


@lru_cache(maxsize=8)
def _prime_powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo the prime."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, int(_PRIME))) % _PRIME
        have += more
    return out


def prime_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62 bits of each span of data, which has 2**24 bytes at most, by polynomials modulo a prime at two bases."""
    size = 1 << max(20, int(len(data) + 1).bit_length())
    out = np.zeros(len(starts), np.uint64)
    for base in _PRIME_BASES:
        powers = _prime_powers(base, size)
        h = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=h[1:])
        back = _prime_powers(pow(base, -1, int(_PRIME)), size)  # so that equal bytes have equal sums wherever they stand
        sums = (h[ends] - h[starts]) % _PRIME * back[starts] % _PRIME
        out = out << np.uint64(31) | sums
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEPARATORS, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: (A-Z lower-cased bytes, word starts, word ends, index of each text's first word, one more at the end).

    Words are runs without separators, by default space, tab, line feed, vertical tab, form feed and carriage return; none
    crosses two texts. With wide, typographic punctuation (U+2000 to U+206F, U+3000 to U+303F) separates, too, and each
    character from U+3040 to U+9FFF is a word.
    """
    data = _LOWER[data]
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    alone = np.flatnonzero((data >= 0xE2) & (data <= 0xE9)) if wide else np.zeros(0, np.int64)
    if len(alone):
        second = data[alone + 1]
        marks = alone[(data[alone] == 0xE2) & (second <= 0x81) | (data[alone] == 0xE3) & (second == 0x80)]
        inside[marks] = inside[marks + 1] = inside[marks + 2] = False
        alone = alone[data[alone] >= 0xE3]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    inner = offsets[offsets < len(data)]
    before[inner] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    last = inner[inner > 0] - 1
    after[last] = False
    if len(alone):
        before[alone] = after[alone + 2] = False
        before[alone[alone + 3 < len(data)] + 3] = after[alone[alone > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


#: A number for every byte at each of the first places in a word; those further on are made when they are met.
_PLACES = 64
_PLACED = mix(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(0x51_7CC1_B727_220A_95))


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEPARATORS, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of each text's first word)

    A word's hash is the sum of random numbers, one for each byte and place: unlike powers of one base, which have equal sums
    for some long words whatever the base is.
    """
    data, starts, ends, first = words(data, offsets, separators, wide)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum()))
    place = within - np.repeat(before, lengths)
    code = (place << 8) + data[within + np.repeat(starts - before, lengths)]
    values = _PLACED[np.minimum(code, len(_PLACED) - 1)]
    if lengths.max() > _PLACES:
        far = np.flatnonzero(place >= _PLACES)
        values[far] = mix(code[far].astype(np.uint64) + np.uint64(0x51_7CC1_B727_220A_95))
    return mix(np.add.reduceat(values, before)), first


def fold(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each of starts on."""
    h = np.full(len(starts), n, np.uint64)
    for k in range(n):
        h = h * _FOLD + hashes[starts + k]
    return mix(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text.

    A text with fewer words, but one at least, has the hash of the whole sequence; without words its set is empty.
    """
    hashes, first = word_hashes(data, offsets)
    counts = np.diff(first)
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(counts)
    if len(hashes) >= n:
        rolled = fold(hashes, np.arange(len(hashes) - n + 1), n)
        for i in np.flatnonzero(counts >= n):
            h = np.sort(rolled[first[i] : first[i + 1] - n + 1])
            sets[i] = h if len(h) < 2 else h[np.concatenate([[True], h[1:] != h[:-1]])]
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        for i, h in zip(few, fold(hashes, first[few], k), strict=True):
            sets[i] = np.array([h], np.uint64)
    return sets
