"""Words and hashes of many texts at once, as numpy arrays, for use inside tasks.

Hashes are prefix sums of a polynomial modulo 2 ** 64 with a random value per byte, so that the
hash of any stretch is a difference of two sums; a final mix spreads them. They are the same in
every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15 | 5  # odd
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_powers = {b: np.ones(1, np.uint64) for b in (BASE, INVERSE)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); remembered up to a few million, made anew beyond."""
    known = _powers[base]
    if len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        if size <= 1 << 22:
            _powers[base] = known
    return known[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which `stretches` takes hashes; one longer than the values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def stretches(sums: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the values from first up to end, which depend on these values alone."""
    raw = (sums[end] - sums[first]) * powers(INVERSE, len(sums))[first]
    return mix(raw + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), seed)


@dataclass(frozen=True)
class Words:
    """Words of several texts: byte bounds in the joint bytes, hashes, and for each text the number
    of its first word (one more entry at the end)."""

    first: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    word_at: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words within one text."""
        starts = np.arange(len(self.hashes), dtype=np.int64)
        last = np.repeat(self.word_at[1:], np.diff(self.word_at))
        starts = starts[starts + n <= last]
        sums = prefix_sums(self.hashes)
        return starts, stretches(sums, starts, starts + n)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every n-word shingle; a text of fewer words, but some, is one shingle."""
        starts, hashes = self.windows(n)
        text = np.searchsorted(self.word_at, starts, "right") - 1
        count = np.diff(self.word_at)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            sums = prefix_sums(self.hashes)
            whole = stretches(sums, self.word_at[short], self.word_at[short + 1])
            text, hashes = np.concatenate([text, short]), np.concatenate([hashes, whole])
        return text, hashes


def split_words(text: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts whose bytes are text[offsets[i]:offsets[i + 1]]; A-Z lower-cased or not
    for the hashes."""
    solid = ~SPACE[text]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that have bytes
    before = np.zeros(len(solid), bool)
    before[1:] = solid[:-1]
    before[begin] = False
    first = np.flatnonzero(solid & ~before)
    after = np.zeros(len(solid), bool)
    after[:-1] = solid[1:]
    after[(offsets[1:] - 1)[offsets[:-1] < offsets[1:]]] = False
    end = np.flatnonzero(solid & ~after) + 1
    sums = prefix_sums(BYTE[LOWER[text] if lower else text])
    return Words(first, end, stretches(sums, first, end), np.searchsorted(first, offsets))


def distinct_pairs(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, hash) pairs, sorted."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]
