"""The perfect binary Golay code on 23 bits, as tables for fuzzy keys."""

from __future__ import annotations

import functools
import itertools

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS = 23
CHECK_BITS = 11
#: Fuzzy keys of a word, at most: its codeword, or those of the six that are near words half-way.
MAX_KEYS = 6


def syndrome(word: int) -> int:
    """Remainder of a word by the generator: zero for codewords."""
    for bit in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@functools.lru_cache(maxsize=1)
def key_errors() -> np.ndarray:
    """For each of the 2048 syndromes the error patterns that lead to a key's codeword, padded with -1.

    A word up to 2 bits off its codeword has that one; a word 3 bits off also has
    the five codewords 4 bits off. Words that differ in 2 bits or fewer share a
    codeword so (tests/llm/test_vector_ops.py tries all).
    """
    bit = [syndrome(1 << b) for b in range(BITS)]
    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for places in itertools.combinations(range(BITS), weight):
            s = functools.reduce(lambda a, b: a ^ bit[b], places, 0)
            if weight < 4 or found[s] and found[s][0].bit_count() == 3:
                found[s].append(sum(1 << b for b in places))
    table = np.full((1 << CHECK_BITS, MAX_KEYS), -1, np.int64)
    for s, patterns in enumerate(found):
        table[s, : len(patterns)] = patterns
    return table


@functools.lru_cache(maxsize=1)
def syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all values of the low 12 and the high 11 bits; a word's is the exclusive or of both."""
    low = np.array([syndrome(x) for x in range(1 << 12)], np.int64)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int64)
    return low, high


def keys(words: np.ndarray) -> np.ndarray:
    """Codeword indices (12 bits) of an array of 23-bit words: shape (n, 6), padded with -1."""
    low, high = syndromes()
    words = words.astype(np.int64)
    errors = key_errors()[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)
