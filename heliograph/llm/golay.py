"""The binary Golay code of 23 bits: decoding, and the codewords near a word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BITS, MESSAGE = 23, 12
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 single bits; the error pattern of each of the 2,048 syndromes (at most three bits)."""
    single = np.array([_remainder(1 << b) for b in range(BITS)], np.int32)
    errors = np.zeros(1 << 11, np.int32)
    for i in range(BITS):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, errors


def syndromes(words: np.ndarray) -> np.ndarray:
    single, _ = tables()
    out = np.zeros(len(words), np.int32)
    for b in range(BITS):
        out ^= np.where(words >> b & 1, single[b], 0).astype(np.int32)
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword within three bits of each word; there is exactly one."""
    return (words ^ tables()[1][syndromes(words)]) >> 11


def near(words: np.ndarray) -> np.ndarray:
    """Codeword indices of each word and of the 23 words one bit away, sorted; repeats of an index are -1.

    A word within two bits of a codeword has this one index; any other has six. Two words at most two bits apart
    share an index: that of a word between them.
    """
    single, errors = tables()
    around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(BITS))], axis=1)
    own = syndromes(words)
    near_by = np.concatenate([own[:, None], own[:, None] ^ single], axis=1)
    found = np.sort((around ^ errors[near_by]) >> 11, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
