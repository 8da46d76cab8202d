"""The perfect binary Golay code of 23 bits: 4,096 codewords, every word within 3 errors of exactly one."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code (fixed value).
_GENERATOR = 0b110001110101


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(index of the codeword nearest to each 23-bit word, distance to it)."""
    message = np.arange(4096, dtype=np.int64)
    words = message << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (_GENERATOR << (bit - 11)), rest)
    words |= rest
    index, distance = np.full(1 << 23, -1, np.int16), np.zeros(1 << 23, np.int8)
    bits = 1 << np.arange(23, dtype=np.int64)
    errors = [np.zeros(1, np.int64), bits]
    errors.append(np.array([a | b for i, a in enumerate(bits) for b in bits[:i]]))
    errors.append(np.array([a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]))
    for weight, es in enumerate(errors):
        for e in es:
            index[words ^ e], distance[words ^ e] = message, weight
    return index, distance


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word and of all words one error away: (row, index), without repeats.

    A word within 2 errors of a codeword gives that one index, any other gives 6. Two words that differ in at most 2 bits
    have a word at most one error from both, so they always share an index.
    """
    index, distance = tables()
    own = index[words]
    far = np.nonzero(distance[words] == 3)[0]
    near = index[words[far][:, None] ^ (1 << np.arange(23, dtype=words.dtype))[None, :]]
    near = np.sort(near, axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    first &= near != own[far][:, None]
    r, c = np.nonzero(first)
    return np.concatenate([np.arange(len(words)), far[r]]), np.concatenate([own, near[r, c]])
