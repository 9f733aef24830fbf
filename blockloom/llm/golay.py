"""The perfect binary Golay code of length 23, as tables for fuzzy hashing.

A 23-bit word has either one codeword within distance 4, or six: its own at distance 3 and five at
distance 4. Words at most 2 bits apart share one of these codewords, because every word between them
has a codeword within 3. So the indices of the codewords within 4 are hash keys that forgive 2 errors.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed by the code).
GENERATOR = 0b110001110101
BITS, CHECKS, KEYS = 23, 11, 6


def _remainder(word: np.ndarray) -> np.ndarray:
    """Remainders of polynomials of degree under 23 by the generator: the syndromes."""
    word = word.copy()
    for bit in range(BITS - 1, CHECKS - 1, -1):
        word ^= ((word >> bit) & 1) * (GENERATOR << (bit - CHECKS))
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 12 high and of the 11 low bits, and each syndrome's error words of weight 4 or less, -1 for none."""
    high = _remainder(np.arange(1 << 12, dtype=np.int64) << CHECKS)
    low = _remainder(np.arange(1 << CHECKS, dtype=np.int64))
    errors = np.full((1 << CHECKS, KEYS), -1, np.int64)
    filled = np.zeros(1 << CHECKS, np.int64)
    for weight in range(5):
        words = np.array([sum(1 << b for b in bits) for bits in combinations(range(BITS), weight)], np.int64)
        for word, syndrome in zip(words.tolist(), _remainder(words).tolist(), strict=True):
            errors[syndrome, filled[syndrome]] = word
            filled[syndrome] += 1
    return high, low, errors


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For 23-bit words an (n, 6) array: 12-bit indices of the codewords within distance 4, -1 where fewer."""
    high, low, errors = tables()
    words = words.astype(np.int64)
    found = errors[high[words >> CHECKS] ^ low[words & ((1 << CHECKS) - 1)]]
    return np.where(found < 0, -1, (words[:, None] ^ found) >> CHECKS)
