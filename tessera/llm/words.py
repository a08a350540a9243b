"""Words of many texts at once as 64-bit hashes.

Words are runs of bytes outside [\\x20\\x09-\\x0D] with A-Z lowered. A batch is one byte string; the hash of a word is a
polynomial over random values of its bytes, taken for all words by one pass and a segmented sum, and then mixed.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at a time; a longer text is taken whole.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of a published generator)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64."""
    if len(_powers.get(name, ())) < n:
        made = np.full(max(n, SLICE_BYTES + (1 << 16)), base, U64)
        made[0] = 1
        _powers[name] = np.multiply.accumulate(made)
    return _powers[name][:n]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in order, and the number of words of each text."""
    joined = b" ".join(texts).translate(_LOWER)
    if not joined:
        return np.empty(0, U64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(joined, np.uint8)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U64), np.zeros(len(texts), np.int64)
    values = _VALUE[raw]
    values *= _power(_BASE, "base", len(raw))
    values[~word] = 0
    out = np.add.reduceat(values, starts)
    del values
    out *= _power(_INVERSE, "inverse", len(raw))[starts]
    out = mix(out + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))
    if len(_powers["base"]) > 4 * SLICE_BYTES:  # after a very long text
        _powers.clear()
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    before = np.searchsorted(starts, ends_of_texts)
    return out, np.diff(before, prepend=0)
