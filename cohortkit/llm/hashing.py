"""64-bit hashes of words and word shingles over whole texts, vectorised with numpy.

A word is a run of other bytes than ASCII white space. The hash of a word is a polynomial over random
64-bit byte values (arithmetic modulo 2**64) with a final mix; a shingle combines the hashes of its
words in order. Equal words have equal hashes in any process; different ones collide with a chance of
about 2**-64.
"""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 18  # bytes that are hashed at once, so memory does not follow the text's length


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every output bit depends on every input bit."""
    return mixed(x.astype(np.uint64, copy=True))


def mixed(x: np.ndarray) -> np.ndarray:
    """:func:`mix` in place."""
    shifted = x >> np.uint64(30)
    x ^= shifted
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=shifted)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=shifted)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_VALUES = stream(1, 256)
BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0 .. BASE**(n-1) and their inverses modulo 2**64; kept per process."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, factor in (("up", BASE), ("down", inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _chunk_words(data: np.ndarray) -> np.ndarray:
    word = ~IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * up, dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word, in order."""
    if len(text) <= CHUNK:
        return _chunk_words(np.frombuffer(text, np.uint8))
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and text[end] not in SPACES:  # a chunk ends between words
            end += 1
        parts.append(_chunk_words(np.frombuffer(text[at:end], np.uint8)))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the ``words``-word shingles; with fewer words, of the whole
    sequence as one; empty without a word."""
    hashes = word_hashes(text.lower()) if text else np.empty(0, np.uint64)  # bytes: lowers A-Z alone
    n = min(words, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * BASE + hashes[k:len(hashes) - n + 1 + k])
    return np.unique(out)
