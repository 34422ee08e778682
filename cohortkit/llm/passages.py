"""Byte windows of texts: anchors and substring hashes, vectorised with numpy."""

from __future__ import annotations

import numpy as np

from cohortkit.llm.hashing import BASE, BYTE_VALUES, mix, powers

GRAM = 64  # bytes of the string that an anchor is chosen by
CHUNK = 1 << 18  # windows handled at once, so memory does not follow the text's length


class Hashes:
    """Polynomial hashes of the substrings of a byte array."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * self.up[:len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * BASE)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(text: bytes, length: int) -> list[np.ndarray]:
    """Runs of windows of ``length`` bytes that share an anchor: (at, low, high, gram, context).

    The anchor of a window is its leftmost GRAM-byte string of smallest hash, so equal windows have equal
    anchors at the same offset. ``at`` is the anchor's start, ``low`` .. ``high`` the starts of the run's windows, ``gram``
    the hash of the anchor's string, ``context`` the hash of the run's bytes and of the anchor's place in it.
    """
    gram = min(GRAM, max(1, length // 2))
    parts = []
    for first in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(len(text) - first, CHUNK + length - 1), first)
        hashes = Hashes(data)
        start = np.arange(len(data) - gram + 1)
        grams = hashes.of(start, start + gram)
        # 40 bits of the hash, then the place: the minimum is the leftmost of the smallest
        ranked = (grams >> np.uint64(24) << np.uint64(24)) | start.astype(np.uint64)
        at = (window_minima(ranked, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        low = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        high = np.concatenate([low[1:] - 1, [len(at) - 1]])
        place = at[low]
        context = hashes.of(low, high + length) ^ mix(((place - low) * length + (high - low)).astype(np.uint64))
        parts.append((place + first, low + first, high + first, grams[place], context))
    if not parts:
        return [np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    return [np.concatenate(x) for x in zip(*parts)]
