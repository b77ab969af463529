"""Words of many texts at once: hashes, places and owners as flat arrays, straight from an Arrow column's buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillspan.llm.common import WORD_GAP_CHARS

#: Bytes of text that are worked on together; a longer text is worked on by itself.
PIECE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in WORD_GAP_CHARS]] = True
_kept: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their differences over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _kept or len(_kept["up"]) < n:
        size = max(n, PIECE_BYTES * 2)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _kept[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
    return _kept["up"], _kept["down"]


class Words:
    """``first``: number of the first text; ``bytes``: their bytes; ``bounds``: where each text begins, and the end; ``start``, ``end``, ``hash``: of each word."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.bytes, self.bounds = first, data, bounds
        n = len(data)
        word = ~_GAP[data]
        begins = np.zeros(n + 1, bool)
        begins[bounds] = True
        before = np.concatenate([[False], word[:-1]]) & ~begins[:n]
        after = np.concatenate([word[1:], [False]]) & ~begins[1 : n + 1]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        up, down = _powers(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])


def flat_words(texts: pa.Array) -> Iterator[Words]:
    """The words of a string column in pieces; null texts are empty ones."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE_BYTES, "right")) - 1)
        yield Words(i, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j
