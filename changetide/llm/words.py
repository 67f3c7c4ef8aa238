"""Texts, words and word windows as hashes, inside tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
#: Texts that are worked on, and handed back, at once.
TEXTS = 256


def slices(batches):
    """Batches of few texts, so that neither side of the exchange with Python holds much derived from them at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; one-to-one."""
    values = (values ^ (values >> _HALF)) * _MIX
    values = (values ^ (values >> _HALF)) * _MIX
    return values ^ (values >> _HALF)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word; words are what ASCII white space parts."""
    words = data.split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of so many words, in order."""
    count = len(words) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = words[:count].copy()
    for i in range(1, width):
        out *= _STEP
        out += words[i : i + count]
    return mixed(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct window hashes of a text with A-Z lower-cased; a shorter text is one window."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(windows(words, min(width, len(words)))) if len(words) else words
