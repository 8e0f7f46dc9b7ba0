"""Hashed word shingles of whole texts, in numpy over the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tidemark.llm.words import distinct_words, raw_bytes

_RANDOM = np.random.default_rng(20_240_229)
PLACE = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+, A-Z lower-cased, and the texts' offsets in words. Each distinct word is
    hashed once, by a function whose collisions do not follow from a word's form."""
    dictionary, index, rows = distinct_words(pc.ascii_lower(texts))
    data, at = raw_bytes(dictionary)
    view, ends = memoryview(data), at.tolist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(ends, ends[1:])), np.uint64, len(dictionary))
    real = (np.diff(at) > 0)[index] if len(dictionary) else np.zeros(0, bool)
    return hashes[index[real]], np.concatenate(([0], np.cumsum(real)))[rows]


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, joined, and their offsets.

    A text of fewer than width words has its whole sequence as its one shingle; one without words has none.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    parts = []
    if len(words) >= width:
        h = words[: len(words) - width + 1] * PLACE[0]
        for k in range(1, width):
            h = h + words[k : len(words) - width + 1 + k] * PLACE[k]
        whole = row[: len(words) - width + 1] == row[width - 1 :]
        parts.append((mix(h[whole]), row[: len(h)][whole]))
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        h = n[short].astype(np.uint64) * PLACE[15]
        for k in range(width - 1):
            has = n[short] > k
            h[has] = h[has] + words[at[short[has]] + k] * PLACE[k]
        parts.append((mix(h), short))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    hashes, rows = (np.concatenate(x) for x in zip(*parts))
    if len(parts) == 2:
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    bounds = np.searchsorted(rows, np.arange(len(n) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    out = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(np.bincount(rows[keep], minlength=len(n)), out=out[1:])
    return hashes[keep], out
