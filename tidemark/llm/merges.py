"""Byte-pair merging of many words at once in numpy: every word takes its best merge in each round."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class PairTable:
    """Rank and result of each mergeable pair of ids, in an open-addressing table probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, room: int = 0):
        bits = max(8, int(max(len(left) * 8, room) - 1).bit_length())
        self.shift, self.mask, self.held = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, NONE, dtype=np.int32)
        self.merged = np.zeros(1 << bits, dtype=np.int32)
        self.put(left, right, rank, merged)

    def put(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        """Adds pairs that are not in the table; each once."""
        self.held += len(left)
        key, todo = left.astype(np.int64) << 32 | right.astype(np.int64), np.arange(len(left))
        slot = self._slot(left, right)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            _, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = key[put], rank[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            taken = self.keys[slot[todo]] != -1
            slot[todo[taken]] = (slot[todo[taken]] + 1) & self.mask

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.uint64) * _A ^ right.astype(np.uint64) * _B) * _A >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; NONE where the pair does not merge."""
        key, slot = left.astype(np.int64) << 32 | right.astype(np.int64), self._slot(left, right)
        got = self.keys[slot]
        todo = np.flatnonzero((got != key) & (got != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            got = self.keys[slot[todo]]
            todo = todo[(got != key[todo]) & (got != -1)]
        miss = self.keys[slot] == -1
        return np.where(miss, NONE, self.rank[slot]), self.merged[slot]


def merge_words(table: PairTable, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges each word (ids[offsets[i]:offsets[i+1]], none empty) until no pair of it is in the table.

    A round merges the leftmost pair of the lowest rank in every word that still has one; finished words leave.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    done_ids, done_words, done_lengths = [], [], []
    sym, owner = ids.astype(np.int32), np.repeat(np.arange(n), lengths)
    rank, new = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inside], new[inside] = table.find(sym[inside], sym[inside + 1])
    while len(sym):
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.append(start, len(sym)))
        best = np.minimum.reduceat(rank, start)
        ended = best == NONE
        if ended.any():
            out = np.repeat(ended, size)
            done_ids.append(sym[out])
            done_words.append(owner[start[ended]])
            done_lengths.append(size[ended])
            sym, owner, rank, new, best, size = sym[~out], owner[~out], rank[~out], new[~out], best[~ended], size[~ended]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        hit = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]
        sym[hit] = new[hit]
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        place = hit - np.arange(len(hit))  # one symbol leaves each word
        sym, owner, rank, new = sym[keep], owner[keep], rank[keep], new[keep]
        last = np.append(owner[1:] != owner[:-1], True)
        before = place - 1
        before = before[(place > 0) & (owner[before] == owner[place])]
        again = np.concatenate((before, place))
        rank[again] = NONE
        again = again[~last[again]]
        rank[again], new[again] = table.find(sym[again], sym[again + 1])
    words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    sizes = np.concatenate(done_lengths) if done_lengths else np.zeros(0, np.int64)
    flat = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int32)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(words)
    out = np.zeros(n + 1, dtype=np.int64)
    out[1 + words] = sizes
    np.cumsum(out, out=out)
    at = np.repeat(begin[order] - out[words[order]], sizes[order]) + np.arange(len(flat))
    return flat[at], out
