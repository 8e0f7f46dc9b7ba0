"""Packing documents into token windows by Karmarkar-Karp differencing.

Each task encodes its rows, cuts them into pieces and packs the pieces of a bounded group of windows at a time; nothing
is shuffled, and a source or key that holds a third of the rows changes nothing.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm import word_bpe
from tidemark.llm.words import column, slices, texts_of

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Multiway differencing: a window 0..k-1 for each size, with near-equal sums.

    A partial partition holds its non-empty windows by falling sum, each with the head and tail of a linked list of
    items. The two partitions of the largest spread merge, the fullest windows of one on the emptiest of the other.
    """
    n = len(sizes)
    follow = np.full(n, -1, dtype=np.int64)
    heap = []
    for i in np.argsort(-sizes, kind="stable"):
        one = np.array([i])
        heap.append((-int(sizes[i]), int(i), sizes[i : i + 1].astype(np.int64), one, one))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, sa, ha, ta = heapq.heappop(heap)
        _, _, sb, hb, tb = heapq.heappop(heap)
        sb, hb, tb = sb[::-1], hb[::-1], tb[::-1]
        over = max(0, len(sa) + len(sb) - k)
        a = len(sa) - over
        follow[ta[a:]] = hb[:over]
        sums = np.concatenate((sa[:a], sa[a:] + sb[:over], sb[over:]))
        heads = np.concatenate((ha, hb[over:]))
        tails = np.concatenate((ta[:a], tb))
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, tie, sums, heads[order], tails[order]))
    window = np.empty(n, dtype=np.int64)
    at = heap[0][3]
    which = np.arange(len(at))
    while len(at):
        window[at] = which
        at = follow[at]
        which, at = which[at >= 0], at[at >= 0]
    return window


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each size so that no window exceeds capacity; the window count rises until that holds."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    k = -(-int(sizes.sum()) // capacity)
    while True:
        window = difference(sizes, k)
        if np.bincount(window, weights=sizes).max() <= capacity:
            return window
        k += max(1, k // 256)


def cut(n: int, capacity: int, most: int) -> list[int]:
    """Lengths of a document's pieces: whole windows, then near-equal pieces of at most `most`."""
    full, rest = divmod(n, capacity)
    parts = -(-rest // most)
    return [capacity] * full + [rest // parts + (i < rest % parts) for i in range(parts)]


def pack_documents(docs: DataFrame, vocabulary: str, eos: int = 1, capacity: int = 2048, most_piece: int = 512, group_windows: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and eos; a null or empty text is eos alone. Windows hold at most `capacity` ids;
    offsets run from 0 without gaps. A group takes pieces until they would fill group_windows windows, which bounds
    memory; a task's last group holds what is left. Ids are unique per task: partition number, then a counter. Repeated
    rows and null ids are packed like any other; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        bpe = word_bpe.load(vocabulary)
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[list] = [[], [], [], [], []]  # doc_id, start, length, crc, doc_tokens
        waiting = 0

        def emit(rows, windows):
            nonlocal made
            doc, start, length, crc, total = rows
            length = np.array(length, dtype=np.int64)
            order = np.argsort(windows, kind="stable")
            before = np.zeros(len(length), dtype=np.int64)
            before[1:] = np.cumsum(length[order])[:-1]
            first = np.searchsorted(windows[order], windows[order])
            offset = np.empty(len(length), dtype=np.int64)
            offset[order] = before - before[first]
            _, dense = np.unique(windows, return_inverse=True)
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, base + made + dense, offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            made += int(dense.max()) + 1
            return out

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = bpe.encode(texts_of(batch, "text"))
                full: list[list] = [[], [], [], [], []]
                end = np.array([eos], dtype="<u4")
                for doc, a, b in zip(column(batch, "doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    own = np.concatenate((ids[a:b], end)).astype("<u4", copy=False)
                    s = 0
                    for n in cut(len(own), capacity, most_piece):
                        rows = full if n == capacity else held
                        for x, v in zip(rows, (doc, s, n, zlib.crc32(own[s : s + n]), len(own))):
                            x.append(v)
                        s += n
                        waiting += n if rows is held else 0
                    if waiting >= group_windows * capacity:
                        yield emit(held, pack(np.array(held[2], dtype=np.int64), capacity))
                        held, waiting = [[], [], [], [], []], 0
                if full[0]:
                    yield emit(full, np.arange(len(full[0])))
        if held[0]:
            yield emit(held, pack(np.array(held[2], dtype=np.int64), capacity))

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)
