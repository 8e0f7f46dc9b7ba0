"""SentencePiece encoding and decoding with a BPE model file, as a Viterbi walk over equal-length words together.

The pieces of such a model are ranked, not weighted: the best-scored path is not what the model's own encoder gives. A
piece sequence is the encoding exactly when each neighbouring pair is the encoding of its own two pieces (a merge across
a boundary would already happen in the pair alone), and each prefix has one encoding. So the lattice keeps the last
piece of every prefix, an edge is open when its piece pairs with that one, and the longest open edge, the only one, is
the backpointer. Whether two pieces pair is found by merging their characters once and then remembered.

A word longer than LONG is walked in overlapping rows of one length, all together. A position's backpointer depends on those
of the last `reach` positions alone, so a row that agrees with the row before it on that many positions goes on as the whole
word would. A row that does not is walked again from the true ones; at worst that is one row after the other.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.merges import NONE, PairTable, merge_words
from tidemark.llm.shingles import mix
from tidemark.llm.words import column, gather, raw_bytes, slices, texts_of

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Remembered pairs of pieces; beyond, the memory starts anew.
MOST_PAIRS = 1 << 20
#: Lengths beyond the first are filled up to a multiple of it; longest word that is walked in one row; new characters of a row of a longer one, and those that it shares with the row
#: before; all have many divisors, since a repeated pattern agrees where rows start at a multiple of its period. Rows at once.
STEP, LONG, ROW, SHARED, MOST_ROWS = 48, 288, 240, 96, 8192


class Pieces:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        plain = {n: i for i, n in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        raw = [b""] * self.size
        for n, i in plain.items():
            raw[i] = n.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)

        codes = {n: np.frombuffer(n.encode("utf-32-le"), np.uint32) for n in plain}
        self.char = np.arange(0x110000, dtype=np.int32) + self.size  # a character without a piece stands above all pieces
        for n, i in plain.items():
            if len(n) == 1:
                self.char[ord(n)] = i
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in {len(n) for n in plain}:
            some = [n for n in plain if len(n) == length]
            ids = np.array([plain[n] for n in some], dtype=np.int32)
            key = self._hash(np.stack([codes[n] for n in some]))
            order = np.argsort(key)
            self.keys[length] = key[order], ids[order]
        splits = [(plain[n[:k]], plain[n[k:]], i) for n, i in plain.items() for k in range(1, len(n)) if n[:k] in plain and n[k:] in plain]
        left, right, merged = (np.array(x, dtype=np.int64) for x in zip(*splits))
        score = np.array([model.get_score(i) for i in range(self.size)])
        self.table = PairTable(left, right, (-score[merged]).astype(np.int64), merged)

        flat = [self.char[codes[n]] for n in plain]
        at = np.concatenate(([0], np.cumsum([len(x) for x in flat])))
        self.spell, self.spell_at = np.zeros(0, np.int32), np.zeros(self.size + 1, np.int64)
        self.spell = np.concatenate(flat)
        lengths = np.zeros(self.size, np.int64)
        lengths[list(plain.values())] = np.diff(at)
        order = np.array(list(plain.values()))
        by_id = np.argsort(order)
        self.spell, _ = gather(self.spell, at, by_id)
        self.spell_at[1:] = np.cumsum(lengths)
        ids, found = merge_words(self.table, *gather(self.spell, self.spell_at, np.sort(order)))
        self.alone = np.zeros(self.size, dtype=bool)
        self.alone[np.sort(order)] = np.diff(found) == 1
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.pairs = PairTable(none, none, none, none, room=4 * MOST_PAIRS)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = h * BASE + mix(codes[:, k].astype(np.uint64) + np.uint64(1))
        return h

    def _pairing(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it (-1: none)."""
        out = np.where(before < 0, self.alone[piece], True)
        todo = np.flatnonzero((before >= 0) & (before < self.size))
        if not len(todo):
            return out
        a, b = before[todo].astype(np.int64), piece[todo].astype(np.int64)
        rank, ok = self.pairs.find(a, b)
        new = np.flatnonzero(rank == NONE)
        if len(new):
            key = np.unique(a[new] << 32 | b[new])
            x, y = key >> 32, key & 0xFFFFFFFF
            spelled, at = gather(self.spell, self.spell_at, np.stack((x, y), axis=1).ravel())
            ids, found = merge_words(self.table, spelled, at[::2])
            two = np.diff(found) == 2
            first = np.zeros(len(key), np.int64)
            first[two] = ids[found[:-1][two]]
            good = two & (first == x)
            if self.pairs.held + len(key) > MOST_PAIRS:
                self._forget()
                rank[:] = NONE
            self.pairs.put(x, y, np.ones(len(key), np.int64), good.astype(np.int64))
            ok[new] = good[np.searchsorted(key, a[new] << 32 | b[new])]
        out[todo] = ok == 1
        return out

    def _lattice(self, codes: np.ndarray, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(last, step) [position, word]: the last piece of each prefix and its length, for words as rows of code points.

        With seed, the last pieces up to its number of positions are given, and the walk goes on from there.
        """
        n, length = codes.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for k in range(length):
            prefix[k + 1] = prefix[k] * BASE + mix(codes[:, k].astype(np.uint64) + np.uint64(1))
        power = np.full(length + 1, BASE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        last = np.full((length + 1, n), -1, np.int32)
        step = np.zeros((length + 1, n), np.int32)
        first = 1
        if seed is not None:
            last[: len(seed)] = seed
            first = len(seed)
        for end in range(first, length + 1):
            open_ = np.arange(n)
            for size in sorted((s for s in self.keys if s <= end), reverse=True):
                if size == 1 or not len(open_):
                    break
                key, ids = self.keys[size]
                h = prefix[end][open_] - prefix[end - size][open_] * power[size]
                at = np.minimum(np.searchsorted(key, h), len(key) - 1)
                hit = np.flatnonzero(key[at] == h)
                if not len(hit):
                    continue
                rows, piece = open_[hit], ids[at[hit]]
                good = self._pairing(last[end - size][rows], piece)
                last[end][rows[good]] = piece[good]
                step[end][rows[good]] = size
                open_ = np.delete(open_, hit[good])
            last[end][open_] = self.char[codes[open_, end - 1]]
            step[end][open_] = 1
        return last, step

    def _same_length(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words (rows of code points, filled up to one length), joined, and their counts."""
        n, length = codes.shape
        last, step = self._lattice(codes)
        back = np.zeros((n, length), np.int32)
        count = np.zeros(n, np.int64)
        at, rows = lengths.copy(), np.arange(n)
        while len(rows):
            back[rows, length - 1 - count[rows]] = last[at, rows]
            count[rows] += 1
            at = at - step[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        return back[np.arange(length)[None, :] >= (length - count)[:, None]], count

    def _long(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of more than LONG code points each, joined, and their counts.

        Row k of a word covers its positions k * ROW to k * ROW + SHARED + ROW and is used for the last ROW of them.
        """
        reach, width = max(self.keys), SHARED + ROW
        n_rows = np.array([max(1, -(-(len(w) - SHARED) // ROW)) for w in words])
        owner = np.repeat(np.arange(len(words)), n_rows)
        lead = np.concatenate(([0], np.cumsum(n_rows)))
        codes = np.zeros((len(owner), width), np.uint32)
        for i, w in enumerate(words):
            full = np.zeros(n_rows[i] * ROW + SHARED, np.uint32)
            full[: len(w)] = w[: len(full)]
            codes[lead[i] : lead[i + 1]] = np.lib.stride_tricks.sliding_window_view(full, width)[::ROW]
        last = np.zeros((width + 1, len(owner)), np.int32)
        step = np.zeros((width + 1, len(owner)), np.int32)
        for a in range(0, len(owner), MOST_ROWS):
            last[:, a : a + MOST_ROWS], step[:, a : a + MOST_ROWS] = self._lattice(codes[a : a + MOST_ROWS])
        self._mend(codes, last, step, np.concatenate(([False], owner[1:] == owner[:-1])))
        flat, counts = [], np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            rows = slice(lead[i], lead[i + 1])
            pieces = np.concatenate((last[1 : SHARED + 1, lead[i]], last[SHARED + 1 :, rows].T.ravel()))[: len(w)].tolist()
            steps = np.concatenate((step[1 : SHARED + 1, lead[i]], step[SHARED + 1 :, rows].T.ravel()))[: len(w)].tolist()
            at, path = len(w), []
            while at > 0:
                path.append(pieces[at - 1])
                at -= steps[at - 1]
            flat.append(np.array(path[::-1], np.int32))
            counts[i] = len(path)
        return np.concatenate(flat), counts

    def _mend(self, codes: np.ndarray, last: np.ndarray, step: np.ndarray, inner: np.ndarray) -> None:
        """Makes last and step of all rows what they are in the whole words; inner tells which rows follow one of their word.

        Rows that start otherwise than the row before them ends are walked again from that, together, until none is left.
        What a row of certain characters gives from a certain start is remembered, so that a repeated pattern that never agrees
        is walked once, not row by row.
        """
        reach = max(self.keys)
        begins = last[SHARED - reach + 1 : SHARED + 1].T.copy()
        ends = last[len(last) - reach :].T.copy()
        known: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}
        while True:
            wrong = np.flatnonzero(inner)
            wrong = wrong[(begins[wrong] != ends[wrong - 1]).any(axis=1)]
            if not len(wrong):
                return
            todo = []
            for i in wrong.tolist():
                while True:
                    found = known.get((codes[i].tobytes(), ends[i - 1].tobytes()))
                    begins[i] = ends[i - 1]
                    if found is None:
                        todo.append(i)
                        break
                    last[SHARED + 1 :, i], step[SHARED + 1 :, i] = found
                    ends[i] = last[len(last) - reach :, i]
                    i += 1
                    if i == len(inner) or not inner[i] or (begins[i] == ends[i - 1]).all():
                        break
            todo = sorted(set(todo))
            for a in range(0, len(todo), MOST_ROWS):
                some = np.array(todo[a : a + MOST_ROWS])
                again, steps = self._lattice(codes[some, SHARED - reach + 1 :], begins[some].T)
                last[SHARED + 1 :, some], step[SHARED + 1 :, some] = again[reach:], steps[reach:]
                ends[some] = last[len(last) - reach :, some].T
                for i in some.tolist() if len(known) < MOST_ROWS else ():
                    known[codes[i].tobytes(), begins[i].tobytes()] = last[SHARED + 1 :, i].copy(), step[SHARED + 1 :, i].copy()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words (with their space marks), joined, and their offsets."""
        n = len(words)
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum(length)))
        flat, counts = [np.zeros(0, np.int32)], np.zeros(n, np.int64)
        order = np.argsort(length, kind="stable")
        filled = np.where(length <= STEP, length, -(-length // STEP) * STEP)  # few words are long, so their lengths are few too
        cuts = np.flatnonzero(np.diff(filled[order])) + 1
        for rows in np.split(order, cuts):
            size = int(filled[rows[0]]) if len(rows) else 0
            if not 0 < size <= LONG:
                continue
            most = max(1, 4_000_000 // size)
            for a in range(0, len(rows), most):
                some = rows[a : a + most]
                got, count = self._same_length(codes[np.minimum(at[some][:, None] + np.arange(size), len(codes) - 1)], length[some])
                flat.append(got)
                counts[some] = count
        far = order[length[order] > LONG]
        if len(far):
            got, counts[far] = self._long([codes[at[i] : at[i + 1]] for i in far])
            flat.append(got)
        begin = np.zeros(n + 1, np.int64)
        np.cumsum(counts[order], out=begin[1:])
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        ids, out = gather(np.concatenate(flat), begin, back)
        return self._bytes(ids, out)

    def _bytes(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids, at
        width = np.ones(len(ids), np.int64)
        code = ids[odd].astype(np.int64) - self.size
        width[odd] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ends = np.concatenate(([0], np.cumsum(width)))
        out = np.repeat(ids, width)
        raw = np.frombuffer("".join(map(chr, code)).encode("utf-8", "surrogatepass"), np.uint8)
        wide = np.zeros(len(ids), bool)
        wide[odd] = True
        out[np.repeat(wide, width)] = self.byte[raw]
        return out, ends[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, joined, and their offsets; a text is led by one space mark; the empty text has no ids."""
        parts = pc.split_pattern(texts, " ")
        rows = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = rows - rows[0]
        flat = parts.flatten()
        empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
        none = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        ends = np.zeros(len(flat) + 1, bool)
        ends[rows[1:]] = True
        keep = ~empty | ends[1:]  # runs of spaces lead the word after them, or end the text
        since = np.arange(len(flat)) - np.maximum.accumulate(np.where(np.concatenate(([True], keep[:-1])), np.arange(len(flat)), 0)) if len(flat) else np.zeros(0, np.int64)
        coded = flat.filter(pa.array(keep)).dictionary_encode()
        index, marks = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), since[keep] + 1
        kinds, which = np.unique(index << 32 | marks, return_inverse=True)
        names = coded.dictionary.to_pylist()
        words = pa.array([SPACE * m + names[i].replace(" ", SPACE) for i, m in zip((kinds >> 32).tolist(), (kinds & 0xFFFFFFFF).tolist())], pa.string())
        ids, at = self.words(words)
        got, each = gather(ids, at, which)
        starts = each[np.concatenate(([0], np.cumsum(keep)))[rows]]
        if not none.any():
            return got, starts
        return _without(got, starts, none)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all sequences, joined, and their offsets; the leading space of each is taken off."""
        raw, each = gather(self.raw, self.raw_at, ids)
        begin, end = each[at[:-1]], each[at[1:]]
        lead = (end > begin) & (raw[np.minimum(begin, max(len(raw) - 1, 0))] == 32) if len(raw) else np.zeros(len(begin), bool)
        keep = np.ones(len(raw), bool)
        keep[begin[lead]] = False
        out = np.zeros(len(at), np.int64)
        np.cumsum(end - begin - lead, out=out[1:])
        return raw[keep], out


def _without(ids: np.ndarray, at: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences with those marked none made empty."""
    n = np.diff(at)
    keep = np.repeat(~none, n)
    return ids[keep], np.concatenate(([0], np.cumsum(np.where(none, 0, n))))


@lru_cache(maxsize=1)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> for every row, repeated ones each; null and empty texts have no ids, null ids stay null, an empty
    table gives no rows; other columns are ignored. A word of a megabyte takes seconds."""

    def run(batches):
        pieces = load(model)
        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                ids, at = pieces.encode(texts_of(batch, "text"))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text from (doc_id, ids) for every row, repeated ones each; a null list gives an empty text, a null doc_id stays
    null, an empty table gives no rows."""

    def run(batches):
        pieces = load(model)
        for batch in batches:
            lists = pc.fill_null(column(batch, "ids"), pa.scalar([], pa.list_(pa.int32())))
            at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            raw, out = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False), at - at[0])
            texts = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(out), pa.py_buffer(raw)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), texts], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (pieces that stand for single bytes), ids_crc32, round_trip for every row, repeated ones each.

    Null and empty texts have no pieces and make the round trip; null ids stay null; an empty table gives no rows.
    ids_crc32 is over little-endian unsigned 32-bit ids. round_trip tells whether the decoded bytes are the text's; it
    is false only where a text holds the space mark itself, which decodes to a space.
    """

    def run(batches):
        pieces = load(model)
        single = np.zeros(pieces.size, np.int64)
        single[pieces.byte] = 1
        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                texts = texts_of(batch, "text")
                ids, at = pieces.encode(texts)
                raw, out = pieces.decode(ids, at)
                data, data_at = raw_bytes(texts)
                flat = np.ascontiguousarray(ids, dtype="<u4")
                byte_count = np.concatenate(([0], np.cumsum(single[ids])))
                rows = [(zlib.crc32(flat[a:b]), np.array_equal(raw[c:d], data[e:f])) for a, b, c, d, e, f in zip(at, at[1:], out, out[1:], data_at, data_at[1:])]
                crc, same = zip(*rows)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(at)), pa.array(byte_count[at[1:]] - byte_count[at[:-1]]), pa.array(crc, pa.int64()), pa.array([bool(x) for x in same])], names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean")
