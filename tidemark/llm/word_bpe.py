"""Encoding with a word-end BPE vocabulary file, each distinct word of a batch once."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.merges import PairTable, merge_words
from tidemark.llm.words import distinct_words, gather

#: Between words while they are normalised together; words that hold it, or white space on which libraries differ, go alone.
MARK = "\x00"
ODD = regex.compile(r"[\x00\x1c-\x1f\x85᠎​⁠﻿]")
#: Fixed value: the vocabulary's own pre-token pattern, with MARK as a token.
PRE_TOKEN = regex.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}\x00]+")


class WordBpe:
    """White space never reaches a token of this vocabulary, so a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab = model["vocab"]
        byte_chars = {}
        for code in range(256):  # the byte-level alphabet: a printable character for each byte
            byte_chars[code] = chr(code) if 33 <= code <= 126 or 161 <= code <= 172 or 174 <= code <= 255 else None
        spare = iter(range(256, 512))
        byte_chars = {code: c or chr(next(spare)) for code, c in byte_chars.items()}
        assert set(byte_chars.values()) == set(pre_tokenizers.ByteLevel.alphabet())
        self.inner = np.array([vocab[byte_chars[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[byte_chars[b] + "</w>"] for b in range(256)], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, merged = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        self.table = PairTable(left, right, np.arange(len(pairs)), merged)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        offsets = np.zeros(len(found) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        return np.fromiter((i for x in found for i in x), dtype=np.int32, count=int(offsets[-1])), offsets

    def _normal(self, text: str) -> str:
        if unicodedata.is_normalized("NFC", text) and "Σ" not in text:  # str.lower looks at a sigma's neighbours
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def _pre_tokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate(([0], np.cumsum(pc.binary_length(tokens).to_numpy(zero_copy_only=False), dtype=np.int64)))
        raw = np.frombuffer(b"".join(tokens.cast(pa.binary()).to_pylist()), dtype=np.uint8)
        ids = self.inner[raw]
        ids[at[1:] - 1] = self.last[raw[at[1:] - 1]]
        return merge_words(self.table, ids, at)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, joined, and their offsets."""
        odd = [i for i, w in enumerate(words) if ODD.search(w)] if ODD.search("\n".join(words)) else []
        alone = [words[i] for i in odd]
        for i in odd:
            words[i] = ""
        parts = pa.array(PRE_TOKEN.findall(self._normal(MARK.join(words))), pa.string()).dictionary_encode()
        codes = parts.indices.to_numpy(zero_copy_only=False)
        mark = pc.index(parts.dictionary, MARK).as_py()
        ids, offsets = self._pre_tokens(parts.dictionary)
        owner = np.cumsum(codes == mark)
        real = codes != mark
        flat, at = gather(ids, offsets, codes[real])
        per_word = np.bincount(owner[real], weights=np.diff(at), minlength=len(words)).astype(np.int64)
        out = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(per_word, out=out[1:])
        if alone:
            more, more_at = self._each(alone)
            where = np.arange(len(words))
            where[odd] = len(words) + np.arange(len(odd))
            flat, out = gather(np.concatenate((flat, more)), np.concatenate((out, out[-1] + more_at[1:])), where)
        return flat, out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and their offsets. Empty texts have no ids."""
        dictionary, index, rows = distinct_words(texts)
        if not len(index):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ids, at = self.words(dictionary.to_pylist())
        flat, each = gather(ids, at, index)
        return flat, each[rows]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)
