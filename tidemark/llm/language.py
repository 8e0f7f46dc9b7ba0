"""Language identification with hyperdimensional profiles: random letter vectors, permuted and bound into trigram
vectors, bundled over all training words of a language into its prototype, and compared by cosine.

Bundling is a sum, so a document's products with the prototypes are the sums of its words' products, and each distinct
word of a batch is looked at once. The document's own length scales all cosines alike: it changes neither the order
nor the score, which is the best cosine's share of the positive ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import column, distinct_words, slices, texts_of

DIMENSIONS, SYMBOLS, NGRAM = 1024, 1024, 3
EDGE = 0  # the symbol around a word
UNKNOWN = "und"
#: Trigrams whose products a task keeps; beyond that it starts anew.
MOST_KEPT = 1 << 20
#: Fixed value: no letter is assigned from this code point on.
LAST = 0x34000


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point: a-z and the letters of Latin-1 have their own, those of other scripts one by residue,
    so that letters of one script differ; -1 for no letter."""
    out = np.full(LAST + 1, -1, dtype=np.int16)
    for code in range(LAST):
        ch = chr(code)
        if not ch.isalpha():
            continue
        low = ord(ch.lower()[0])
        if 97 <= low <= 122:
            out[code] = low - 96
        elif 0xDF <= low <= 0xFF:
            out[code] = 27 + low - 0xDF
        else:
            out[code] = 60 + low % (SYMBOLS - 60)
    return out


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(20_240_417).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMENSIONS))


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of each word's letters between two edges, and the words' offsets. Words without letters have none."""
    joined = " ".join(words.to_pylist()) + " "
    units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = symbols()[np.minimum(units, LAST)]
    space = units == 32
    keep = (symbol >= 0) | space
    code = np.where(space, EDGE, symbol)[keep].astype(np.int64)
    word = (np.cumsum(space) - space)[keep]
    padded = np.concatenate(([EDGE], code, [EDGE]))
    gram = (padded[:-2] * SYMBOLS + padded[1:-1]) * SYMBOLS + padded[2:]
    inner = code != EDGE  # trigrams centred on a letter
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.bincount(word[inner], minlength=len(words)), out=at[1:])
    return gram[inner], at


def bound(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: the first letter's rotated by two, times the second's by one, times the third's."""
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


@dataclass
class Profiles:
    """languages and their normalised prototypes. A task keeps the products of the trigrams it has met, sorted by code."""

    languages: list[str]
    prototypes: np.ndarray
    met: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: np.ndarray | None = None

    def products(self, grams: np.ndarray) -> np.ndarray:
        """The product of each trigram's vector with each language's prototype."""
        if self.rows is None or len(self.met) > MOST_KEPT:
            self.met, self.rows = np.zeros(0, np.int64), np.zeros((0, len(self.languages)), np.float32)
        distinct, index = np.unique(grams, return_inverse=True)
        new = np.setdiff1d(distinct, self.met, assume_unique=True)
        if len(new):
            found = [bound(new[a : a + 4096], letter_vectors()).astype(np.float32) @ self.prototypes.T for a in range(0, len(new), 4096)]
            order = np.argsort(np.concatenate((self.met, new)), kind="stable")
            self.met, self.rows = np.concatenate((self.met, new))[order], np.concatenate((self.rows, *found))[order]
        return self.rows[np.searchsorted(self.met, distinct)][index]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        dictionary, index, rows = distinct_words(texts)
        if not self.languages or not len(dictionary):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, at = trigrams(dictionary)
        total = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(self.products(grams), axis=0, dtype=np.float64)))
        per_word = (total[at[1:]] - total[at[:-1]])[index]
        letters = np.concatenate(([0], np.cumsum(np.diff(at)[index])))
        sums = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(per_word, axis=0)))
        value = sums[rows[1:]] - sums[rows[:-1]]
        known = letters[rows[1:]] > letters[rows[:-1]]
        best = value.argmax(axis=1)
        positive = np.maximum(value, 0)
        share = positive.max(axis=1) / np.maximum(positive.sum(axis=1), 1e-12)
        return [self.languages[i] if k else UNKNOWN for i, k in zip(best, known)], np.where(known, np.clip(share, 0, 1), 0.0)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Bundles the words of all given documents with a language. Each task binds the distinct trigrams of a slice once.

    What reaches the driver is one vector of DIMENSIONS numbers for each language, whatever the input's size. Rows without
    a text or a language are left out, repeated rows count again, and an empty table gives profiles without languages.
    """

    def run(batches):
        vectors: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, langs = texts_of(batch, "text"), np.array(column(batch, "lang").to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    dictionary, index, _ = distinct_words(texts.filter(pa.array(langs == lang)))
                    if not len(dictionary):
                        continue
                    grams, at = trigrams(dictionary)
                    times = np.repeat(np.bincount(index, minlength=len(dictionary)), np.diff(at))
                    some, own = np.unique(grams, return_inverse=True)
                    n = np.bincount(own, weights=times, minlength=len(some))
                    vector = vectors.setdefault(lang, np.zeros(DIMENSIONS))
                    for a in range(0, len(some), 4096):
                        vector += n[a : a + 4096] @ bound(some[a : a + 4096], letter_vectors()).astype(np.float64)
        for lang, vector in vectors.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(vector)], names=["lang", "i", "v"])

    given = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    summed = given.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for lang, i, v in summed.collect():
        found.setdefault(lang, np.zeros(DIMENSIONS))[i] = v
    languages = sorted(found)
    if not languages:
        return Profiles([], np.zeros((0, DIMENSIONS), np.float32))
    # What all languages share says nothing about any of them; it is taken off before the lengths are evened.
    raw = np.stack([found[k] / max(np.linalg.norm(found[k]), 1e-12) for k in languages])
    own = raw - raw.mean(axis=0) if len(languages) > 1 else raw
    return Profiles(languages, (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype(np.float32))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; `und` and 0 where the text is null or has no letter, or no language is known.

    Ties go to the first name. Rows without an id and repeated rows stay, other columns are ignored, and an empty table
    gives no rows.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                names, score = profiles.predict(texts_of(batch, "text"))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; profiles learn from documents whose crc32(id) mod 3 is not 1.

    A null id is not held out and its row learns; otherwise as `fit` and `identify`.
    """
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    profiles = fit(docs.where(F.coalesce(part != 1, F.lit(True))))
    return identify(docs, profiles).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
