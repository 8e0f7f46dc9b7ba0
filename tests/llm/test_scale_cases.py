"""Inputs that are hard on op1 and op6: long unbroken words, filled-in copies of one form, tables without any partner."""

import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_llm import brute_components, frame
from tidemark.llm import jaccard_join, sentence_pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def words_of(rnd):
    letters = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    yield "random", letters("abcdefghijklmnopqrstuvwxyz0123456789", 5000)
    for period in ("a", "ab", "abc", "abcdefg", "internation", "thequickbrownfoxjumpsoverlazy"):
        yield period, period * (4000 // len(period))
        yield "x" + period, "x" + period * (4000 // len(period))
    yield "syllables", "".join(rnd.choice(["the", "inter", "nation", "al", "ize", "un", "help", "Über", "日本", "😀"]) for _ in range(1500))
    for n in (47, 48, 49, 96, 97, 287, 288, 289, 335, 336, 337, 575, 576, 577, 816, 817):
        yield f"length {n}", letters("etaoin", n)
    yield "no piece", "\U0001f9ff" * 900 + "a" * 900


@pytest.mark.parametrize("rows", [8192, 3])
def test_long_words_equal_the_library(monkeypatch, rows):
    """Rows that agree, rows of a repeated pattern that never do, and more rows than are walked at once."""
    monkeypatch.setattr(sentence_pieces, "MOST_ROWS", rows)
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentence_pieces.load(PIECES)
    texts = [w for _, w in words_of(random.Random(3))]
    texts.append(" ".join(texts[:9]))
    ids, at = pieces.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [model.encode(t) for t in texts]


def test_a_megabyte_without_a_space_takes_seconds():
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1_000_000))
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentence_pieces.load(PIECES)
    began = time.time()
    ids, _ = pieces.encode(pa.array([text]))
    assert time.time() - began < 60 and ids.tolist() == model.encode(text)


def forms(rnd, copies, fields, values):
    """Copies of one text of 200 words in which some words are filled in, from few values or from any number."""
    form = [f"w{i}" for i in range(200)]
    places = sorted(rnd.sample(range(10, 190), fields))
    for k in range(copies):
        words = form.copy()
        for p in places:
            words[p] = f"v{p}x{rnd.randrange(values) if values else k}"
        yield " ".join(words)


@pytest.mark.parametrize("values", [0, 25])
def test_copies_of_a_form_do_not_meet_all(spark, monkeypatch, values):
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "CELL", 12)
    monkeypatch.setattr(jaccard_join, "COPIES", 2)
    measured = []
    real = jaccard_join._met_by_shingle

    def met(full, sets, percent):
        kept = jaccard_join._measured
        jaccard_join._measured = lambda pairs, s: measured.append(pairs.count()) or kept(pairs, s)
        try:
            return real(full, sets, percent)
        finally:
            jaccard_join._measured = kept

    monkeypatch.setattr(jaccard_join, "_met_by_shingle", met)
    rnd = random.Random(1)
    texts = list(forms(rnd, 150, 6, values)) + list(forms(rnd, 12, 3, 25))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, texts), 5, 80).collect()}
    assert got == brute_components(enumerate(texts), 5, 80)
    if values:
        assert measured and sum(measured) < 150 * 149 / 2 / 3


def test_nothing_to_join_ends_early(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_links", lambda *a: 1 / 0)
    long = [" ".join(f"{k}{i}" for i in range(200)) for k in "abc"]
    df = frame(spark, [long[0], long[1], None, "", long[2], long[2]])
    assert [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df).orderBy("doc_id").collect()] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4)]
    assert jaccard_join.jaccard_components(df.where("doc_id < 3")).where("doc_id <> component_id").count() == 0
    assert sorted(r.doc_id for r in jaccard_join.drop_near_copies(df).select(F.col("doc_id")).collect()) == [0, 1, 2, 3, 4]
