"""Each operator against brute force or a library, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.compare import connect, rows_of_spark, rows_of_sql
from tidemark.llm import components, exact_dedup, fingerprints, jaccard_join, language, packing, pii, quality, queries, sentence_pieces, shingles, token_counts, toxicity, word_bpe

PIECES, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n", "a", "  two  spaces ", "tab\tand\x0bvt", "日本語 テスト １２３", "ÀÉ é Σ İ", "x\x00y \x1c z", "😀 don't '' 's", "word " * 3000, "a" * 5000]


def frame(spark, texts):
    """A table of texts with columns that clash with names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), "n", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, norm string, score double")


def test_registered():
    names = set(__spark_entry__.queries())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


# --- 1 and 3 ---------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library_and_round_trip(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    pieces = sentence_pieces.load(PIECES)
    ids, at = pieces.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [model.encode(t) for t in texts]
    raw, out = pieces.decode(ids, at)
    assert [bytes(raw[a:b]).decode() for a, b in zip(out, out[1:])] == texts


def test_encode_and_decode_tables(spark):
    df = frame(spark, ODD)
    encoded = sentence_pieces.encode_documents(df, PIECES)
    got = {r.doc_id: r.text for r in sentence_pieces.decode_documents(encoded, PIECES).collect()}
    assert got == {i: t or "" for i, t in enumerate(ODD)}
    assert sentence_pieces.encoding_report(df.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("block", [1999, 1 << 27])
def test_token_counts_across_blocks(spark, tmp_path, block):
    """Files hold nothing but ids; blocks of any size give each document's count, also where halves of ids look like an end."""
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    halves = [i for i in range(model.get_piece_size()) if i >> 8 == 2 and model.decode([i]).strip()], [i for i in range(300, model.get_piece_size()) if i & 255 == 0 and model.decode([i]).strip()]
    rnd = random.Random(6)
    pairs = [model.decode([rnd.choice(halves[0]), rnd.choice(halves[1])]) for _ in range(600)]
    texts = [" ".join(pairs[i : i + 40]) for i in range(0, 600, 40)]
    df = frame(spark, ODD + texts).select("doc_id", "text").union(spark.createDataFrame([(-5, "x"), (1234567890123456789, "a b"), (None, "lost")], "doc_id long, text string"))
    path = str(tmp_path / "t")
    token_counts.write_token_files(df, path, PIECES)
    raw = [np.frombuffer(p.read_bytes(), "<u2") for p in (tmp_path / "t").glob("part-*")]
    assert sum(int((x == 2).sum()) for x in raw) == len(ODD) + len(texts) + 2 and sum(p.stat().st_size % 2 for p in (tmp_path / "t").glob("part-*")) == 0
    odd = sum(x.tobytes().count(b"\x02\x00") for x in raw)
    assert odd > sum(int((x == 2).sum()) for x in raw)  # there are false ends
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark, path, PIECES).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {r.doc_id: len(model.encode(r.text or "")) for r in df.collect() if r.doc_id is not None}
    assert token_counts.token_report(df.limit(0), PIECES).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_exact_dedup_equals_sql(spark, sf_dir):
    got = rows_of_spark(queries.op2_exact_dedup(spark, sf_dir))
    assert got == rows_of_sql(connect(sf_dir), queries.ORACLES["op2_exact_dedup"])


def test_exact_dedup_edges(spark):
    texts = ["a b", "a\t\n b", None, "", "c", "c", "x " * 4000, "x " * 4000]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, texts)).collect()}
    assert got == {0: (0, 2, True), 1: (0, 2, False), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 2, True), 5: (4, 2, False), 6: (6, 2, True), 7: (6, 2, False)}
    assert exact_dedup.exact_dedup(frame(spark, texts).limit(0)).count() == 0
    kept = exact_dedup.drop_exact_copies(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6] and kept.columns == frame(spark, []).columns


# --- 4 ---------------------------------------------------------------------------------------------------------------


def check_packing(rows, texts):
    tok = Tokenizer.from_file(WORD)
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1]) and sum(r.length for r in own) <= 2048
    return sum(r.length for r in rows) / (2048 * len(windows))


def test_packing_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert check_packing(queries.op4_packing(spark, sf_dir).collect(), {r.doc_id: r.text for r in docs.collect()}) > 0.95


def test_packing_edges(spark):
    check_packing(packing.pack_documents(frame(spark, ODD), WORD).collect(), dict(enumerate(ODD)))
    assert packing.pack_documents(frame(spark, []), WORD).count() == 0


def test_differencing_balances():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 500, 400)
    sums = np.bincount(packing.difference(sizes, 16), weights=sizes, minlength=16)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 3
    window = packing.pack(np.array([2048, 2048, 1]), 2048)
    assert np.bincount(window, weights=[2048, 2048, 1]).max() <= 2048


def test_word_bpe_equals_the_library(spark, sf_dir):
    tok = Tokenizer.from_file(WORD)
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    ids, at = word_bpe.load(WORD).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_fingerprints_against_a_loop(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op5_fingerprints(spark, sf_dir).collect()}
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 2
        new = t[: len(t) - k] + after[:k]
        a, b, c = (fingerprints.digests(x) for x in (t, new, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.spelled(a), fingerprints.spelled(b))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))


def test_chunk_ends_against_a_byte_loop():
    """The cuts against a plain gear hash over the bytes of each chunk, byte by byte."""
    rnd = random.Random(2)
    for n in [0, 1, 16, 17, 48, 200, 5000]:
        raw = bytes(rnd.choices(b"abcdef \n", k=n))
        ends, a = [], 0
        while a < n:
            b = a
            while b < n:
                b += 1
                size = b - a
                h = sum(int(fingerprints.GEAR[x]) << k for k, x in enumerate(reversed(raw[max(a, b - fingerprints.WINDOW) : b]))) & 0xFFFFFFFF
                if size == fingerprints.MOST or size >= fingerprints.LEAST and h & int(fingerprints.HARD if size <= fingerprints.NORMAL else fingerprints.EASY) == 0:
                    break
            ends.append(b)
            a = b
        assert fingerprints.chunk_ends(raw) == ends


def test_fingerprint_edges(spark):
    assert len(fingerprints.fingerprint_documents(frame(spark, ODD)).collect()) == len(ODD)
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0
    assert fingerprints.fingerprint_documents(frame(spark, ["only"])).first().near_next == 1.0
    long = "".join(random.Random(1).choices("abcdef ", k=5000))
    a, b = fingerprints.digests(long), fingerprints.digests("inserted " + long)
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, {}) == 0.0 and fingerprints.likeness({}, {}) == 1.0


# --- 6 ---------------------------------------------------------------------------------------------------------------


def brute_components(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, sf_dir, width, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, width, percent).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], width, percent)


def test_jaccard_groups_near_the_threshold(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    texts = []
    for k in range(90):
        words = base.copy()
        for _ in range(rnd.choice([0, 1, 2, 4, 8, 16])):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ODD + ["one two", "ONE  two", "one two three"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, texts), 4, 85).collect()}
    assert got == brute_components(enumerate(texts), 4, 85)
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_jaccard_regions_split_recursively(spark, monkeypatch):
    """Families around shared forms, some split by pivots, some not, some linked in chains; cells of a few members."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    monkeypatch.setattr(jaccard_join, "CELL", 12)
    split = []
    real = jaccard_join._recurse
    monkeypatch.setattr(jaccard_join, "_recurse", lambda *a: split.append(real(*a)[1]) or (real(*a)))
    rnd = random.Random(11)
    texts = []
    for edits in (3, 8, 14, 25):
        form = [f"f{edits}w{rnd.randrange(4000)}" for _ in range(110)]
        for k in range(60):
            words = form.copy()
            for _ in range(rnd.randrange(edits)):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(260)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 160, 3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, texts), 4, 85).collect()}
    assert got == brute_components(enumerate(texts), 4, 85)
    assert split and split[0] is not None


def test_words_of_regular_form_stay_apart(spark):
    """Words made by one doubling rule hash alike under a polynomial of any base modulo a power of two."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    hashes, _ = shingles.word_hashes(pa.array([a, b, " a  B ", ""]))
    assert len(set(hashes.tolist())) == 4
    rest = " ".join(f"w{i}" for i in range(30))
    rows = jaccard_join.jaccard_components(frame(spark, [f"{a} x y {a}", f"{b} x y {b}", rest, rest + " more"])).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [0, 1, 2, 2]


def test_one_id_with_several_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, None), (None, "x")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == [(1, 4, 1), (2, 4, 1)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_shingles_do_not_cross_documents():
    together, at = shingles.shingle_sets(pa.array(["a b c d", "e f g h", "a B c d e"]), 4)
    one, _ = shingles.shingle_sets(pa.array(["a b c d"]), 4)
    assert at.tolist() == [0, 1, 2, 4] and together[0] == one[0] and one[0] in together[2:4]


# --- 7 ---------------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = int(ch) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


HARD = [
    "a@b.c_d@e.f x@y z@-.- me.you+1%2@mail-1.example.co.uk.",
    "1.2.3.4 1.2.3.4.5 256.1.1.1 0001.02.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 79927398713 " + "5" * 40,
    "+1 (555) 123-4567 +12 +49.30.123456-7 ++4412345678901 +123456789012345678",
    "é😀 4111111111111111 ü a@b.co",
    "12-34-56 " * 500 + "4111111111111111",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, bad DE89 3704 0044 0532 0130 01; SSN 123-45-6789 or 123-45-6780x",
]


def test_pii_base_spans(spark, sf_dir):
    texts = [t or "" for t in ODD] + HARD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pii.pii_report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest(), t[:80]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[2] == k for s in spans) for k in pii.BASE_KINDS)
    kinds = [x.split(":")[0] for x in got[len(ODD) + len(HARD) - 1].spans.split(",")]
    assert kinds.count("iban") == 2 and kinds.count("national_id") == 1
    assert pii.pii_report(frame(spark, [])).count() == 0


def test_redaction(spark):
    df = frame(spark, ["mail a@b.co now", None, "", "call +1 555 123 4567!", "plain"])
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact_pii(df).collect()}
    assert got == {0: ("mail <EMAIL> now", 16), 1: (None, 0), 2: ("", 0), 3: ("call <PHONE>!", 13), 4: ("plain", 5)}
    assert pii.redact_pii(df).columns == df.columns


def test_pii_is_linear_in_long_texts(spark, tmp_path):
    """Unbroken letters and digits before one address, and very many spans of two kinds, in minutes if any step were quadratic."""
    many = " ".join(f"user{i}@mail.example.com DE89 3704 0044 0532 0130 00" for i in range(20_000))
    texts = ["a" * 1_000_000 + "@ x a@b.co", "1" * 1_000_000 + " 1.2.3.4", many]
    frame(spark, texts).write.parquet(str(tmp_path / "long"))
    df = spark.read.parquet(str(tmp_path / "long"))
    began = time.time()
    got = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert (got[0].n_email, got[1].n_ip, got[2].n_email, got[2].spans.count("iban")) == (1, 1, 20_000, 20_000)
    masked = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert masked[0] == "a" * 1_000_000 + "@ x <EMAIL>" and masked[1] == "1" * 1_000_000 + " <IP>"
    assert masked[2] == " ".join(["<EMAIL> <IBAN>"] * 20_000)
    assert time.time() - began < 100


def test_pii_context_is_whole_words_on_both_sides(spark):
    texts = ["ssn 123-45-6789", "123-45-6789 is the SSN", "assn 123-45-6789", "123-45-6789 nationally", "ssn " + "x" * 45 + " 123-45-6789"]
    assert [bool(r.spans) for r in pii.find_pii(frame(spark, texts)).orderBy("doc_id").collect()] == [True, True, False, False, False]
    ship = pii.find_pii(frame(spark, ["ship 1.2.3.4", "hotel +1 555 123 4567", "the IP 1.2.3.4"])).orderBy("doc_id").collect()
    assert [r.spans[0].score for r in ship] == [0.6, 0.6, pytest.approx(0.8)]


def test_overlapping_spans_and_added_kinds_against_a_loop(spark):
    rnd = random.Random(3)
    parts = ["a@b.co", "+1 4111 1111 1111 1111", "1.2.3.4", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432@x.yz", "123-45-6789", "ssn", "x", "4111111111111111", "+49 30 1234567"]
    texts = [" ".join(rnd.choices(parts, k=rnd.randrange(1, 400))) for _ in range(12)]
    masked = {r.doc_id: r.text for r in pii.redact_pii(frame(spark, texts)).collect()}
    for r in pii.find_pii(frame(spark, texts)).collect():
        t, base = texts[r.doc_id], brute_spans(texts[r.doc_id])
        assert [(s.start, s.ord, s.kind, s.end) for s in r.base] == base
        added = [(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])(?:DE89 3704 0044 0532 0130 00|GB82WEST12345698765432)(?![A-Za-z0-9])", t)]
        clear = [(a, b) for a, b in added if not any(x < b and a < y for x, _, _, y in base)]
        assert [(s.start, s.end) for s in r.spans if s.kind == "iban"] == clear
        out, at = [], 0
        for s in r.spans:
            if s.start >= at:
                out += [t[at : s.start], f"<{s.kind.upper()}>"]
            at = max(at, s.end)
        assert masked[r.doc_id] == "".join(out) + t[at:]


def test_redaction_with_columns_of_internal_names(spark):
    names = ["_text", "_base", "_spans", "_line", "_more", "_mixed", "_reach", "_following", "_cuts", "_new", "_k0", "_k1", "_row_text", "doc_id", "base", "spans", "_found_email", "_between_email", "_ends_email"]
    df = spark.createDataFrame([("call a@b.co", *names)], ", ".join(f"`{c}` string" for c in ["text", *names]))
    out = pii.redact_pii(df)
    assert out.columns == df.columns and tuple(out.first()) == ("call <EMAIL>", *names)
    wide = pii.find_pii(df, keep=("_text", "base")).first()
    assert wide[1] == "_text" and wide.spans[0].kind == "email"


# --- 8, 9, 10 --------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = [r for r in queries.op8_language(spark, d).collect()]
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_edges(spark):
    profiles = language.fit(spark.createDataFrame([("the and of", "en"), ("der die und", "de"), (None, "en"), ("x", None)], "text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language.identify(frame(spark, ["", None, "123 !!", "the of and", "und die"]), profiles).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "en", 4: "de"}
    nothing = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert language.identify(frame(spark, ["the"]), nothing).first().lang_pred == "und"


def test_letters_of_all_scripts_count(spark):
    assert not any(chr(c).isalpha() for c in range(language.LAST, 0x110000))
    docs = [("привет как дела сегодня", "ru"), ("добар дан како сте ви", "sr"), ("𐌲𐌿𐍄𐌹𐍃𐌺 𐍂𐌰𐌶𐌳𐌰", "got"), ("καλημέρα σας κόσμε", "el")]
    profiles = language.fit(spark.createDataFrame(docs, "text string, lang string"))
    got = [r.lang_pred for r in language.identify(frame(spark, [t for t, _ in docs] + ["𠀀𠀁", "1 𝟘"]), profiles).orderBy("doc_id").collect()]
    assert got[:4] == [g for _, g in docs] and got[4] != "und" and got[5] == "und"
    cyrillic = language.symbols()[[ord(c) for c in "абвгдежзийклмнопрстуфхцчшщъыьэюя"]]
    assert len(set(cyrillic.tolist())) == 32


def test_language_against_dense_vectors(spark, sf_dir):
    """op8 over the table against whole document vectors, bound letter by letter and compared by cosine."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()

    def vector(text):
        out = np.zeros(language.DIMENSIONS)
        letters = language.letter_vectors().astype(np.int64)
        for word in re.findall(r"[^\x20\x09-\x0D]+", text):
            code = [0, *[int(x) for x in language.symbols()[[ord(c) for c in word]] if x >= 0], 0]
            for a, b, c in zip(code, code[1:], code[2:]):
                out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    sums = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            sums[r.lang] = sums.get(r.lang, 0) + vector(r.text)
    names = sorted(sums)
    raw = np.stack([sums[k] / np.linalg.norm(sums[k]) for k in names])
    own = raw - raw.mean(axis=0)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    got = {r.doc_id: r for r in queries.op8_language(spark, sf_dir).collect()}
    for r in rows[:60]:
        value = own @ vector(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        positive = np.maximum(value, 0)
        assert got[r.doc_id].score == pytest.approx(positive.max() / max(positive.sum(), 1e-12), abs=1e-3)
        if np.sort(value)[-1] - np.sort(value)[-2] > 1e-3 * np.abs(value).max():
            assert got[r.doc_id].lang_pred == names[int(value.argmax())]


def test_bundling_by_words_equals_the_bound_vectors():
    letters = language.letter_vectors().astype(float)
    profiles = language.Profiles(["a", "b"], np.random.default_rng(0).normal(size=(2, language.DIMENSIONS)).astype(np.float32))
    grams, _ = language.trigrams(pa.array(["hello", "wörld"]))
    direct = language.bound(grams, letters).sum(axis=0) @ profiles.prototypes.T
    assert profiles.products(grams).sum(axis=0) == pytest.approx(direct, rel=1e-3, abs=1e-2)


def held_out(rows, labels, name):
    return [(r.predicted, labels[r.doc_id][name]) for r in rows if r.held_out and labels.get(r.doc_id, {}).get(name) is not None]


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, d).collect()
    pairs = held_out(rows, labels, "quality")
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_scores_equal_the_rules_in_python(spark, sf_dir):
    """op9's column expressions against statistics and conjunctions worked out text by text in Python."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)

    def stats(t):
        words = re.findall(r"[^ \t-\r]+", t)
        n, chars = len(words), max(1, len(t))
        import unicodedata

        kind = [unicodedata.category(c) for c in t]
        return {
            "n_words": np.log1p(n), "word_length": sum(c not in " \n" for c in t) / max(1, n), "distinct_share": len(set(words)) / max(1, n),
            "upper_share": kind.count("Lu") / chars, "digit_share": sum(c in "0123456789" for c in t) / chars, "symbol_share": sum(c in quality.SYMBOLS for c in t) / chars,
            "bang_share": t.count("!") / chars, "bar_share": t.count("|") / chars, "letter_share": sum(k[0] == "L" for k in kind) / chars,
            "line_words": n / (t.count("\n") + 1), "stop_share": sum(len(w) <= 3 for w in words) / max(1, n), "repeat_share": sum(a == b for a, b in zip(words, words[1:])) / max(1, n),
        }

    texts = [t or "" for t in ODD if t is None or "\x1c" not in t] + [r.text or "" for r in docs.limit(80).collect()]
    found = quality.with_statistics(frame(spark, texts), ["doc_id"]).select("*", model.score().alias("p")).collect()
    assert model.rules
    for r in found:
        want = stats(texts[r.doc_id])
        for k in quality.STATISTICS:
            assert r[f"s_{k}"] == pytest.approx(want[k]), (k, texts[r.doc_id][:50])
        z = model.intercept + sum(rule.weight for rule in model.rules if all(a < want[k] <= b for k, a, b in rule.bounds))
        assert r.p == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality.quality_report(frame(spark, ODD), labels.limit(0)).count() == len(ODD)
    assert quality.quality_report(frame(spark, []), labels).count() == 0
    stats = quality.with_statistics(frame(spark, [None, "a a b|!", "A B\nC"]), ["doc_id"]).orderBy("doc_id").collect()
    assert stats[0].s_n_words == 0 and stats[1].s_distinct_share == pytest.approx(2 / 3) and stats[1].s_repeat_share == pytest.approx(1 / 3) and stats[2].s_upper_share == pytest.approx(3 / 5)


def test_toxicity_held_out_and_disguises(spark):
    d = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, known)
    scores = model.score(pa.array(["you 1d10t of", "an i d i o t", "m0r0n!", "LOOOSER", "s.t.u.p.i.d", "clean words here", ""]))
    assert (scores[:5] >= 0.5).all() and (scores[5:] < 0.5).all()
    labels = {r.doc_id: r.asDict() for r in known.collect()}
    pairs = held_out(queries.op10_toxicity(spark, d).collect(), labels, "toxic")
    assert sum(a == 1 and b == 0 for a, b in pairs) <= 1 and sum(a == b for a, b in pairs) / len(pairs) > 0.9


def test_decoding_equals_all_readings():
    """The channel's Viterbi path of short words has the best probability of all letter strings and alignments."""
    rnd = np.random.default_rng(5)
    counts = rnd.integers(1, 50, (27, 27)).astype(float)
    channel = toxicity.Channel(np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))

    def readings(word):
        best = {}
        stack = [(0, toxicity.START, "", 0.0)]
        while stack:
            i, state, out, p = stack.pop()
            if i == len(word):
                best[out] = max(best.get(out, -1e30), p + channel.pairs[state, toxicity.START])
                continue
            code = ord(word[i])
            if channel.skip[code, state] > -1e8:
                stack.append((i + 1, state, out, p + channel.skip[code, state]))
            for letter in np.flatnonzero(channel.emit[code] > -1e8).tolist():
                stack.append((i + 1, letter, out + chr(97 + letter), p + channel.pairs[state, letter] + channel.emit[code, letter]))
        return best

    words = ["1d10t", "m0r0n", "aaab", "6!9", "s.t.u", "l00ser", "$|+", "b@d"]
    for word, decoded in zip(words, channel.decode(words)):
        best = readings(word)
        assert best[decoded] == pytest.approx(max(best.values()), abs=1e-3)


def test_scores_equal_noisy_or_in_python(spark, toxicity_model):
    m = toxicity_model
    word = next(w for w in m.evidence if not w.endswith("*"))
    texts = [f"a clean start {word} end", f"{word} {word}", "nothing here", "", f"{word.upper()}, and more"]
    for text, score in zip(texts, m.score(pa.array(texts))):
        clear = 1 - toxicity.BASE_SCORE
        for w in {x.strip(",").lower() for x in text.split()}:
            clear *= 1 - max((m.evidence.get(f, 0.0) for f in toxicity.features(w)), default=0.0)
        assert score == pytest.approx(1 - clear)


def test_score_column_that_exists_gives_way(spark, toxicity_model):
    df = frame(spark, ["plain", None]).withColumn("toxicity", F.lit("mine"))
    out = toxicity.score_documents(df, toxicity_model, score_col="score")
    assert out.columns == [c for c in df.columns if c != "score"] + ["score"] and out.first().score < 0.5
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and {r.toxicity for r in kept.collect()} == {"mine"}


@pytest.fixture(scope="module")
def toxicity_model(spark):
    d = "/root/testdata/sf0.01"
    return toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_toxicity_of_spaced_words_beside_others(toxicity_model):
    toxic = ["such a m o r o n", "such I d i o t", "you à m 0 r 0 n", "y o u i d i o t", "i d i o t m o r o n", "m o r o n s a n d t r a s h"]
    clean = ["c l a s s i c", "s u c h a g o o d d a y", "a b c d e f g", "日 本 語", "x y z " * 2000]
    scores = toxicity_model.score(pa.array(toxic + clean))
    assert (scores[:6] >= 0.5).all() and (scores[6:] < 0.5).all()
    assert toxicity_model.segment("amoron") == ["a", "moron"] and toxicity_model.segment("") == []


def test_toxicity_of_edge_symbols_as_letters(toxicity_model):
    toxic = ["!d1ot", "such a (lown", "<lown", "the tras# is", '"!diot!!"', "((lown)", "! d i o t", "a ( l o w n", "t r a s #", "(moron)", "moron!"]
    clean = ["(the) house!", "wow! (and) so #on", "! ( < #", "<b> good!", "!" * 5000 + " a" + "(" * 5000, "see (land #all <it"]
    scores = toxicity_model.score(pa.array(toxic + clean))
    assert (scores[: len(toxic)] >= 0.5).all() and (scores[len(toxic) :] < 0.5).all()


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_report(frame(spark, ODD).drop("score"), labels).collect()
    assert len(rows) == len(ODD) and all(r.predicted == 0 for r in rows)
    assert toxicity.toxicity_report(frame(spark, []), labels).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "pii", "packing"]
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialise(stage(spark, now, sf_dir), name)
        assert now.columns == columns
    left = {r.doc_id: r.text for r in now.collect()}
    assert left == brute_pipeline(docs, {r.doc_id for r in queries.op10_toxicity(spark, sf_dir).where("predicted = 1").collect()})
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), left)


def brute_pipeline(docs, toxic):
    """Ids and texts that the stages before packing leave, by loops: op10's verdicts, one row of each text with white space evened
    out, one document of each component at five words and 0.8, and the base spans of personal data replaced. Texts with spans
    that overlap, or of kinds that the method adds, are not expected in the tables."""
    texts, first = {}, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.doc_id not in toxic:
            texts[r.doc_id] = r.text
            first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    one = sorted(first.values())
    kept = {i for i, (_, top) in brute_components([(i, texts[i]) for i in one], 5, 80).items() if i == top}
    out = {}
    for i in kept:
        t = texts[i]
        for start, _, kind, end in reversed(brute_spans(t or "")):
            t = t[:start] + f"<{kind.upper()}>" + t[end:]
        out[i] = t
    return out


def test_planted_copies_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = docs.where("n_chars between 1500 and 4000").orderBy("doc_id").limit(3)
    copies = long.withColumn("doc_id", F.col("doc_id") + 100_000)
    near = long.withColumn("doc_id", F.col("doc_id") + 200_000).withColumn("text", F.concat("text", F.lit(" tail words added")))
    both = docs.union(copies).union(near)
    kept = jaccard_join.drop_near_copies(exact_dedup.drop_exact_copies(both))
    assert not [r for r in kept.collect() if r.doc_id >= 100_000]


def test_stages_keep_null_ids_and_one_of_repeated_rows(spark):
    a, b, c = ("one two three four five six " + w for w in ("seven eight", "nine ten", "eleven twelve"))
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(None, a), (None, a), (None, b), (1, c), (1, c), (1, "other words of the same id"), (None, long + " more"), (2, long), (3, None), (3, None), (None, "x"), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    exact = sorted((tuple(r) for r in exact_dedup.drop_exact_copies(docs).collect()), key=order)
    assert exact == sorted([(None, a), (None, b), (1, c), (1, "other words of the same id"), (None, long + " more"), (2, long), (3, None), (4, "x")], key=order)
    near = sorted((tuple(r) for r in jaccard_join.drop_near_copies(docs).collect()), key=order)
    assert near == sorted([(None, a), (None, b), (1, c), (1, "other words of the same id"), (2, long), (3, None), (4, "x")], key=order)
