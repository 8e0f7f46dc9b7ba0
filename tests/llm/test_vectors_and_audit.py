"""Filter audit, exact search and vector codes against SQL and plain loops, with nulls, ties, repeats, hot prefixes and empty tables."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from tests.compare import connect, rows_of_spark, rows_of_sql
from tidemark.llm import filter_audit, queries, vector_codes, vector_search


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_top_k", "op13_vector_codes"])
def test_equal_to_sql(spark, sf_dir, name):
    assert rows_of_spark(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(connect(sf_dir), queries.ORACLES[name])


# --- 11 --------------------------------------------------------------------------------------------------------------


def audit_by_loop(docs, labels):
    masks = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": any((o or "") == text and j is not None and (i is None or j < i) for j, o, _ in docs),
        }
        masks.append((i, part or "", {f for f, bad in fails.items() if bad}))
    out = {}
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for _, p, _ in masks}:
        own = [(i, m) for i, p, m in masks if p == part]
        went = {f: 0 for f in "ABCDE"}
        for order in orders:
            there = own
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in there if f in m]
                there = [(i, m) for i, m in there if f not in m]
                went[f] += len(gone)
                fail = sum(f in m for _, m in own)
                out[part, order, step] = [len(there), len(gone), fail - len(gone), sum(m == {f} for _, m in own), sum(labels.get(i, (0, 0))[0] for i, _ in gone), sum(labels.get(i, (0, 0))[1] for i, _ in gone)]
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(went[f])
    return out


AUDITED = [
    (1, None, "a"), (2, "", None), (3, "", "a"), (None, "", "a"), (None, None, "a"), (4, "x " * 300, "a"), (4, "x " * 300, "a"), (5, "x " * 300, "b"),
    (6, " ".join(f"w{i}" for i in range(250)), "b"), (7, " ".join(f"w{i}" for i in range(250)), "b"), (8, " ".join(f"w{i}" for i in range(251)), None),
    (9, "ÀÉ A 日本　語", ""), (10, "a#b\x0b\x0cA", "b"), (10, "other text", "b"), (11, "w" * 30000, "b"), (12, "w" * 30001, "b"), (13, "w" * 30000, "b"),
]


@pytest.mark.parametrize("cell", [40, 16 << 20])
def test_audit_equals_a_loop(spark, cell):
    """Small cells widen the prefixes several times; the results stay the same."""
    shared = [(100 + i, "one template " * 40 + f"end {i % 7}", "t") for i in range(60)]
    docs = AUDITED + shared
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, mask int, part string")
    labels = [(1, 1, 0), (6, 1, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1), (104, 1, None), (120, None, 1)]
    marks = {1: (1, 0), 6: (1, 1), 7: (1, 1), 104: (1, 0), 120: (0, 1)}
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = filter_audit.filter_audit(df.repartition(5), table, cell_bytes=cell, range_bytes=2000).collect()
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in found} == audit_by_loop(docs, marks)
    assert len(found) == 600 * len({d[2] or "" for d in docs})
    assert filter_audit.filter_audit(df.limit(0), table).count() == 0
    assert {r.good_lost for r in filter_audit.filter_audit(df, table.limit(0)).collect()} == {0}


def test_trie_holds_whole_texts():
    rnd = np.random.default_rng(3)
    texts = [b"", b"a", b"ab", b"ab", b"abc" * 500, b"abc" * 500 + b"d", b"abc" * 499, *[bytes(rnd.integers(97, 99, rnd.integers(0, 12)).astype(np.uint8)) for _ in range(400)]]
    trie = filter_audit.Trie()
    for i, t in enumerate(texts):
        trie.insert(t, i)
    found = sorted(sorted(rows) for rows in trie.terminals())
    assert found == sorted([i for i, t in enumerate(texts) if t == u] for u in set(texts))


# --- 12 --------------------------------------------------------------------------------------------------------------


def odd_vectors(dim):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(0, 0.2, dim).astype(np.float32).tolist(), int(i % 3) if i % 4 else None) for i in range(130)]
    rows += [(200, rows[0][1], 1), (250, rows[0][1], 1), (250, rows[0][1], 1), (300, [0.0] * dim, None)]  # ties, repeats, no terms
    rows += [(400, None, 1), (401, [None] + [1.0] * (dim - 1), 1), (402, [math.nan] * dim, 2), (403, [math.inf] + [0.0] * (dim - 1), 2)]
    return rows


@pytest.mark.parametrize("part, query", [(32768, 16384), (11, 2)])
def test_search_equals_a_loop(spark, part, query):
    """Also where candidates and queries lie in many cells."""
    rows = odd_vectors(8) + [(None, [1.0] * 8, 1), (450, [0.5] * 3, 1)]
    df = spark.createDataFrame([(*r, 7, 0.5) for r in rows], "vec_id long, embedding array<float>, label int, rank int, w double")
    found = vector_search.top_k(df, part_rows=part, query_rows=query).collect()
    there = {i: [math.floor(256 * x) for x in np.array(v, np.float32).astype(float).tolist()] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in there:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(there[q], w)), i) for i, w in there.items() if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert vector_search.top_k(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert [r["rank"] for r in vector_search.top_k(few).orderBy("rank").collect()] == [1, 2]
    assert vector_search.top_k(df.where("vec_id = 0")).count() == 0


# --- 13 --------------------------------------------------------------------------------------------------------------


def test_nearest_equals_all_distances():
    rnd = np.random.default_rng(8)
    for dim, entries in ((1, 5), (4, 16), (8, 16), (3, 1)):
        parts, books = rnd.integers(-6, 6, (400, dim)), rnd.integers(-6, 6, (entries, dim))
        books[entries // 2] = books[0]
        every = ((parts[:, None, :] - books[None]) ** 2).sum(axis=2)
        index, distance = vector_codes.nearest(parts, books)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def codes_by_loop(rows):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    dim = len(kept[0][1]) // 8
    parts = [[[math.floor(4096 * x) for x in v[p * dim : (p + 1) * dim]] for p in range(8)] for _, v, _ in kept]
    books = [[parts[e][p] for e in range(min(16, len(kept)))] for p in range(8)]
    assign = lambda: [[min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])) for p, x in enumerate(own)] for own in parts]
    for _ in range(6):
        near = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [parts[r][p] for r in range(len(parts)) if near[r][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    errors = [sum(d for d, _ in own) for own in near]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (i, "".join(f"{e:02x}" for _, e in own), error, sum(x for x, (_, _, other) in zip(errors, kept) if other == label), digest)
        for (i, _, label), own, error in zip(kept, near, errors)
    ]


@pytest.mark.parametrize("n", [None, 9])
def test_codes_equal_a_loop(spark, n):
    rows = [(i, np.array(v, np.float32).astype(float).tolist() if v and None not in v else v, label) for i, v, label in odd_vectors(16)[:n]] + [(None, [0.25] * 16, None)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, vector_codes.vector_codes(df.repartition(3)).collect()), key=key) == sorted(codes_by_loop(rows), key=key)
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0] * 9, 1)], "vec_id long, embedding array<float>, label int"))
