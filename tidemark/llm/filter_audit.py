"""Audit of five filters in all orders. Duplicate flags come from compressed text tries over ranges of adaptive text prefixes."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.io import materialise
from tidemark.llm.words import column, slices, texts_of

FILTERS = "ABCDE"
WORDS, CAPITALS, SYMBOLS, COPY = 1, 4, 8, 16
FEW = 2
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
UPPER, SIGNS = bytes(range(65, 91)), re.compile(rb"[#$%&*|]")
FRONT, WIDEN = 8, 4  # prefixes of 8, 32, 128 ... code points
CELL_BYTES, MOST_CELLS = 16 << 20, 1 << 18
RANGE_BYTES, CELLS_A_TASK = 128 << 20, 8


def failed(text: bytes, points: int) -> int:
    """The filters A to D that a text fails, as bits. bytes.split parts at exactly the six white-space bytes of the contract."""
    words = text.split()
    mask = WORDS if len(words) < 200 else 0
    if 100 * len(set(words)) < 50 * len(words):
        mask |= FEW
    if 100 * (len(text) - len(text.translate(None, UPPER))) > 2 * points:
        mask |= CAPITALS
    return mask | (SYMBOLS if SIGNS.search(text) else 0)


def shared(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of edge text has from position at."""
    if text.startswith(edge, at):
        return len(edge)
    low, step = 0, 8
    while text.startswith(edge[low : low + step], at + low):
        low, step = low + step, step * 2
    while step > 1:
        step //= 2
        if text.startswith(edge[low : low + step], at + low):
            low += step
    return low


class Trie:
    """Compressed radix trie of whole texts. A terminal holds the smallest id of its text and all the rows that have it."""

    def __init__(self):
        self.root = (b"", {}, [])

    def insert(self, text: bytes, row: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            kids = node[1]
            child = kids.get(text[at])
            if child is None:
                child = kids[text[at]] = (text[at:], {}, [])
                at = len(text)
            else:
                edge = child[0]
                n = shared(edge, text, at)
                if n < len(edge):
                    child = kids[text[at]] = (edge[:n], {edge[n]: (edge[n:], child[1], child[2])}, [])
                at += n
            node = child
        node[2].append(row)

    def terminals(self) -> Iterator[list[int]]:
        """The rows of each text, in the order of texts as far as paths go."""
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if node[2]:
                yield node[2]
            waiting.extend(node[1].values())


def smallest(ids: list, rows: list[int]):
    """The smallest id of the rows, None when none has one."""
    return min((ids[r] for r in rows if ids[r] is not None), default=None)


def masker(names: list[str]):
    """First tasks: filters A to D, and copies inside a block of texts.

    Of a block's equal texts only the smallest id's row goes on with its text (once per part, with a count of repeats); the others are copies for sure and
    leave their text behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "text"):
                ids, parts = column(batch, "doc_id").to_pylist(), column(batch, "part").to_pylist()
                texts = texts_of(batch, "text")
                points = pc.utf8_length(texts).to_pylist()
                raw = texts.cast(pa.large_binary()).to_pylist()
                trie = Trie()
                for i, text in enumerate(raw):
                    trie.insert(text, i)
                out: list[list] = [[], [], [], [], []]
                for rows in trie.terminals():
                    mask, first, going = failed(raw[rows[0]], points[rows[0]]), smallest(ids, rows), {}
                    for r in rows:
                        if ids[r] == first:
                            going[parts[r]] = going.get(parts[r], 0) + 1
                        else:
                            for to, value in zip(out, (ids[r], parts[r], mask | COPY, 1, None)):
                                to.append(value)
                    for part, n in going.items():
                        for to, value in zip(out, (first, part, mask, n, rows[0])):
                            to.append(value)
                kept = texts.take(pa.array(out[4], pa.int64()))
                size = pc.fill_null(pc.binary_length(kept), 0)
                arrays = [pa.array(out[0], column(batch, "doc_id").type), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), size.cast(pa.int64()), kept]
                yield pa.record_batch(arrays, names=names)

    return run


def flagger(names: list[str]):
    """Second tasks: whole cells of texts, one after the other, in tries that are emptied at the end of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, rows, last = Trie(), 0, [[], [], [], []], None

        def done(id_type: pa.DataType) -> pa.RecordBatch:
            ids, masks = rows[0], rows[2]
            for same in trie.terminals():
                first = smallest(ids, same)
                for r in same:
                    if ids[r] != first:
                        masks[r] |= COPY
            return pa.record_batch([pa.array(ids, id_type), pa.array(rows[1], pa.string()), pa.array(masks, pa.int32()), pa.array(rows[3], pa.int64())], names=names)

        kind = None
        for whole_batch in batches:
            kind = column(whole_batch, "doc_id").type
            for batch in slices(whole_batch, "text"):
                cells = column(batch, "cell").to_numpy(zero_copy_only=False)
                texts = texts_of(batch, "text").cast(pa.large_binary()).to_pylist()
                values = [column(batch, n).to_pylist() for n in names]
                for i, text in enumerate(texts):
                    if held > CELL_BYTES and cells[i] != last:
                        yield done(kind)
                        trie, held, rows = Trie(), 0, [[], [], [], []]
                    last = cells[i]
                    trie.insert(text, len(rows[0]))
                    held += len(text)
                    for to, value in zip(rows, values):
                        to.append(value[i])
        if rows[0]:
            yield done(kind)

    return run


def prefix(text: Column, depth: Column) -> Column:
    return text.substr(F.lit(1), (F.lit(FRONT) * F.pow(F.lit(WIDEN), depth)).cast("int"))


def copies_flagged(rows: DataFrame, cell_bytes: int = CELL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, part, mask, n of the rows with a text (doc_id, part, mask, n, size, text): the copy bit is set where another row has the text and a smaller id.

    A text's prefix starts at FRONT code points and widens while the texts below it hold more than cell_bytes, or more than a
    CELLS_A_TASK-th of a task's share, and are not all equal. Such prefixes are found by counting in one pass, and there are at most
    MOST_CELLS a depth, since each holds that share of all bytes; so they are broadcast. Texts are dealt by ranges of their
    prefixes, and a task holds one cell's trie at a time.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    text = F.col("text")
    deepest = F.greatest(F.lit(0), F.ceil(F.log(float(WIDEN), F.greatest(F.lit(1), F.char_length("text")) / F.lit(float(FRONT))))).cast("int")
    levels = F.transform(F.sequence(F.lit(0), deepest), lambda k: F.struct(k.alias("depth"), F.xxhash64(prefix(text, k)).alias("hash")))
    counted = rows.select(F.explode(levels).alias("at"), "size", F.xxhash64("text").alias("own")).groupBy("at.depth", "at.hash")
    counted = counted.agg(F.sum("size").alias("bytes"), F.min("own").alias("low"), F.max("own").alias("high"))
    tasks = max(-(-total // range_bytes), 2 * spark.sparkContext.defaultParallelism)
    most = max(min(cell_bytes, total // (CELLS_A_TASK * tasks)), total // MOST_CELLS)
    heavy = materialise(counted.where((F.col("bytes") > most) & (F.col("low") != F.col("high"))).select("depth", "hash"), "heavy-prefixes")
    depth, there = F.lit(0), rows
    for k in sorted(r.depth for r in heavy.select("depth").distinct().collect()):
        mark = heavy.where(F.col("depth") == k).select(F.col("hash").alias("_hash"), F.lit(k + 1).alias(f"_deep{k}"))
        there = there.withColumn("_hash", F.xxhash64(prefix(text, F.lit(k)))).join(F.broadcast(mark), "_hash", "left")
        depth = F.coalesce(F.col(f"_deep{k}"), depth)
    cells = there.select("doc_id", "part", "mask", "n", "text", prefix(text, depth).alias("prefix"))
    cells = cells.select("doc_id", "part", "mask", "n", "text", F.substring("prefix", 1, FRONT * WIDEN).alias("front"), F.xxhash64("prefix").alias("cell"))
    dealt = cells.repartitionByRange(int(tasks), "front", "cell").sortWithinPartitions("front", "cell").drop("front")
    types = dict(rows.dtypes)
    return dealt.mapInArrow(flagger(["doc_id", "part", "mask", "n"]), f"doc_id {types['doc_id']}, part string, mask int, n long")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **sizes) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail exactly the filters of a mask, and how many of those are labelled good or toxic."""
    kind = docs.select(F.col(f"`{id_col}`")).dtypes[0][1]
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    names = ["doc_id", "part", "mask", "n", "size", "text"]
    first = materialise(own.mapInArrow(masker(names), f"doc_id {kind}, part string, mask int, n long, size long, text string"), "filter-masks")
    sure = first.where(F.col("text").isNull()).select("doc_id", "part", "mask", "n")
    rows = sure.union(copies_flagged(first.where(F.col("text").isNotNull()), **sizes)).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of = lambda name: F.sum(F.col("n") * F.coalesce(F.col(name), F.lit(0))).alias(name)
    return rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts count as empty, null parts as the empty string. A document fails E when another row has its text and a smaller
    id; null ids are larger than all others and equal to each other; repeated rows count each and share their flags. Of several
    labels of a document any 1 counts; labels without an id and missing ones mark nothing. An empty table gives no rows. Other columns are ignored.

    Masks of failed filters are counted per part (at most 32 each), and every order and step is a sum over those.
    """
    counts = masks(docs, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cases"))
    steps = counts.select("part", "cases", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda place: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {place}, 1)) - 1)")
    before = sum((F.when(F.col("step") > i, bit(i)).otherwise(0) for i in range(1, len(FILTERS))), F.lit(0))
    steps = steps.select("*", bit("step").alias("own"), before.alias("before"))
    own, ahead = F.col("own"), F.col("before")

    def total(test, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cases", test), F.lit(0).cast("long"), lambda a, c: a + value(c))

    out = lambda c: (c["mask"].bitwiseAND(own) != 0) & (c["mask"].bitwiseAND(ahead) == 0)
    share = lambda c: c["n"] * (F.lit(len(ORDERS)) / F.bit_count(c["mask"])).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["mask"].bitwiseAND(own.bitwiseOR(ahead)) == 0).alias("kept"),
        total(out).alias("removed"),
        total(lambda c: (c["mask"].bitwiseAND(own) != 0) & (c["mask"].bitwiseAND(ahead) != 0)).alias("redundant"),
        total(lambda c: c["mask"] == own).alias("unique_fails"),
        total(out, lambda c: c["good"]).alias("good_lost"),
        total(out, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: c["mask"].bitwiseAND(own) != 0, share).alias("shapley"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS low FROM t),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN low < doc_id OR doc_id IS NULL AND low IS NOT NULL THEN 16 ELSE 0 END AS mask
  FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT filter_order, step, CAST(2 ** (instr('ABCDE', filter_order[step]) - 1) AS INTEGER) AS own,
         CAST(list_sum([0.0] || list_transform(range(1, step), lambda i: 2 ** (instr('ABCDE', filter_order[i]) - 1))) AS INTEGER) AS ahead
  FROM o, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN mask & (own | ahead) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & own <> 0 AND mask & ahead = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & own <> 0 AND mask & ahead <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & own <> 0 AND mask & ahead = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & own <> 0 AND mask & ahead = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & own <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
