"""Document fingerprints by content-defined chunking: a gear hash over the bytes sets the cuts, so that inserted or
removed text moves no later cut; a fingerprint is the set of chunk digests, each weighted by the chunk's length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import column

GEAR = np.random.default_rng(20_240_311).integers(0, 2**32, 256, dtype=np.uint32)
#: Bytes that the rolling hash sees; below LEAST, so that no cut depends on bytes before its chunk.
WINDOW = 16
LEAST, NORMAL, MOST = 16, 48, 192
#: Cuts before NORMAL need all bits of HARD to be zero, later ones those of EASY: chunk sizes gather around NORMAL.
HARD, EASY = np.uint32(0xFE000000), np.uint32(0xF0000000)

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of raw, the last one len(raw)."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(raw, np.uint8)]
    step = 1
    while step < WINDOW:  # after each pass a value covers twice as many bytes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    easy = np.flatnonzero((h & EASY) == 0) + 1
    hard = easy[(h[easy - 1] & HARD) == 0].tolist()
    easy = easy.tolist()
    ends, at = [], 0
    while n - at > LEAST:
        middle, far = at + NORMAL, min(at + MOST, n)
        i = bisect_left(hard, at + LEAST)
        if i < len(hard) and hard[i] <= middle:
            at = hard[i]
        else:
            i = bisect_left(easy, middle + 1)
            at = easy[i] if i < len(easy) and easy[i] <= far else far
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def digests(text: str) -> dict[int, int]:
    """Weight (bytes) of each distinct 40-bit chunk digest. The empty text has no chunk."""
    raw = text.encode()
    view, out, a = memoryview(raw), {}, 0
    for b in chunk_ends(raw):
        out[xxhash.xxh3_64_intdigest(view[a:b]) >> 24] = b - a
        a = b
    return out


def likeness(x: dict[int, int], y: dict[int, int]) -> float:
    """Containment: the weight both share over the smaller total; two empty sets are alike, one empty set is not."""
    if not x or not y:
        return float(not x and not y)
    if len(y) < len(x):
        x, y = y, x
    return min(1.0, sum(w for d, w in x.items() if d in y) / min(sum(x.values()), sum(y.values())))


def spelled(x: dict[int, int]) -> str:
    """The fingerprint as text: ten hex digits of digest and two of length for each chunk, by digest."""
    return "".join([f"{d:010x}{w:02x}" for d, w in sorted(x.items())])


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of following."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _ranges(ids: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ids that cut the table into ranges of about equal counts."""
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    return sorted(set(cuts or []))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger (id, text); the last one's is the first. A lone document is its own next.
    Null text counts as empty; null ids come first; other columns are ignored; an empty table gives no rows. Texts move
    once, to ranges of the id; the first document of each range also goes to the range before it, so that each task
    walks its documents in order and knows the one after the last.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = _ranges(base, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = base.withColumn("range", _search(cuts))
    heads = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "no_id")).alias("h")).select("range", "h.doc_id").orderBy("range").collect()
    before = {h.doc_id: heads[i - 1].range for i, h in enumerate(heads)}  # one head per range: bounded by the partitions
    heads_of = base.where(F.col("doc_id").isin(list(before))) if before else base.limit(0)
    back = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("doc_id")] if before else F.lit(0)
    sent = ranged.withColumn("head", F.lit(False)).unionByName(heads_of.withColumn("range", back).withColumn("head", F.lit(True)))
    moved = sent.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "head", "doc_id", "text")

    def run(batches):
        held = None  # range, doc_id, text, its digests
        rows: list[tuple] = []
        closed = None

        def finish(text, found):
            _, doc, own, mine = held
            new = edited(own, text)
            changed = digests(new)
            rows.append((doc, len(own), hashlib.sha256(new.encode()).hexdigest(), spelled(mine), spelled(changed), likeness(mine, changed), likeness(mine, found)))

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            rows.clear()
            return made

        for batch in batches:
            ids, none, text, where, head = (column(batch, c).to_pylist() for c in ("doc_id", "no_id", "text", "range", "head"))
            for i in range(len(ids)):
                if head[i] and closed == where[i]:
                    continue  # rows with the head's id beyond the first
                found = digests(text[i])
                if held is not None and held[0] == where[i]:
                    finish(text[i], found)
                held = None if head[i] else (where[i], None if none[i] else ids[i], text[i], found)
                closed = where[i] if head[i] else closed
                if len(rows) >= 500:
                    yield out()
        if rows:
            yield out()

    return moved.mapInArrow(run, SCHEMA)


def _search(cuts: list[int]):
    """How many cuts are at or below doc_id, by halving: a tree of comparisons of logarithmic depth."""

    def half(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("doc_id") >= cuts[m], half(m + 1, b)).otherwise(half(a, m))

    return half(0, len(cuts))
