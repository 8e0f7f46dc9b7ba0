"""Exact components of documents under word-shingle Jaccard similarity, as a metric-space join.

d(x, y) = 1 - Jaccard is a metric, but almost all pairs of documents stand at distance 1, where pivots tell nothing
apart: every document would be a boundary document of every region. So exact filters first leave only documents that
can have a partner, and regions are made among those:

1. A partner shares a fixed part of a document's shingles. Shingles of one slice of the hash space are counted; a
   document with more unshared ones there than the whole may have goes. Shuffled: four bytes of each fourth shingle.
2. Equal sets become one representative (smallest id); the others are its members, at distance 0. Filter 1 runs again
   over the representatives.
3. Representatives with too few shared shingles go; the rarest of the rest is the prefix in which partners must meet.

Then Voronoi regions: each representative joins the pivot it meets most often in its prefix, when within NEAR of it. By
the triangle inequality two linked members lie within 1 - threshold of each other in distance to the pivot. A document
that meets another region and could reach it by the triangle inequality is replicated into it. A region of more than CELL
members is joined recursively: it gets up to PIVOTS pivots of its own, its members go to the nearest one, and to every
other that is at most twice 1 - threshold farther, and so on while that separates them. What is within the threshold of a
pivot is linked to it at once; members of one component known so far need not meet again. So a large region that is mostly
one component costs one distance a member and some for the others, which meet in pairs of bounded blocks; a task emits a spanning
forest of its links. Members of a region with many components, such as thousands of copies of one form, meet by the region's rarest
shingles: of two linked sets of n and m >= n shingles one of the n - 2pn / (1 + p) + 1 rarest of the smaller is among the
m - pm + 1 rarest of the larger. So what all copies of a form have in common brings none of them together, unless they
differ in so little that they are linked anyway.

Sets hold 64-bit hashes of shingles, and equal sets are found by 128-bit hashes of them; a key with many rows is salted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.io import free_name, materialise
from tidemark.llm.shingles import shingle_sets
from tidemark.llm.spread import salts_of, spread_join
from tidemark.llm.words import column, slices, texts_of

#: Share of the hash space that filter 1 looks at: one in 2 ** SLICE_BITS.
SLICE_BITS = 2
FLUSH_BYTES = 64 << 20
#: A document joins a pivot's region when within this distance of it.
NEAR = 0.5
#: Members that a region may have without being split, and of one shingle that one side of a key holds.
CELL = 512
BLOCK = 256
#: Copies of a member's set, on average, from which on a region's members meet by shingles; what those cost in sets.
COPIES = 10
#: Pivots of a region that is split.
PIVOTS = 8
SLACK = 1e-9
#: Hashes that filter 1 looks up in one table, and bytes of rows for each of its ranges.
TABLE = 1 << 20
RANGE_BYTES = 64 << 20


def _needed(n, percent: int):
    """Fewest shingles that a set of n must share with a partner."""
    return (n * percent + 99) // 100


def _of_texts(width: int):
    """Set hashes and offsets of each slice of a batch with a text column."""

    def read(batch):
        for some in slices(batch, "text", 2 << 20):
            yield shingle_sets(texts_of(some, "text"), width)

    return read


def _of_sets(batch):
    """The same for a batch with a hashes column."""
    lists = column(batch, "hashes")
    at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    yield lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), at - at[0]


def _candidates(docs: DataFrame, read, percent: int, size) -> DataFrame:
    """(doc_id, n, keep): set sizes, and whether filter 1 leaves the document; exact, as a partner shares needed(n).

    size is the bytes that a row adds to the hash ranges, of which a task holds one at a time; their number follows the rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(size)).first()[0] or 0
    parts = 1 << max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1, total // RANGE_BYTES).bit_length()
    shift = np.uint64(64 - SLICE_BITS - (parts.bit_length() - 1))

    def sketch(batches):
        task, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            own = [np.zeros(0, np.int64)]
            for h, at in read(batch):
                low = h >> np.uint64(64 - SLICE_BITS) == 0
                count = np.concatenate(([0], np.cumsum(low)))[at]
                hashes.append(h[low])
                sizes.append(np.diff(at))
                own.append(np.diff(count))
            flat, n, mine = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(own)
            part = (flat >> shift).astype(np.int64)
            order = np.argsort(part, kind="stable")
            row = np.repeat(np.arange(len(n), dtype=np.uint32), mine)[order]
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            short = flat[order].astype(np.uint32)
            key = task + made
            made += 1
            found = [(int(p), key, short[a:b].tobytes(), row[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            ids = pa.array(column(batch, "doc_id")).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            found.append((key % parts, key, n.astype("<u4").tobytes() + mine.astype("<u4").tobytes() + ids, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "key", "a", "b"])

    def shared(batches):
        held: dict[int, np.ndarray] = {}
        now, waiting = None, []

        def close():
            if not waiting:
                return
            h = np.concatenate([np.frombuffer(a, np.uint32) for _, a, _ in waiting])
            hit = np.zeros(len(h), bool)
            pieces = len(h) // TABLE + 1  # ranges of mixed hashes, so that a table's size does not follow the input's
            mixed = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            piece = (mixed >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)
            for k in range(pieces):
                own = np.flatnonzero(piece == k) if pieces > 1 else np.arange(len(h))
                bits = max(16, int(len(own) * 16).bit_length())
                slot = (mixed[own] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)
                last = np.zeros(1 << bits, np.int32)
                last[slot] = np.arange(len(own), dtype=np.int32)
                again = np.zeros(1 << bits, bool)
                again[slot[last[slot] != np.arange(len(own))]] = True
                hit[own] = again[slot]
            at = 0
            for key, a, b in waiting:
                rows = np.frombuffer(b, np.uint32)
                own = hit[at : at + len(rows)]
                at += len(rows)
                count = np.bincount(rows[own])
                if len(count):
                    old = held.get(key, np.zeros(0, np.int64))
                    total = np.zeros(max(len(old), len(count)), np.int64)
                    total[: len(old)] += old
                    total[: len(count)] += count
                    held[key] = total
            waiting.clear()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in held.values()], pa.binary()), pa.array([None] * len(held), pa.binary())], names=["key", "shared", "head"])
            held.clear()
            return out

        for batch in batches:
            for part, key, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if b is None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([None], pa.binary()), pa.array([a], pa.binary())], names=["key", "shared", "head"])
                    continue
                if part != now:
                    close()
                    now = part
                waiting.append((key, a, b))
            if sum(x.nbytes for x in held.values()) > FLUSH_BYTES:
                yield flush()
        close()
        yield flush()

    def judge(batches):
        now, head, total = None, None, None

        def close():
            n, mine, ids = head
            if total is not None:
                mine = mine.copy()
                mine[: len(total)] -= total
            keep = (n > 0) & (mine <= n - _needed(n, percent))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(keep)], names=["doc_id", "n", "keep"])

        for batch in batches:
            for key, counts, top in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if head is not None:
                        yield close()
                    now, head, total = key, None, None
                if top is not None:
                    k = len(top) // 16
                    n, mine = np.frombuffer(top, "<u4", 2 * k).astype(np.int64).reshape(2, k)
                    head = n, mine, np.frombuffer(top, "<i8", k, 8 * k)
                else:
                    c = np.frombuffer(counts, "<u4").astype(np.int64)
                    if total is None or len(total) < len(c):
                        c, total = (c.copy(), total) if total is not None else (c.copy(), np.zeros(0, np.int64))
                        c[: len(total)] += total
                        total = c
                    else:
                        total[: len(c)] += c
        if head is not None:
            yield close()

    first = docs.mapInArrow(sketch, "part int, key long, a binary, b binary").repartition("part").sortWithinPartitions("part")
    second = first.mapInArrow(shared, "key long, shared binary, head binary").repartition("key").sortWithinPartitions("key")
    return second.mapInArrow(judge, "doc_id long, n long, keep boolean")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for given in batches:
            for batch in slices(given, "text", 2 << 20):
                h, at = shingle_sets(texts_of(batch, "text"), width)
                signed = h.view(np.int64)
                hashes = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed))
                ends = at.tolist()
                whole = b"".join(xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(ends, ends[1:]))
                keys = np.frombuffer(whole, "<i8").reshape(-1, 2).T.copy()
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(at)), *map(pa.array, keys), hashes], names=["doc_id", "n", "k1", "k2", "hashes"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, hashes array<long>")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with inter and uni, the sizes of intersection and union of their sets.

    Merge joins here and elsewhere: what looks small enough to broadcast grows with the corpus.
    """
    a = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").withColumn("inter", F.size(F.array_intersect("ha", "hb")).cast("long"))
    return both.select(*pairs.columns, "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("uni"))


def _posts(sets: DataFrame, percent: int, within: str | None = None) -> DataFrame:
    """(doc_id, n, h, pos, short): the prefix of each set in the order of rarity, without shingles that no other set has.

    pos counts the rarer shingles, short tells whether the shingle is of those that must meet larger sets. With within, a
    column of sets, rarity and prefixes are those inside its groups, and it is kept.
    """
    keys = [within] if within else []
    tokens = sets.select(*keys, "doc_id", F.explode("hashes").alias("h"))
    counts = tokens.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("df"), salts_of("doc_id").alias("_salts")).where("df > 1")
    shared = spread_join(tokens, counts, [*keys, "h"], "doc_id").groupBy(*keys, "doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    shared = shared.join(sets.select(*keys, "doc_id", "n").hint("merge"), [*keys, "doc_id"])
    spare = F.expr(f"n - (n * {percent} + 99) div 100")
    alone = F.col("n") - F.size("s")
    prefix = shared.where(alone <= spare).select(*keys, "doc_id", "n", alone.alias("_alone"), F.posexplode(F.slice("s", F.lit(1), (spare + 1 - alone).cast("int"))).alias("_at", "t"))
    first = F.expr(f"n - (n * {2 * percent} + {99 + percent}) div {100 + percent} + 1")
    pos = F.col("_alone") + F.col("_at")
    return prefix.select(*keys, "doc_id", "n", F.col("t.h").alias("h"), pos.alias("pos"), (pos < first).alias("short"))


def _regions(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, pivot, d): each document's Voronoi region and distance to its pivot; a pivot has its own."""
    lead = posts.groupBy("h").agg(F.min("doc_id").alias("b"), salts_of("doc_id").alias("_salts"))
    met = spread_join(posts, lead, ["h"], "doc_id").where("doc_id <> b").groupBy("doc_id", "b").count()
    first = materialise(met.groupBy("doc_id").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b")), "first")
    for _ in range(2):  # pivots of pivots, so that one group of near copies gathers around few of them
        up = first.select(F.col("doc_id").alias("b"), F.col("b").alias("up"))
        first = materialise(first.join(up, "b", "left").select("doc_id", F.coalesce("up", "b").alias("b")).where("doc_id <> b"), "first")
    pivots = first.select(F.col("b").alias("doc_id")).distinct()
    loose = first.join(pivots, "doc_id", "left_anti").select(F.col("doc_id").alias("a"), "b")
    near = _measured(loose, sets).select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), (1 - F.col("inter") / F.col("uni")).alias("d")).where(F.col("d") <= NEAR)
    own = posts.select("doc_id").distinct()
    return materialise(own.join(near, "doc_id", "left").select("doc_id", F.coalesce("pivot", "doc_id").alias("pivot"), F.coalesce("d", F.lit(0.0)).alias("d")), "regions")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) among representatives whose components are those of all links."""
    posts = materialise(_posts(sets, percent).select("doc_id", "h", "short"), "posts")
    home = _regions(posts, sets)
    r = 1 - percent / 100
    radius = home.groupBy("pivot").agg(F.max("d").alias("radius"))

    # Boundary documents: those that meet a region of a smaller pivot and could reach it. One of two linked sets shows its short
    # prefix, so a long one meets only the short ones of a region.
    placed = posts.join(home, "doc_id").select("doc_id", "h", "pivot", "short")
    docs_of = placed.groupBy("h").agg(salts_of("doc_id").alias("docs"), salts_of("pivot").alias("_salts"), F.min("pivot").alias("p0"), F.max("pivot").alias("p1"))
    docs_of = docs_of.where("p0 <> p1").drop("p0", "p1")  # the others meet one region, their own
    pivots_of = placed.groupBy("h", F.col("pivot").alias("other")).agg(F.max("short").alias("shows"))
    there = spread_join(pivots_of, docs_of, ["h"], "other").withColumnRenamed("docs", "_salts")
    meets = spread_join(placed, there, ["h"], "doc_id").where("other < pivot and (short or shows)").select(F.col("doc_id").alias("a"), F.col("other").alias("b")).distinct()
    guests = _measured(meets, sets).select("a", "b", (1 - F.col("inter") / F.col("uni")).alias("d")).join(radius.withColumnRenamed("pivot", "b"), "b")
    guests = guests.where(F.col("d") <= F.col("radius") + r + SLACK).select(F.col("b").alias("pivot"), F.col("a").alias("doc_id"), "d", F.lit(True).alias("guest"))
    members = home.select("pivot", "doc_id", "d", F.lit(False).alias("guest")).union(guests)
    cells = materialise(members.select(F.col("pivot").cast("string").alias("region"), "doc_id", "d", "guest"), "cells")
    direct = home.where((F.col("doc_id") != F.col("pivot")) & (F.col("d") <= r - SLACK)).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))

    settled, more = _recurse(cells, sets, percent)
    if more is None:
        label = home.select("doc_id", F.when(F.col("d") <= r - SLACK, F.col("pivot")).otherwise(F.col("doc_id")).alias("label"))
    else:
        direct = direct.union(more)
        label = components(direct).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    settled = settled.join(label.hint("merge"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    return direct.union(_met(materialise(settled, "settled"), sets, percent))


def _recurse(cells: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """cells with the regions of more than CELL members split as far as pivots separate them, and the links to new pivots.

    A split counts when it puts a member into two cells on average at most and no cell has over three quarters of the
    region; other regions stay whole.
    """
    r = 1 - percent / 100
    settled, edges = [], []
    now = cells
    for level in range(1, 40):
        sizes = now.groupBy("region").agg(F.count(F.lit(1)).alias("k"), salts_of("doc_id").alias("_salts")).where(F.col("k") > CELL)
        sizes = materialise(sizes, "large-regions")
        if sizes.isEmpty():
            break
        large = materialise(spread_join(now, sizes, ["region"], "doc_id"), "large")
        settled.append(now.join(sizes.select("region").hint("merge"), "region", "left_anti"))
        order = lambda k: F.xxhash64("doc_id", F.lit(level * 2 + k))
        chosen = large.groupBy("region", F.pmod(order(0), F.lit(PIVOTS)).alias("nth")).agg(F.min_by("doc_id", order(1)).alias("pivot"))
        own_sets = sets.select("doc_id", "n", "hashes")
        pivots = chosen.join(own_sets.withColumnRenamed("doc_id", "pivot").hint("merge"), "pivot").groupBy("region").agg(F.collect_list(F.struct("pivot", "n", "hashes")).alias("pivots"))
        asked = spread_join(large.join(own_sets.hint("merge"), "doc_id"), pivots.join(sizes.select("region", "_salts"), "region"), ["region"], "doc_id")

        def to(p):
            inter = F.size(F.array_intersect("hashes", p["hashes"])).cast("long")
            return F.struct((1 - inter / (F.col("n") + p["n"] - inter)).alias("d"), p["pivot"].alias("pivot"), (inter * 100 >= (F.col("n") + p["n"] - inter) * percent).alias("linked"))

        far = asked.select("region", "doc_id", "guest", "k", "d", F.sort_array(F.transform("pivots", to)).alias("far"))
        far = materialise(far, "distances")
        edges.append(far.select(F.col("doc_id").alias("a"), F.explode(F.filter("far", lambda x: x["linked"] & (x["pivot"] != F.col("doc_id")))).alias("x")).select("a", F.col("x.pivot").alias("b")))
        within = far.select("region", "doc_id", "guest", "k", F.col("d").alias("old"), F.posexplode(F.filter("far", lambda x: x["d"] <= F.expr("far[0].d") + 2 * r + SLACK)).alias("nth", "x"))
        split = within.select("region", "k", F.concat_ws("/", "region", F.col("x.pivot").cast("string")).alias("cell"), "doc_id", F.col("x.d").alias("d"), (F.col("guest") | (F.col("nth") > 0)).alias("guest"))
        split = materialise(split, "split")
        gain = split.groupBy("region", "cell", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("region", "k").agg(F.sum("c").alias("total"), F.max("c").alias("most"))
        good = materialise(gain.where("total <= 2 * k and most <= 0.75 * k").select("region"), "good-splits")
        settled.append(far.select("region", "doc_id", "d", "guest").join(good.hint("merge"), "region", "left_anti"))
        now = split.join(good.hint("merge"), "region", "left_semi").select(F.col("cell").alias("region"), "doc_id", "d", "guest")
    else:
        raise RuntimeError("regions did not come to an end")
    every = now
    for part in settled:
        every = every.unionByName(part)
    links = None
    for part in edges:
        links = part if links is None else links.union(part)
    return every.select("region", "doc_id", "d", "guest"), links


def _met(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one region that have different labels.

    Members with a region's commonest label meet only the others. A region of up to CELL members is one block; a larger one is dealt
    to blocks that meet in pairs, where that copies a member's set COPIES times at most on average, and else meets by shingles.
    """
    counts = cells.groupBy("region", "label").agg(F.count(F.lit(1)).alias("c"), salts_of("doc_id").alias("s"))
    region = counts.groupBy("region").agg(F.sum("c").alias("k"), F.max("c").alias("main"), F.max_by("label", F.struct("c", "label")).alias("main_label"), F.count(F.lit(1)).alias("labels"), F.bit_or("s").alias("_salts")).where("labels > 1")
    minor, main = (F.when(F.col("k") <= CELL, one).otherwise(F.ceil(x / BLOCK)).cast("int") for x, one in ((F.col("k") - F.col("main"), 1), (F.col("main"), 0)))
    copies = F.col("main") * F.col("m") + (F.col("k") - F.col("main")) * (F.col("m") + F.col("rest"))
    region = region.withColumns({"m": minor, "rest": main}).withColumn("many", (F.col("k") > CELL) & (copies > COPIES * F.col("k")))
    there = materialise(spread_join(cells, region.select("region", "main_label", "m", "rest", "many", "_salts"), ["region"], "doc_id"), "to-meet")
    few, many = there.where(~F.col("many")), there.where("many")
    first = (F.col("rest") == 0) | (F.col("label") != F.col("main_label"))
    own = F.when(first, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest("rest", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("own") < F.col("m"), F.col("m") + F.col("rest")).otherwise(F.col("m")) - 1)
    dealt = few.withColumn("own", own).select("region", "own", "doc_id", "d", "guest", "label", F.explode(others).alias("other"))
    dealt = dealt.select("region", F.least("own", "other").alias("block"), F.greatest("own", "other").alias("block2"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc_id", "d", "guest", "label")
    full = dealt.join(sets.select("doc_id", "n", "hashes").hint("merge"), "doc_id")
    links = full.groupBy("region", "block", "block2").applyInArrow(_compare(percent), "a long, b long")
    if many.isEmpty():
        return links
    return links.union(_met_by_shingle(many.select(F.xxhash64("region").alias("region"), "doc_id", "d", "guest", "label").join(sets.hint("merge"), "doc_id"), sets, percent))


def _met_by_shingle(full: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a region with different labels that share a shingle of the smaller one's short prefix.

    Rarity is the region's own. A shingle's members are dealt to blocks of about BLOCK and meet in pairs of blocks; of those pairs only
    the ones whose sizes, places of the shingle and distances to the pivot allow a link are measured, each once.
    """
    posts = materialise(_posts(full, percent, "region").join(full.select("region", "doc_id", "d", "guest", "label").hint("merge"), ["region", "doc_id"]), "region-posts")
    sizes = posts.groupBy("region", "h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), salts_of("doc_id").alias("_salts"), F.max("short").alias("any"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("any and l0 <> l1")
    dealt = spread_join(posts, sizes.select("region", "h", "blocks", "_salts"), ["region", "h"], "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = [dealt.where("short") if k == "a" else dealt for k in "ab"]
    a, b = (t.select("region", "h", *((F.col("own").alias("x"), every.alias("y")) if k == "a" else (every.alias("x"), F.col("own").alias("y"))), *(F.col(c).alias(f"{k}_{c}") for c in ("doc_id", "n", "pos", "d", "guest", "label"))) for t, k in zip(sides, "ab"))
    r = 1 - percent / 100 + SLACK
    pairs = a.join(b.hint("merge"), ["region", "h", "x", "y"]).where("a_label <> b_label and (a_n < b_n or a_n = b_n and a_doc_id < b_doc_id) and not (a_guest and b_guest)")
    pairs = pairs.where((F.abs(F.col("a_d") - F.col("b_d")) <= r) & (F.col("a_n") * 100 >= F.col("b_n") * percent))
    most = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    pairs = pairs.where(most * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()
    return _measured(pairs, sets).where(F.col("inter") * 100 >= F.col("uni") * percent).select("a", "b")


def _compare(percent: int):
    """Links between the two blocks of a group (or inside one), as a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        get = {c: group.column(c).to_numpy() for c in ("side", "doc_id", "d", "guest", "label", "n")}
        lists = group.column("hashes").chunk(0) if group.num_rows else None
        at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        at = at - at[0]
        _, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        n, d = get["n"].astype(np.int64), get["d"]
        owner = np.repeat(np.arange(len(n)), n)
        mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
        parent = list(range(len(n)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        two = bool((get["side"] == 1).any())
        r = 1 - percent / 100 + 1e-9
        out = []
        for i in range(len(n)):
            if two and get["side"][i] == 1:
                continue
            can = (get["side"] == 1) if two else np.arange(len(n)) > i
            can = can & (get["label"] != get["label"][i]) & ~(get["guest"] & get["guest"][i]) & (np.abs(d - d[i]) <= r) & (n * 100 >= n[i] * percent) & (n[i] * 100 >= n * percent)
            if not can.any():
                continue
            own = code[at[i] : at[i + 1]]
            mark[own] = True
            inter = np.bincount(owner[mark[code]], minlength=len(n))
            mark[own] = False
            for j in np.flatnonzero(can & (inter * 100 >= (n + n[i] - inter) * percent)).tolist():
                x, y = root(i), root(j)
                if x != y:
                    parent[x] = y
                    out.append((int(get["doc_id"][i]), int(get["doc_id"][j])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a set holds the distinct shingles of width words, or the whole
    sequence of a shorter text; a null or empty text has the empty set and no link. Two documents link when
    100 * intersection >= percent * union. Rows with a null id are left out; of rows with the same id the one with most
    shingles counts, of several such the one with the largest set hash. An empty table gives no rows; other columns are
    ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    sizes = materialise(_candidates(base, _of_texts(width), percent, F.octet_length("text")), "sizes")
    few = sizes.where("keep").select("doc_id")
    if few.isEmpty():
        return sizes.groupBy("doc_id").agg(F.max("n").alias("n_shingles")).withColumn("component_id", F.col("doc_id"))
    found = _sets(base.join(few.hint("merge"), "doc_id", "left_semi"), width)
    one = found.groupBy("doc_id").agg(F.max_by(F.struct("n", "k1", "k2", "hashes"), F.struct("n", "k1", "k2")).alias("s"))
    sets = materialise(one.select("doc_id", "s.*"), "sets")
    classes = sets.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), salts_of("doc_id").alias("_salts"))
    member = materialise(spread_join(sets.select("doc_id", "k1", "k2", "n"), classes, ["k1", "k2", "n"], "doc_id").select("doc_id", "rep"), "members")
    reps = materialise(sets.join(member.where("doc_id = rep").select("doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", "n", "hashes"), "reps")
    some = materialise(_candidates(reps.select("doc_id", "hashes"), _of_sets, percent, 8 * F.size("hashes")).where("keep").select("doc_id"), "candidates")
    if some.isEmpty():
        found = member.select("doc_id", F.col("rep").alias("component"))
    else:
        left = materialise(reps.join(some.hint("merge"), "doc_id", "left_semi"), "sets")
        label = components(_links(left, percent)).withColumnRenamed("node", "rep")
        found = member.join(label, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    found = found.where("doc_id <> component")
    return sizes.groupBy("doc_id").agg(F.max("n").alias("n_shingles")).join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the smallest id.

    Every row counts. Of repeated rows with the same id and text one stays; other rows of one id, and rows with a null
    id, are documents of their own that sort after all others. Null and empty texts are linked with nothing and stay;
    columns of any name stay as they are; an empty table stays empty.
    """
    key, first = free_name(docs, "key"), free_name(docs, "first")
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    odd = materialise(counts.where("doc_id is null or n > 1").select(F.col("doc_id").alias("odd")), "odd-ids")
    if odd.isEmpty():
        return _stay(docs.withColumn(key, F.col("doc_id").cast("long")), key, width, percent)
    mine = F.col("doc_id").eqNullSafe(odd["odd"])
    some = docs.join(odd, mine, "left_semi").dropDuplicates(["doc_id", "text"])
    lead = F.col("doc_id").isNotNull() & (F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text")) == 1)
    top = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0))).first()[0]
    own = F.when(F.col(first), F.col("doc_id").cast("long")).otherwise(F.lit(max(top, 0) + 1) + F.monotonically_increasing_id())
    some = materialise(some.withColumn(first, lead).withColumn(key, own).drop(first), "odd-rows")
    rest = docs.where("doc_id is not null").join(odd, mine, "left_anti")
    return _stay(rest.withColumn(key, F.col("doc_id").cast("long")).unionByName(some), key, width, percent)


def _stay(keyed: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """Rows whose key is the smallest of its component, without the key."""
    stay = jaccard_components(keyed, width, percent, id_col=key).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return keyed.join(stay, key, "left_semi").drop(key)
