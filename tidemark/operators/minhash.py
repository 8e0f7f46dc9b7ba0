"""Pairs of alike sets by the items of smallest hashes; the similarity of every pair is exact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import checkpointed

#: Items by which a set meets others: all, or those of the smallest hashes.
SKETCH = 256
#: Sets that meet by an item, or in a bucket, as they are; those of a more frequent item are hashed again.
BUCKET = 500
#: Meetings that one task counts.
MEETINGS_A_TASK = 1_000_000
#: Words of 64 bits in which a set's items are marked.
WORDS = 32


def bands_for(least: float, recall: float, rows: int = 1) -> int:
    """The fewest bands of `rows` hashes in which two sets of Jaccard similarity `least` meet with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - least**rows)))


def enough(least: float, recall: float, size: int) -> int:
    """The most of `size` smallest hashes that two larger sets of Jaccard similarity `least` share with probability `recall`."""
    below, m = 0.0, 0
    while m < size:
        below += math.comb(size, m) * least**m * (1 - least) ** (size - m)
        if below > 1 - recall:
            break
        m += 1
    return max(1, m)


def sketches(pairs: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, _s): the SKETCH items of smallest hash of each set, and the set's size."""
    w = Window.partitionBy(key)
    ranked = pairs.select(key, item, F.count(F.lit(1)).over(w).cast("int").alias("_s"), F.row_number().over(w.orderBy(F.xxhash64(item), item)).alias("_r"))
    return ranked.where(F.col("_r") <= SKETCH).drop("_r")


def counted(posted: DataFrame, key: str, item: str) -> DataFrame:
    """(key, other, _s, _t, _h, _g, both), key < other, of each two sets that share an item of posted (key, item, _s, _h), with the
    number that they share; _t and _g are the other's _s and _h.

    The sets of an item stand in order in one array, of which each is sent those after it; so a meeting costs a few bytes in
    the shuffle and nothing after it, and the number of tasks follows the meetings."""
    held = posted.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "_s", "_h"))).alias("_met"))
    n = F.size("_met")
    total = posted.groupBy(item).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    each = held.select("_met", F.posexplode("_met").alias("_at", "_x")).where(F.col("_at") + 1 < n)
    after = F.slice("_met", F.col("_at") + 2, n)
    own = [F.col("_x")["k"].alias(key), F.col("_x")["_s"].alias("_s"), F.col("_x")["_h"].alias("_h")]
    sent = each.select(*own, after.alias("_y")).select(key, "_s", "_h", *[F.col("_y")[a].alias(b) for a, b in (("k", "other"), ("_s", "_t"), ("_h", "_g"))])
    met = sent.repartition(1 + total // MEETINGS_A_TASK, key).select(key, "_s", "_h", F.inline(F.arrays_zip("other", "_t", "_g")))
    return met.groupBy(key, "other").agg(*[F.max(c).alias(c) for c in ("_s", "_t", "_h", "_g")], F.count(F.lit(1)).alias("both"))


def signatures(pairs: DataFrame, key: str, item: str, n: int, level: int) -> DataFrame:
    """(key, hashes): n minimum hashes of each set, one aggregate of fixed size a key. Levels are independent."""
    mins = [F.min(F.xxhash64(F.lit(level), F.lit(i), item)).alias(f"_{i}") for i in range(n)]
    return pairs.groupBy(key).agg(*mins).select(key, F.array(*[f"_{i}" for i in range(n)]).alias("hashes"))


def posts(signed: DataFrame, key: str, rows: int, n: int) -> DataFrame:
    """(key, bucket) for each of n bands of `rows` hashes; signed may carry the bucket of an earlier level."""
    band = lambda i: F.xxhash64(*[c for c in ("bucket",) if c in signed.columns], F.lit(i), F.slice("hashes", i * rows + 1, rows))
    return signed.select(key, F.explode(F.array(*[band(i) for i in range(n)])).alias("bucket"))


def meeting(posted: DataFrame, key: str, most: int) -> DataFrame:
    """(key, other), key < other, of each two members of a bucket. One of n members is dealt to n / most blocks, and each two
    blocks are a join key of their own, so that none makes more than about most ** 2 pairs and nothing is left out."""
    sizes = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dealt = posted.join(sizes, "bucket").withColumn("_n", F.ceil(F.col("_n") / most).cast("int")).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = dealt.select("bucket", key, F.col("_own").alias("_a"), every.alias("_b"))
    b = dealt.select("bucket", F.col(key).alias("other"), every.alias("_a"), F.col("_own").alias("_b"))
    return a.join(b, ["bucket", "_a", "_b"]).where(F.col(key) < F.col("other")).select(key, "other")


def alike(pairs: DataFrame, key: str, item: str, least: float, recall: float = 0.96, rows: int = 1, most: int = BUCKET) -> DataFrame:
    """(key, other, both, jaccard), key < other, of sets that share enough items of smallest hash and have at least the similarity
    `least`.

    pairs has each (key, item) once; rows with a null are left out. A set of at most SKETCH items is its own sketch, so that two of
    them are counted exactly where they meet, and none is lost. Of a larger set the items of smallest hash meet; a pair of
    similarity `least` has `enough` of them in common with probability `recall`, a more similar one with a higher, and what has is
    compared. An item of more than `most` sets is hashed again by bands of a second signature, which only its sets need; what is
    then still large meets in blocks. A pair that has only such items in common is found with `recall`, and no cap drops one.
    """
    pairs = checkpointed(pairs.select(key, item).dropna())
    sketch = checkpointed(sketches(pairs, key, item))
    counts = sketch.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    common = checkpointed(counts.where(F.col("_n") > most).select(item))
    none = common.isEmpty()
    if none:
        hot, posted = None, sketch.withColumn("_h", F.lit(0))
    else:
        hot = checkpointed(sketch.join(common, item).select(key, item))
        held = hot.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("_h"))
        posted = sketch.join(common, item, "left_anti").join(held, key, "left").withColumn("_h", F.coalesce("_h", F.lit(0)))
    met = counted(posted, key, item)
    whole = F.greatest("_s", "_t") <= SKETCH
    exact = whole & (F.least("_h", "_g") == 0)
    most_both = F.least("_s", "_t", F.col("both") + F.least("_h", "_g"))
    likely = F.when(whole, most_both >= least * (F.col("_s") + F.col("_t") - most_both)).otherwise(F.col("both") + F.least("_h", "_g") >= enough(least, recall, SKETCH))
    near = checkpointed(met.where(likely & (F.least("_s", "_t") >= least * F.greatest("_s", "_t"))).withColumn("_exact", exact))
    found = near.where("_exact").select(key, "other", "both", (F.col("both") / (F.col("_s") + F.col("_t") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= least)
    unsure = near.where("not _exact").select(key, "other")
    if none and unsure.isEmpty():
        return found
    if not none:
        n = bands_for(least, recall, rows)
        again = signatures(pairs.join(hot.select(key).distinct(), key, "left_semi"), key, item, n * rows, 1)
        second = posts(hot.select(key, F.col(item).alias("bucket")).join(again, key), key, rows, n)
        unsure = unsure.unionByName(meeting(checkpointed(second), key, most)).distinct()
    return found.unionByName(compared(unsure, pairs, key, item, least)).distinct()


def marks(item: str) -> Column:
    """Aggregate: WORDS * 64 bits, of which each item sets one."""
    at = F.pmod(F.xxhash64(F.lit("mark"), item), F.lit(WORDS * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    return F.array(*[F.bit_or(F.when(F.floor(at / 64) == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)])


def compared(met: DataFrame, pairs: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """(key, other, both, jaccard) of the met pairs that reach `least`. Sizes alone rule some out, and marks most of the others: two
    sets have at most as many items in common as marks, and as many more as the items of one that share a mark with another. Of
    those that remain the smaller set is looked up in the larger, item by item, so that no set is held whole."""
    sets = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_size"), marks(item).alias("_bits"))
    add = lambda numbers: F.aggregate(numbers, F.lit(0), lambda a, n: a + n)
    sets = sets.withColumn("_ones", add(F.transform("_bits", F.bit_count)))
    side = lambda name, *to: sets.select(F.col(key).alias(name), *[F.col(a).alias(b) for a, b in zip(("_size", "_bits", "_ones"), to)])
    sized = met.join(side(key, "_s", "_x", "_m"), key).join(side("other", "_t", "_y", "_n"), "other")
    sized = sized.where(F.least("_s", "_t") >= least * F.greatest("_s", "_t"))
    common = add(F.zip_with("_x", "_y", lambda a, b: F.bit_count(a.bitwiseAND(b))))
    bounded = sized.select(key, "other", "_s", "_t", F.least("_s", "_t", common + F.least(F.col("_s") - F.col("_m"), F.col("_t") - F.col("_n"))).alias("_most"))
    bounded = bounded.where(F.col("_most") / (F.col("_s") + F.col("_t") - F.col("_most")) >= least)
    small = F.col("_s") <= F.col("_t")
    sided = bounded.select(key, "other", "_s", "_t", F.when(small, F.col(key)).otherwise(F.col("other")).alias("_small"), F.when(small, F.col("other")).otherwise(F.col(key)).alias("_large"))
    looked = sided.join(pairs.select(F.col(key).alias("_small"), F.col(item).alias("_item")), "_small")
    found = looked.join(pairs.select(F.col(key).alias("_large"), F.col(item).alias("_item")), ["_large", "_item"])
    both = found.groupBy(key, "other", "_s", "_t").agg(F.count(F.lit(1)).alias("both"))
    return both.select(key, "other", "both", (F.col("both") / (F.col("_s") + F.col("_t") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= least)
