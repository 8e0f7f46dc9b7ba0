"""Recommendations from shared purchases, for all clients at once, and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.operators.minhash import alike
from tidemark.operators.ranking import first_per
from tidemark.sources.sinks import checkpointed


#: Weights of frequency by segment, list lengths, items of one group, how far lists reach beyond their quota.
FREQUENCY_WEIGHT = {"HEAVY": 0.40, "REGULAR_CONSISTENT": 0.40, "REGULAR_EXPLORATORY": 0.30, "LIGHT": 0.30}
TOP, REPURCHASE, PER_GROUP, SPARE_REPURCHASE, SPARE_DISCOVERY = 25, 20, 3, 10, 5
UBIQUITOUS, OWN_SHARE = 0.20, 0.6
#: Items of a basket that meet in one key.
BLOCK = 1000
#: Fixed value: latest lines of a client by which it looks for similar ones.
RECENT_LINES = 500
#: Meetings that one task counts.
MEETINGS_A_TASK = 1_000_000


def owned(sales: DataFrame, item: str) -> DataFrame:
    return sales.select("client_id", item).distinct()


def segments(sales: DataFrame, item: str) -> DataFrame:
    """Segment by order count, and for regular buyers by the share of items bought again."""
    orders = sales.groupBy("client_id").agg(F.countDistinct("order_id").alias("n_orders"))
    per = sales.groupBy("client_id", item).agg(F.countDistinct("order_id").alias("n"))
    rate = per.groupBy("client_id").agg((F.sum((F.col("n") >= 2).cast("long")) / F.count(F.lit(1))).alias("rate"))
    heavy, regular = F.col("n_orders") >= 500, F.col("n_orders") >= 100
    label = F.when(heavy, "HEAVY").when(regular & (F.col("rate") >= 0.40), "REGULAR_CONSISTENT").when(regular, "REGULAR_EXPLORATORY").otherwise("LIGHT")
    return orders.join(rate, "client_id").select("client_id", "n_orders", label.alias("segment"))


def frequency_weight(segment: Column) -> Column:
    out = F.lit(FREQUENCY_WEIGHT["LIGHT"])
    for name, w in FREQUENCY_WEIGHT.items():
        out = F.when(segment == name, w).otherwise(out)
    return out


def last_basket_cases(sales: DataFrame, least: int = 2) -> DataFrame:
    """(client_id, as_of, order_id): the last order of each client with at least `least`, and its day as the client's own cut-off."""
    last = sales.groupBy("client_id").agg(F.max(F.struct("created", "order_id")).alias("m"), F.countDistinct("order_id").alias("n")).where(F.col("n") >= least)
    return last.select("client_id", F.col("m.created").alias("as_of"), F.col("m.order_id").alias("order_id"))


def history(sales: DataFrame, cases: DataFrame) -> DataFrame:
    """The sales of each case's client before the case's own cut-off, with as_of."""
    return sales.join(cases.select("client_id", "as_of"), "client_id").where("created < as_of")


def repurchase_at(past: DataFrame, item: str, half_life: float = 21.0) -> DataFrame:
    """(client_id, segment, item, score) from each case's history: frequency and recency over the client's best."""
    per = past.groupBy("client_id", item).agg(F.countDistinct("order_id").cast("double").alias("f"), F.exp(-F.datediff(F.max("as_of"), F.max("created")) / half_life).alias("r"))
    w = Window.partitionBy("client_id")
    df = per.join(segments(past, item), "client_id").withColumn("wf", frequency_weight(F.col("segment")))
    score = F.col("wf") * F.col("f") / F.max("f").over(w) + (1 - F.col("wf")) * F.col("r") / F.max("r").over(w)
    return df.select("client_id", "segment", item, F.round(score, 9).alias("score"))


def meetings(asking: DataFrame, answering: DataFrame, via: str, dated: bool = False, itself: bool = False, once: bool = False) -> DataFrame:
    """(who, size, other, both, other_size): the values of `via` that each two have in common, one row for every two that meet.

    asking has (who, via, size) and answering (other, via, other_size), each (who, via) once; of a pair's other_size, which is at most
    the other's rows, the largest counts. If dated, asking has as_of as well, one of each who, and answering a day, and what lies before
    as_of counts. With `once` only others from who on are met, for tables that ask and answer alike.

    The others of one value travel to the asking one as arrays of about BLOCK, so that a meeting costs a few bytes in the shuffle
    and nothing after it: rows stay partitioned by who. Ids and sizes travel in as few bytes as the largest takes. The number of tasks follows the meetings, so that what one of them
    holds does not grow with the table.
    """
    counts = answering.groupBy(via).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0
    kind, numbered = answering.schema["other"].dataType.simpleString(), isinstance(answering.schema["other"].dataType, IntegralType)
    span = F.max(F.greatest("other", -F.col("other") - 1)) if numbered else F.lit(None)
    last, rows = answering.groupBy("other").agg(F.count(F.lit(1)).alias("_n")).agg(span, F.max("_n")).first()
    narrow = {"other": "int" if last is not None and last < 2**31 else kind, "other_size": "smallint" if (rows or 0) < 2**15 else "int"}
    dealt = answering.join(counts, via).withColumn("_block", F.pmod(F.xxhash64("other"), F.ceil(F.col("_n") / BLOCK)))
    blocks = dealt.groupBy(via, "_block").agg(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in narrow.items()], *["day"] * dated)).alias("_met"))
    keys = ["who", "size", *["as_of"] * dated]
    met = F.filter("_met", lambda x: x["day"] < F.col("as_of")) if dated else F.col("_met")
    met = F.filter(met, lambda x: x["other"] >= F.col("who")) if once else met
    sent = asking.join(blocks, via).select(*keys, met.alias("_met")).select(*keys, F.col("_met")["other"].alias("other"), F.col("_met")["other_size"].alias("other_size"))
    sent = sent.where(F.size("other") > 0).repartition(1 + total // MEETINGS_A_TASK, "who")
    pairs = sent.select(*keys, F.inline(F.arrays_zip("other", "other_size"))).withColumns({"other": F.col("other").cast(kind), "other_size": F.col("other_size").cast("int")})
    return pairs.where(F.lit(itself) | (F.col("who") != F.col("other"))).groupBy(*keys, "other").agg(F.count(F.lit(1)).alias("both"), F.max("other_size").alias("other_size"))


def likely(met: DataFrame, least: float, candidates: int | None) -> DataFrame:
    """The `candidates` others of each client with the largest overlap, or all if None, without those whose similarity is surely under
    `least`.

    The first filter leaves ranks as they are, since a smaller overlap comes later; other_size may be less than it is."""
    met = met.withColumnRenamed("who", "client_id").where(F.col("both") / F.col("size") >= least)
    if candidates is not None:
        met = first_per(met, ["client_id"], [F.desc("both"), F.col("other")], candidates).drop("rank")
    return met.where(jaccard() >= least)


def jaccard() -> Column:
    return F.col("both") / (F.col("size") + F.col("other_size") - F.col("both"))


def discovery_at(sales: DataFrame, cases: DataFrame, item: str, least: float = 0.05, most: int | None = 100, candidates: int | None = 400, clients: int = 2) -> DataFrame:
    """(client_id, item, score): items the client lacks at the case's cut-off, of at least `clients` clients who are similar
    then, by mean similarity. A client's first purchase of an item carries its day, so that all cut-offs share one table. Without
    `candidates` and `most` every client of at least the similarity `least` counts.

    With each item travels how many items its client had by that day, which bounds the size at any later cut-off from below; the
    few who can be similar have their sizes counted."""
    first = checkpointed(sales.groupBy("client_id", item).agg(F.min("created").alias("day")))
    own = first.join(cases.select("client_id", "as_of"), "client_id").where("day < as_of").select("client_id", "as_of", item)
    theirs = first.select(F.col("client_id").alias("other"), item, "day")
    asking = own.select(F.col("client_id").alias("who"), "as_of", item, F.count(F.lit(1)).over(Window.partitionBy("client_id")).cast("int").alias("size"))
    answering = theirs.withColumn("other_size", F.count(F.lit(1)).over(Window.partitionBy("other").orderBy("day")).cast("int"))
    near = likely(meetings(asking, answering, item, dated=True), least, candidates).drop("other_size")
    sized = near.join(theirs.select("other", "day"), "other").where("day < as_of").groupBy("client_id", "as_of", "other", "both", "size").agg(F.count(F.lit(1)).alias("other_size"))
    near = nearest(sized.withColumn("jaccard", jaccard()), least, most, ["as_of"])
    scored = near.join(theirs, "other").where("day < as_of").groupBy("client_id", item).agg(F.round(F.avg("jaccard"), 9).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= clients)
    return scored.join(own, ["client_id", item], "left_anti").select("client_id", item, "score")


def quota_lists(own: DataFrame, found: DataFrame, groups: DataFrame, item: str, top: int = TOP, repurchase: int = REPURCHASE, per_group: int = PER_GROUP) -> DataFrame:
    """(client_id, item, source, rank): at most `repurchase` items bought before, then discoveries up to top, each list with
    at most per_group items of a group. Lists reach a fixed number beyond their quota before groups are limited."""
    parts = []
    for name, df, quota, spare in (("repurchase", own, min(repurchase, top), SPARE_REPURCHASE), ("discovery", found, max(top - repurchase, 0), SPARE_DISCOVERY)):
        ranked = diverse(first_per(df, ["client_id"], [F.desc("score"), F.col(item)], quota + spare), groups, item, per_group)
        parts.append(first_per(ranked.drop("rank"), ["client_id"], [F.desc("score"), F.col(item)], quota).select("client_id", item, F.lit(name).alias("source"), F.col("rank").alias("_r")))
    both = parts[0].unionByName(parts[1])
    order = Window.partitionBy("client_id").orderBy((F.col("source") == "discovery").cast("int"), "_r")
    return both.withColumn("rank", F.row_number().over(order)).drop("_r")


def backfilled(lists: DataFrame, clients: DataFrame, co: DataFrame, sales: DataFrame, item: str, top: int = TOP) -> DataFrame:
    """(client_id, item, source, rank) of every client: its list, then co-purchased items by score, then the items of most sale
    lines, until top items are reached. Nothing comes twice; ties go to the smaller item.

    A list has at most top items, so 2 * top co-purchased and as many popular ones always suffice; the popular ones are one
    short array, the same for all clients.
    """
    ranked = sales.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), item).limit(2 * top)
    kind = f"array<{sales.schema[item].dataType.simpleString()}>"
    popular = F.array(*[F.lit(r[item]) for r in ranked.collect()]).cast(kind)
    in_order = lambda df: df.groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct("rank", item)))[item].alias("_items"))
    have, more = in_order(lists), in_order(first_per(co, ["client_id"], [F.desc("score"), F.col(item)], 2 * top)).withColumnRenamed("_items", "_more")
    df = clients.select("client_id").distinct().join(have, "client_id", "left").join(more, "client_id", "left")
    none = F.array().cast(kind)
    df = df.withColumns({"_items": F.coalesce("_items", none), "_more": F.coalesce("_more", none)})
    size = F.size("_items")
    fill = F.slice(F.array_except(F.concat("_more", popular), F.col("_items")), 1, F.greatest(F.lit(top) - size, F.lit(0)))
    new = df.select("client_id", size.alias("_n"), F.posexplode(fill).alias("_at", item))
    return lists.select("client_id", item, "source", "rank").unionByName(new.select("client_id", item, F.lit("discovery").alias("source"), (F.col("_n") + F.col("_at") + 1).alias("rank")))


def evaluate_by_segment(recs: DataFrame, truth: DataFrame, segment: DataFrame, item: str, k: int) -> DataFrame:
    """The metrics of `evaluate` by segment and, under `ALL`, over all cases."""
    cases = truth.groupBy("client_id").agg(F.count(F.lit(1)).alias("size")).join(segment.select("client_id", "segment"), "client_id", "left")
    hits = recs.where(F.col("rank") <= k).join(truth, ["client_id", item]).groupBy("client_id").agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"))
    df = cases.join(hits, "client_id", "left").withColumns({"h": F.coalesce("h", F.lit(0)), "segment": F.coalesce("segment", F.lit("LIGHT"))})
    agg = df.rollup("segment").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("h") > 0).cast("double")).alias("hit_rate"), F.avg(F.col("h") / k).alias("precision"), F.avg(F.col("h") / F.col("size")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
    return agg.withColumn("segment", F.coalesce("segment", F.lit("ALL")))


def repurchase_scores(sales: DataFrame, item: str, segment: DataFrame, as_of: str, half_life: float = 21.0) -> DataFrame:
    """Frequency and exponential recency, each divided by the client's best, weighed by segment."""
    per = sales.groupBy("client_id", item).agg(F.countDistinct("order_id").cast("double").alias("f"), F.exp(-F.datediff(F.lit(as_of).cast("date"), F.max("created")) / half_life).alias("r"))
    w = Window.partitionBy("client_id")
    freq, rec = F.col("f") / F.max("f").over(w), F.col("r") / F.max("r").over(w)
    wf = frequency_weight(F.col("segment"))
    scored = per.withColumns({"freq": freq, "rec": rec}).join(segment, "client_id")
    return scored.select("client_id", item, (wf * F.col("freq") + (1 - wf) * F.col("rec")).alias("score"))


def newest_pairs(lines: DataFrame, item: str, most: int = RECENT_LINES) -> DataFrame:
    """(client_id, item), each once, of every client's `most` newest lines; of one day the larger order, then the smaller item, counts as
    newer."""
    newest = first_per(lines.select("client_id", item, "order_id", "created"), ["client_id"], [F.desc("created"), F.desc("order_id"), F.col(item)], most)
    return owned(newest, item)


def nearest(compared: DataFrame, least: float, most: int | None, more: list[str] | None = None) -> DataFrame:
    """(client_id, other, jaccard) and the columns `more` of the `most` most alike, or of all if None, with at least `least`."""
    alike_ = compared.where(F.col("jaccard") >= least)
    if most is not None:
        alike_ = first_per(alike_, ["client_id"], [F.desc("jaccard"), F.col("other")], most)
    return alike_.select("client_id", "other", "jaccard", *(more or []))


def similar_clients(pairs: DataFrame, item: str, least: float = 0.05, most: int = 100, candidates: int = 400, newest: DataFrame | None = None) -> DataFrame:
    """(client_id, other, jaccard) of the clients with the largest overlap. Common items should be left out before.

    newest, if given, holds the pairs by which a client asks, such as those of its latest lines; the others answer with all of
    theirs, so that the similarity need not be the same both ways.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("client_id")).cast("int")
    asking = (pairs if newest is None else newest).select(F.col("client_id").alias("who"), item, size.alias("size"))
    answering = pairs.select(F.col("client_id").alias("other"), item, size.alias("other_size"))
    return nearest(likely(meetings(asking, answering, item), least, candidates).withColumn("jaccard", jaccard()), least, most)


def similar_clients_by_minhash(pairs: DataFrame, item: str, least: float = 0.05, most: int = 100, candidates: int = 400, recall: float = 0.96) -> DataFrame:
    """`similar_clients` among the pairs that share enough items of smallest hash: a pair at `least` is found with probability `recall`,
    a more similar one with a higher, and its similarity is exact. Each pair is counted once, by few items of large clients, and
    frequent items are hashed again."""
    found = checkpointed(alike(pairs, "client_id", item, least, recall))
    both_ways = found.unionByName(found.select(F.col("other").alias("client_id"), F.col("client_id").alias("other"), "both", "jaccard"))
    return nearest(first_per(both_ways, ["client_id"], [F.desc("both"), F.col("other")], candidates).drop("rank"), least, most)


def neighbour_items(similar: DataFrame, pairs: DataFrame, item: str, least: int = 2) -> DataFrame:
    """Items of at least `least` similar clients that the client lacks, by mean similarity."""
    theirs = similar.join(pairs.select(F.col("client_id").alias("other"), item), "other")
    scored = theirs.groupBy("client_id", item).agg(F.avg("jaccard").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return scored.join(pairs, ["client_id", item], "left_anti").select("client_id", item, "score")


def together(pairs: DataFrame, item: str, by: list[str] | None = None, most: int = BLOCK, since: str | None = None) -> DataFrame:
    """(by, seed, cand, co): for every two items, also an item with itself, the clients that have both. pairs has each (by, client_id, item) once.

    A basket meets itself in blocks: one of n items is dealt to n / most blocks by item, and each two of its blocks are a key of
    their own. So no key makes more than about most ** 2 pairs, however large a basket is, and small ones are not copied.

    With `since`, a column that tells from when on a client has an item, counts are also by when it first has both.
    """
    by, dated = by or [], [since] if since else []
    sizes = pairs.groupBy(*by, "client_id").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n"))
    dealt = pairs.join(sizes, [*by, "client_id"]).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = dealt.select(*by, "client_id", F.col(item).alias("seed"), F.col("_own").alias("_a"), every.alias("_b"), *[F.col(x).alias("_s") for x in dated])
    b = dealt.select(*by, "client_id", F.col(item).alias("cand"), every.alias("_a"), F.col("_own").alias("_b"), *[F.col(x).alias("_t") for x in dated])
    return a.join(b, [*by, "client_id", "_a", "_b"]).groupBy(*by, "seed", "cand", *[F.greatest("_s", "_t").alias(x) for x in dated]).agg(F.count(F.lit(1)).alias("co"))


def co_purchase(pairs: DataFrame, item: str, least: int = 2, itself: bool = False) -> DataFrame:
    """(seed, cand, co, sim): clients in common over the root of both degrees, for pairs with at least `least` in common; with
    `itself` also each item with itself, at similarity 1.

    Few items, such as groups, are counted before the shuffle; many, of which most pairs meet once or never, by `meetings`."""
    root = lambda x, y: F.sqrt(F.col(x) * F.col(y))
    if few(pairs, item):
        degree = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("deg"))
        co = together(pairs, item).where((F.col("co") >= least) & (F.lit(itself) | (F.col("seed") != F.col("cand"))))
        d1, d2 = degree.select(F.col(item).alias("seed"), F.col("deg").alias("d1")), degree.select(F.col(item).alias("cand"), F.col("deg").alias("d2"))
        return co.join(d1, "seed").join(d2, "cand").select("seed", "cand", "co", (F.col("co") / root("d1", "d2")).alias("sim"))
    degree = F.count(F.lit(1)).over(Window.partitionBy(item))
    asking, answering = pairs.select(F.col(item).alias("who"), "client_id", degree.alias("size")), pairs.select(F.col(item).alias("other"), "client_id", degree.alias("other_size"))
    met = checkpointed(meetings(asking, answering, "client_id", itself=itself, once=True).where(F.col("both") >= least))
    turned = met.where("who <> other").select(F.col("other").alias("who"), F.col("other_size").alias("size"), F.col("who").alias("other"), "both", F.col("size").alias("other_size"))
    return met.unionByName(turned).select(F.col("who").alias("seed"), F.col("other").alias("cand"), F.col("both").alias("co"), (F.col("both") / root("size", "other_size")).alias("sim"))


def few(pairs: DataFrame, item: str) -> bool:
    """Whether two items meet so often that their pairs are fewer than the pairs that are met."""
    n, items = pairs.agg(F.count(F.lit(1)), F.approx_count_distinct(item)).first()
    return items * items <= n


def co_scores(pairs: DataFrame, similar: DataFrame, item: str) -> DataFrame:
    """Summed similarity of each candidate to the client's own items. Unless items are few, the candidates of a seed travel to the
    client as arrays of about BLOCK, and are summed where it is; the number of tasks follows them."""
    own = pairs.select("client_id", F.col(item).alias("seed"))
    if few(pairs, item):
        return own.join(similar, "seed").groupBy("client_id", F.col("cand").alias(item)).agg(F.sum("sim").alias("score"))
    similar = checkpointed(similar.select("seed", "cand", "sim"))
    counts = similar.groupBy("seed").agg(F.count(F.lit(1)).alias("_n"))
    total = own.join(counts, "seed").agg(F.sum("_n")).first()[0] or 0
    dealt = similar.join(counts, "seed").withColumn("_block", F.pmod(F.xxhash64("cand"), F.ceil(F.col("_n") / BLOCK)))
    blocks = dealt.groupBy("seed", "_block").agg(F.collect_list(F.struct("cand", "sim")).alias("_x"))
    sent = own.join(blocks, "seed").select("client_id", F.col("_x")["cand"].alias("cand"), F.col("_x")["sim"].alias("sim")).repartition(1 + total // MEETINGS_A_TASK, "client_id")
    return sent.select("client_id", F.inline(F.arrays_zip("cand", "sim"))).groupBy("client_id", F.col("cand").alias(item)).agg(F.sum("sim").alias("score"))


def lacking_scores(own: DataFrame, similar: DataFrame, item: str, by: list[str]) -> DataFrame:
    """(by, client_id, item, score): the summed similarity of each item that a client lacks to those it has. own has each (by, client_id,
    item) once, similar (by, seed, cand, sim) of few items, such as groups.

    The similarities go to all tasks as a row of places for each candidate, and a client is one row of the places of its own items;
    so nothing is made, sent or ruled out again for items it has.
    """
    similar = checkpointed(similar.select(*by, "seed", "cand", "sim"))
    names = similar.select(*by, F.col("seed").alias(item)).union(similar.select(*by, "cand")).distinct()
    places = checkpointed(names.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(item))))  # few rows
    sizes = places.groupBy(*by).agg(F.max("_at").alias("_n"))
    to = similar.join(places.withColumnRenamed(item, "seed"), [*by, "seed"]).groupBy(*by, "cand").agg(F.map_from_entries(F.collect_list(F.struct("_at", "sim"))).alias("_m"))
    to = to.join(sizes, by).join(places.withColumnRenamed(item, "cand"), [*by, "cand"])
    sims = F.transform(F.sequence(F.lit(1), "_n"), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    table = to.groupBy(*by).agg(F.collect_list(F.struct(F.col("cand").alias(item), "_at", sims.alias("sims"))).alias("_items"))
    held = own.join(F.broadcast(places), [*by, item]).groupBy(*by, "client_id").agg(F.array_sort(F.collect_list("_at")).alias("_own"))
    lacking = F.filter("_items", lambda x: ~F.array_contains("_own", x["_at"]))
    scored = F.transform(lacking, lambda x: F.struct(x[item].alias(item), F.aggregate("_own", F.lit(0.0), lambda a, i: a + x["sims"][i - 1]).alias("score")))
    return held.join(F.broadcast(table), by).select(*by, "client_id", F.inline(F.filter(scored, lambda x: x["score"] > 0)))


def blend(own: DataFrame, co: DataFrame, item: str, top: int = TOP) -> DataFrame:
    """0.6 own and 0.4 co-purchase, each divided by the client's best, ranked before the score is rounded for show; the source
    tells whether the client has the item. Scores equal to 9 places are ties, which go to the smaller item."""
    w = Window.partitionBy("client_id")
    o = own.withColumn("o", F.col("score") / F.max("score").over(w)).drop("score")
    c = co.withColumn("c", F.col("score") / F.max("score").over(w)).drop("score")
    both = o.join(c, ["client_id", item], "full_outer")
    score = OWN_SHARE * F.coalesce("o", F.lit(0.0)) + (1 - OWN_SHARE) * F.coalesce("c", F.lit(0.0))
    both = both.select("client_id", item, F.round(score, 9).alias("score"), F.when(F.col("o").isNotNull(), "repurchase").otherwise("discovery").alias("source"))
    return first_per(both, ["client_id"], [F.desc("score"), F.col(item)], top).withColumn("score", F.round(F.col("score") + 1e-9, 4))


def tiered(tiers: list[DataFrame], item: str, top: int) -> DataFrame:
    """Merges (client_id, item, score) tables in falling order of preference; an item keeps its best tier; first top per client."""
    merged = None
    for i, t in enumerate(tiers):
        t = t.select("client_id", item, "score").withColumn("tier", F.lit(i))
        merged = t if merged is None else merged.unionByName(t)
    best = merged.groupBy("client_id", item).agg(F.min_by("score", "tier").alias("score"), F.min("tier").alias("tier"))
    return first_per(best, ["client_id"], [F.col("tier"), F.desc("score"), F.col(item)], top)


def diverse(ranked: DataFrame, groups: DataFrame, item: str, most: int) -> DataFrame:
    """At most `most` items of a group per client in rank order; items without a group are not limited."""
    w = Window.partitionBy("client_id", "grp").orderBy("rank")
    return ranked.join(groups.withColumnRenamed("group_id", "grp"), item, "left").withColumn("_k", F.row_number().over(w)).where(F.col("grp").isNull() | (F.col("_k") <= most)).drop("_k")


def evaluate(recs: DataFrame, truth: DataFrame, item: str, k: int) -> DataFrame:
    """n, hit rate, precision, recall and MRR at k over the clients in truth; recs need (client_id, item, rank)."""
    cases = truth.groupBy("client_id").agg(F.count(F.lit(1)).alias("size"))
    hits = recs.where(F.col("rank") <= k).join(truth, ["client_id", item]).groupBy("client_id").agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"))
    df = cases.join(hits, "client_id", "left")
    h = F.coalesce("h", F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((h > 0).cast("double")).alias("hit_rate"), F.avg(h / k).alias("precision"), F.avg(h / F.col("size")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
