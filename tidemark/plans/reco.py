"""Recommendation queries. Groups (25 brands) stand in for items where products repeat too rarely."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import factors, ranking, reco, sales
from tidemark.plans.base import Plans
from tidemark.plans.sales import END, past, valid
from tidemark.sources import canonical as c
from tidemark.sources.sinks import checkpointed

P = Plans()
T = {
    "common": "SELECT product_id FROM past_sales GROUP BY 1 HAVING count(DISTINCT client_id) > 0.20 * (SELECT count(DISTINCT client_id) FROM past_sales)",
    "pairs": "SELECT DISTINCT client_id, product_id FROM past_sales WHERE product_id NOT IN (SELECT product_id FROM common)",
    "deg": "SELECT product_id, count(*) AS deg FROM pairs GROUP BY 1",
    "co": "SELECT a.product_id AS seed, b.product_id AS cand, count(*) AS co FROM pairs a JOIN pairs b ON a.client_id = b.client_id AND a.product_id <> b.product_id GROUP BY 1, 2 HAVING count(*) >= 2",
    "sim": "SELECT seed, cand, co, co / sqrt(CAST(x.deg AS DOUBLE) * y.deg) AS sim FROM co JOIN deg x ON x.product_id = seed JOIN deg y ON y.product_id = cand",
    "sizes": "SELECT client_id, count(*) AS size FROM pairs GROUP BY 1",
    "newest": "SELECT DISTINCT client_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY created DESC, order_id DESC, product_id) AS r FROM past_sales) WHERE r <= 500 AND product_id NOT IN (SELECT product_id FROM common)",
    "asking": "SELECT client_id, count(*) AS size FROM newest GROUP BY 1",
    "over": "SELECT a.client_id, b.client_id AS other, count(*) AS shared FROM newest a JOIN pairs b ON a.product_id = b.product_id AND a.client_id <> b.client_id GROUP BY 1, 2",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY shared DESC, other) AS r FROM over) WHERE r <= 400",
    "jac": "SELECT t.client_id, other, shared / (x.size + y.size - shared) AS jaccard FROM top t JOIN asking x ON x.client_id = t.client_id JOIN sizes y ON y.client_id = other",
    "alike": "SELECT client_id, other, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY jaccard DESC, other) AS r2 FROM jac WHERE jaccard >= 0.05::DOUBLE) WHERE r2 <= 100",
    "per": "SELECT client_id, group_id, CAST(count(DISTINCT order_id) AS DOUBLE) AS f, exp(-date_diff('day', max(created), DATE '2000-01-01') / 21.0::DOUBLE) AS r FROM past_sales GROUP BY 1, 2",
    "own": "SELECT client_id, group_id, 0.30::DOUBLE * f / max(f) OVER (PARTITION BY client_id) + 0.70::DOUBLE * r / max(r) OVER (PARTITION BY client_id) AS score FROM per",
}


def plain(spark, d):
    """Past sales without the products that over a fifth of the clients buy; they tell no two clients apart."""
    lines = past(spark, d)
    return lines.join(sales.ubiquitous_products(lines, reco.UBIQUITOUS), "product_id", "left_anti")


def bought(spark, d):
    """Past sales by client, product, order and day, and the common products of `plain`; both written once, since all that follows
    reads them several times."""
    lines = checkpointed(past(spark, d).select("client_id", "product_id", "order_id", "created"))
    return lines, checkpointed(sales.ubiquitous_products(lines, reco.UBIQUITOUS))


def pairs(spark, d):
    """(client_id, product_id) of past sales, written once since every use reads it several times."""
    lines, common = bought(spark, d)
    return checkpointed(reco.owned(lines.join(common, "product_id", "left_anti"), "product_id"))


def asked(spark, d):
    """`pairs`, and those of each client's newest lines; by these a client looks for similar ones."""
    lines, common = bought(spark, d)
    own = checkpointed(reco.owned(lines.join(common, "product_id", "left_anti"), "product_id"))
    return own, checkpointed(reco.newest_pairs(lines, "product_id").join(common, "product_id", "left_anti"))


@P.add(
    "c1_client_segments",
    """SELECT o.client_id, n_orders, CASE WHEN n_orders >= 500 THEN 'HEAVY' WHEN n_orders >= 100 AND rate >= 0.40::DOUBLE THEN 'REGULAR_CONSISTENT' WHEN n_orders >= 100 THEN 'REGULAR_EXPLORATORY' ELSE 'LIGHT' END AS segment FROM (SELECT client_id, count(DISTINCT order_id) AS n_orders FROM past_sales GROUP BY 1) o
    JOIN (SELECT client_id, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE) AS rate FROM (SELECT client_id, group_id, count(DISTINCT order_id) AS n FROM past_sales GROUP BY 1, 2) GROUP BY 1) r ON r.client_id = o.client_id""",
)
def c1(spark, d):
    return reco.segments(past(spark, d), "group_id")


@P.add("c2_repurchase_scores", "SELECT client_id, group_id, round(score, 6) AS score FROM own", **T)
def c2(spark, d):
    lines = past(spark, d)
    return reco.repurchase_scores(lines, "group_id", reco.segments(lines, "group_id"), END).withColumn("score", F.round("score", 6))


@P.add("j8_c5_co_purchase", "SELECT seed, cand, co, round(sim, 6) AS sim FROM sim", **T)
def c5(spark, d):
    return reco.co_purchase(pairs(spark, d), "product_id").withColumn("sim", F.round("sim", 6))


@P.add("j9_c3_similar_clients", "SELECT client_id, other, round(jaccard, 6) AS jaccard FROM alike", **T)
def c3(spark, d):
    own, newest = asked(spark, d)
    return reco.similar_clients(own, "product_id", newest=newest).withColumn("jaccard", F.round("jaccard", 6))


@P.add("c3_minhash_similar_clients")
def c3_minhash(spark, d):
    """Similar clients among those that share enough items of smallest hash; all pairs of a client count."""
    return reco.similar_clients_by_minhash(pairs(spark, d), "product_id").withColumn("jaccard", F.round("jaccard", 6))


@P.add("c3_minhash_recall", "SELECT count(*) AS n_exact, TRUE AS nine_in_ten FROM alike", **T)
def c3_recall(spark, d):
    """How many of the exact similar pairs there are, and whether the minimum hashes find at least nine in ten of them."""
    own, newest = asked(spark, d)
    exact = reco.similar_clients(own, "product_id", newest=newest).select("client_id", "other")
    found = reco.similar_clients_by_minhash(own, "product_id").select("client_id", "other", F.lit(1).alias("found"))
    both = exact.join(found, ["client_id", "other"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("found").alias("n_found"))
    return both.select("n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("nine_in_ten"))


@P.add("c4_neighbour_items", "SELECT s.client_id, p.product_id, round(avg(jaccard), 6) AS score FROM alike s JOIN pairs p ON p.client_id = s.other WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.client_id = s.client_id AND q.product_id = p.product_id) GROUP BY 1, 2 HAVING count(*) >= 2", **T)
def c4(spark, d):
    own, newest = asked(spark, d)
    return reco.neighbour_items(reco.similar_clients(own, "product_id", newest=newest), own, "product_id").withColumn("score", F.round("score", 6))


def hybrid(spark, d, top=reco.TOP):
    """Order frequency of the client's own products, blended with co-purchase; an item of two buyers is like itself."""
    lines = checkpointed(plain(spark, d).select("client_id", "product_id", "order_id"))
    often = lines.groupBy("client_id", "product_id").agg(F.countDistinct("order_id").alias("score"))
    own = reco.owned(lines, "product_id")
    return reco.blend(often, reco.co_scores(own, reco.co_purchase(own, "product_id", itself=True), "product_id"), "product_id", top)


BLEND = {
    "often": "SELECT client_id, product_id, f / max(f) OVER (PARTITION BY client_id) AS o FROM (SELECT client_id, product_id, CAST(count(DISTINCT order_id) AS DOUBLE) AS f FROM past_sales WHERE product_id NOT IN (SELECT product_id FROM common) GROUP BY 1, 2)",
    "bought": "SELECT seed, cand, co / sqrt(CAST(x.deg AS DOUBLE) * y.deg) AS sim FROM (SELECT a.product_id AS seed, b.product_id AS cand, count(*) AS co FROM pairs a JOIN pairs b ON a.client_id = b.client_id GROUP BY 1, 2 HAVING count(*) >= 2) JOIN deg x ON x.product_id = seed JOIN deg y ON y.product_id = cand",
    "besides": "SELECT client_id, product_id, s / max(s) OVER (PARTITION BY client_id) AS c FROM (SELECT p.client_id, cand AS product_id, sum(sim) AS s FROM pairs p JOIN bought ON seed = p.product_id GROUP BY 1, 2)",
    "blended": "SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY score DESC, product_id) AS r FROM (SELECT coalesce(a.client_id, b.client_id) AS client_id, coalesce(a.product_id, b.product_id) AS product_id, round(0.6::DOUBLE * coalesce(o, 0) + 0.4::DOUBLE * coalesce(c, 0), 9) AS score, CASE WHEN o IS NULL THEN 'discovery' ELSE 'repurchase' END AS source FROM often a FULL JOIN besides b ON a.client_id = b.client_id AND a.product_id = b.product_id)",
}


@P.add("c6_blend", "SELECT client_id, product_id, round(score + 0.000000001::DOUBLE, 4) AS score, source, CAST(r AS INTEGER) AS rank FROM blended WHERE r <= 25", **T, **BLEND)
def c6(spark, d):
    return hybrid(spark, d)


@P.add("c6_cross_sell", "SELECT client_id, product_id, round(score + 0.000000001::DOUBLE, 4) AS score, CAST(row_number() OVER (PARTITION BY client_id ORDER BY r) AS INTEGER) AS rank FROM blended WHERE source = 'discovery' QUALIFY rank <= 5", **T, **BLEND)
def c6_new(spark, d):
    """The blend's discoveries alone: what a client does not have yet."""
    lines = checkpointed(plain(spark, d).select("client_id", "product_id", "order_id"))
    own = checkpointed(reco.owned(lines, "product_id"))
    scores = reco.co_scores(own, reco.co_purchase(own, "product_id", itself=True), "product_id")
    best = scores.groupBy("client_id").agg(F.max("score").alias("best"))
    new = scores.join(own, ["client_id", "product_id"], "left_anti").join(best, "client_id")
    share = F.round((1 - reco.OWN_SHARE) * F.col("score") / F.col("best"), 9)
    ranked = ranking.first_per(new.select("client_id", "product_id", share.alias("score")), ["client_id"], [F.desc("score"), F.col("product_id")], 5)
    return ranked.withColumn("score", F.round(F.col("score") + 1e-9, 4))


@P.add(
    "w4_group_diversity",
    "SELECT client_id, product_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY client_id, p_brand ORDER BY rank) AS k FROM (SELECT client_id, product_id, row_number() OVER (PARTITION BY client_id ORDER BY sum(amount) DESC, product_id) AS rank FROM past_sales GROUP BY 1, 2) JOIN part ON p_partkey = product_id) WHERE k <= 3",
)
def w4(spark, d):
    """Whole lists, at most three of a group."""
    order = Window.partitionBy("client_id").orderBy(F.desc("v"), "product_id")
    ranked = past(spark, d).groupBy("client_id", "product_id").agg(F.sum("amount").alias("v")).withColumn("rank", F.row_number().over(order))
    return reco.diverse(ranked, groups(spark, d), "product_id", reco.PER_GROUP).select("client_id", "product_id", "rank")


def groups(spark, d):
    return c.read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("group_id"))


@P.add(
    "u4_c7_tiered_hybrid",
    """SELECT client_id, product_id, score, CAST(tier AS INTEGER) AS tier, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY tier, score DESC, product_id) AS r FROM (SELECT client_id, product_id, min_by(score, tier) AS score, min(tier) AS tier FROM
    (SELECT client_id, product_id, round(0.30::DOUBLE * f / max(f) OVER (PARTITION BY client_id) + 0.70::DOUBLE * r / max(r) OVER (PARTITION BY client_id), 6) AS score, 0 AS tier FROM (SELECT client_id, product_id, CAST(count(DISTINCT order_id) AS DOUBLE) AS f, exp(-date_diff('day', max(created), DATE '2000-01-01') / 21.0::DOUBLE) AS r FROM past_sales GROUP BY 1, 2)
     UNION ALL SELECT s.client_id, p.product_id, round(avg(jaccard), 6), 1 FROM alike s JOIN pairs p ON p.client_id = s.other WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.client_id = s.client_id AND q.product_id = p.product_id) GROUP BY 1, 2 HAVING count(*) >= 2
     UNION ALL SELECT p.client_id, cand, round(sum(sim), 6), 2 FROM pairs p JOIN sim ON seed = p.product_id WHERE co >= 3 AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.client_id = p.client_id AND q.product_id = cand) GROUP BY 1, 2) GROUP BY 1, 2)) WHERE r <= 25""",
    **T,
)
def c7(spark, d):
    """No client here has the hundred orders of a regular one, so the SQL weighs frequency by 0.30."""
    own, newest = asked(spark, d)
    lines = past(spark, d)
    first = reco.repurchase_scores(lines, "product_id", reco.segments(lines, "product_id"), END)
    second = reco.neighbour_items(reco.similar_clients(own, "product_id", newest=newest), own, "product_id")
    third = reco.co_scores(own, reco.co_purchase(own, "product_id", 3), "product_id").join(own, ["client_id", "product_id"], "left_anti")
    return reco.tiered([t.withColumn("score", F.round("score", 6)) for t in (first, second, third)], "product_id", 25)


#: Cases, histories and lists at each client's own cut-off, in SQL.
CASES = {
    **T,
    "goods": "SELECT * FROM past_sales WHERE product_id NOT IN (SELECT product_id FROM common)",
    "cases": "SELECT client_id, m[1] AS as_of, m[2] AS last_order FROM (SELECT client_id, max((created, order_id)) AS m FROM goods GROUP BY 1 HAVING count(DISTINCT order_id) >= 2)",
    "hist": "SELECT g.*, as_of FROM goods g JOIN cases k ON k.client_id = g.client_id WHERE created < as_of",
    "seg": """SELECT o.client_id, CASE WHEN n >= 500 THEN 'HEAVY' WHEN n >= 100 AND rate >= 0.40::DOUBLE THEN 'REGULAR_CONSISTENT' WHEN n >= 100 THEN 'REGULAR_EXPLORATORY' ELSE 'LIGHT' END AS segment FROM (SELECT client_id, count(DISTINCT order_id) AS n FROM hist GROUP BY 1) o JOIN
      (SELECT client_id, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE) AS rate FROM (SELECT client_id, product_id, count(DISTINCT order_id) AS n FROM hist GROUP BY 1, 2) GROUP BY 1) r ON r.client_id = o.client_id""",
    "rebuy": """SELECT p.client_id, product_id, round(w * f / max(f) OVER (PARTITION BY p.client_id) + (1 - w) * r / max(r) OVER (PARTITION BY p.client_id), 9) AS score FROM (SELECT client_id, product_id, CAST(count(DISTINCT order_id) AS DOUBLE) AS f, exp(-date_diff('day', max(created), max(as_of)) / 21.0::DOUBLE) AS r FROM hist GROUP BY 1, 2) p
      JOIN (SELECT client_id, CASE WHEN segment IN ('HEAVY', 'REGULAR_CONSISTENT') THEN 0.40 ELSE 0.30 END::DOUBLE AS w FROM seg) s ON s.client_id = p.client_id""",
    "firsts": "SELECT client_id, product_id, min(created) AS day FROM goods GROUP BY 1, 2",
    "mine": "SELECT f.client_id, as_of, product_id FROM firsts f JOIN cases k ON k.client_id = f.client_id WHERE day < as_of",
    "meet": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY shared DESC, other) AS r FROM (SELECT m.client_id, m.as_of, t.client_id AS other, count(*) AS shared FROM mine m JOIN firsts t ON t.product_id = m.product_id AND t.client_id <> m.client_id AND t.day < m.as_of GROUP BY 1, 2, 3)) WHERE r <= 400",
    "fulls": "SELECT m.client_id, other, shared, product_id FROM meet m JOIN firsts t ON t.client_id = m.other AND t.day < m.as_of",
    "nears": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY jaccard DESC, other) AS r FROM (SELECT f.client_id, other, shared / (any_value(size) + count(*) - shared) AS jaccard FROM fulls f JOIN (SELECT client_id, count(*) AS size FROM mine GROUP BY 1) z ON z.client_id = f.client_id GROUP BY f.client_id, other, shared) WHERE jaccard >= 0.05::DOUBLE) WHERE r <= 100""",
    "finds": "SELECT f.client_id, product_id, round(avg(jaccard), 9) AS score FROM fulls f JOIN nears n ON n.client_id = f.client_id AND n.other = f.other WHERE NOT EXISTS (SELECT 1 FROM mine m WHERE m.client_id = f.client_id AND m.product_id = f.product_id) GROUP BY 1, 2 HAVING count(*) >= 2",
    "lists": """SELECT client_id, product_id, source, row_number() OVER (PARTITION BY client_id ORDER BY source = 'discovery', r) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY client_id, source ORDER BY score DESC, product_id) AS r FROM
      (SELECT l.*, row_number() OVER (PARTITION BY client_id, source, p_brand ORDER BY score DESC, product_id) AS g FROM (SELECT client_id, product_id, score, 'repurchase' AS source, row_number() OVER (PARTITION BY client_id ORDER BY score DESC, product_id) AS q FROM rebuy UNION ALL
        SELECT client_id, product_id, score, 'discovery', row_number() OVER (PARTITION BY client_id ORDER BY score DESC, product_id) FROM finds) l JOIN part ON p_partkey = product_id WHERE q <= CASE source WHEN 'repurchase' THEN 30 ELSE 10 END) WHERE g <= 3) WHERE r <= CASE source WHEN 'repurchase' THEN 20 ELSE 5 END""",
    "goal": "SELECT DISTINCT k.client_id, product_id FROM cases k JOIN goods g ON g.client_id = k.client_id AND g.order_id = k.last_order",
}


#: The same lists for all clients at the as-of day, filled up to 25.
TODAY = {
    **T,
    "goods": CASES["goods"],
    "rebuy": "SELECT client_id, product_id, round(0.30::DOUBLE * f / max(f) OVER (PARTITION BY client_id) + 0.70::DOUBLE * r / max(r) OVER (PARTITION BY client_id), 9) AS score FROM (SELECT client_id, product_id, CAST(count(DISTINCT order_id) AS DOUBLE) AS f, exp(-date_diff('day', max(created), DATE '2000-01-01') / 21.0::DOUBLE) AS r FROM goods GROUP BY 1, 2)",
    "finds": "SELECT s.client_id, p.product_id, round(avg(jaccard), 9) AS score FROM alike s JOIN pairs p ON p.client_id = s.other WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.client_id = s.client_id AND q.product_id = p.product_id) GROUP BY 1, 2 HAVING count(*) >= 2",
    "lists": CASES["lists"],
    "beside": "SELECT client_id, product_id, row_number() OVER (PARTITION BY client_id ORDER BY score DESC, product_id) AS r FROM (SELECT p.client_id, cand AS product_id, round(sum(sim), 9) AS score FROM pairs p JOIN sim ON seed = p.product_id WHERE co >= 3 AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.client_id = p.client_id AND q.product_id = cand) GROUP BY 1, 2)",
    "liked": "SELECT product_id, row_number() OVER (ORDER BY count(*) DESC, product_id) AS r FROM goods GROUP BY 1 ORDER BY r LIMIT 50",
    "wanted": """SELECT client_id, product_id, min(r) AS r FROM (SELECT client_id, product_id, r FROM beside WHERE r <= 50 UNION ALL SELECT client_id, product_id, 1000 + r FROM (SELECT DISTINCT client_id FROM goods), liked) w
      WHERE NOT EXISTS (SELECT 1 FROM lists l WHERE l.client_id = w.client_id AND l.product_id = w.product_id) GROUP BY 1, 2""",
    "filled": "SELECT w.client_id, product_id, coalesce(n, 0) + row_number() OVER (PARTITION BY w.client_id ORDER BY r) AS rank FROM wanted w LEFT JOIN (SELECT client_id, count(*) AS n FROM lists GROUP BY 1) x ON x.client_id = w.client_id",
}


@P.add("c7_backfilled_lists", "SELECT client_id, product_id, source, CAST(rank AS INTEGER) AS rank FROM lists UNION ALL SELECT client_id, product_id, 'discovery', CAST(rank AS INTEGER) FROM filled WHERE rank <= 25", **TODAY)
def c7_backfilled(spark, d):
    """Quota lists of every client today, filled up from co-purchase and popularity. No client has a hundred orders, so the SQL
    weighs frequency by 0.30."""
    every, common = bought(spark, d)
    lines = checkpointed(every.join(common, "product_id", "left_anti"))
    own = checkpointed(reco.owned(lines, "product_id"))
    newest = checkpointed(reco.newest_pairs(every, "product_id").join(common, "product_id", "left_anti"))
    even = lambda df: df.withColumn("score", F.round("score", 9))
    first = even(reco.repurchase_scores(lines, "product_id", reco.segments(lines, "product_id"), END))
    second = even(reco.neighbour_items(reco.similar_clients(own, "product_id", newest=newest), own, "product_id"))
    third = even(reco.co_scores(own, reco.co_purchase(own, "product_id", 3), "product_id").join(own, ["client_id", "product_id"], "left_anti"))
    lists = checkpointed(reco.quota_lists(first, second, groups(spark, d), "product_id"))
    return reco.backfilled(lists, own, third, lines, "product_id")


def prepared(spark, d, **caps):
    """Cases, truth, each case's history, and both scored lists; caps go to `reco.discovery_at`."""
    lines = checkpointed(plain(spark, d).select("client_id", "product_id", "order_id", "created"))
    cases = checkpointed(reco.last_basket_cases(lines))
    truth = lines.join(cases.select("client_id", "order_id"), ["client_id", "order_id"]).select("client_id", "product_id").distinct()
    before = reco.history(lines, cases)
    return lines, cases, truth, checkpointed(reco.repurchase_at(before, "product_id")), checkpointed(reco.discovery_at(lines, cases, "product_id", **caps))


@P.add("j10_c7_quota_lists", "SELECT client_id, product_id, source, CAST(rank AS INTEGER) AS rank FROM lists", **CASES)
def c7_quota(spark, d):
    """Repurchase quota, then discoveries, for each client at its own cut-off."""
    _, _, _, own, found = prepared(spark, d)
    return reco.quota_lists(own, found, groups(spark, d), "product_id")


METRICS = "count(*) AS n, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS hit_rate, round(avg(h / 10), 6) AS precision, round(avg(h / size), 6) AS recall, round(avg(coalesce(1 / best, 0)), 6) AS mrr"
JUDGED = "SELECT coalesce(s.segment, 'LIGHT') AS segment, h, size, best FROM (SELECT g.client_id, count(*) AS size, count(l.rank) AS h, min(l.rank) AS best FROM goal g LEFT JOIN (SELECT * FROM lists WHERE rank <= 10) l ON l.client_id = g.client_id AND l.product_id = g.product_id GROUP BY 1) x LEFT JOIN seg s ON s.client_id = x.client_id"


def rounded(df):
    return df.withColumns({m: F.round(m, 6) for m in ("hit_rate", "precision", "recall", "mrr")})


@P.add("c11_evaluation_by_segment", f"SELECT coalesce(segment, 'ALL') AS segment, {METRICS} FROM judged GROUP BY ROLLUP (segment)", **CASES, judged=JUDGED)
def c11_segment(spark, d):
    _, _, truth, own, found = prepared(spark, d)
    lists = reco.quota_lists(own, found, groups(spark, d), "product_id")
    return rounded(reco.evaluate_by_segment(lists, truth, own.select("client_id", "segment").distinct(), "product_id", 10))


@P.add("c11_region_scope")
def c11_region(spark, d):
    """Hits at 10 with discoveries from all clients and from those of the client's own region; repurchase is the same. Both scopes
    take every client that is alike enough, without a cap on candidates or neighbours."""
    every = {"candidates": None, "most": None}
    lines, cases, truth, own, found = prepared(spark, d, **every)
    region = c.read(spark, d, "customer").select(F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("region_id"))
    scoped = lines.join(region, "client_id").withColumn("product_id", F.col("product_id") * 1000 + F.col("region_id"))
    near = reco.discovery_at(scoped, cases, "product_id", **every).withColumn("product_id", F.floor(F.col("product_id") / 1000))
    parts = [reco.evaluate(reco.quota_lists(own, f, groups(spark, d), "product_id", repurchase=5, top=10), truth, "product_id", 10).select(F.lit(n).alias("scope"), "*") for n, f in (("all", found), ("region", near))]
    return rounded(parts[0].unionByName(parts[1]))


FOLD = "1999-07-01"


def popular(lines, item, top):
    counts = lines.groupBy(item).agg(F.countDistinct("client_id").alias("n")).orderBy(F.desc("n"), item).limit(top)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), item)))  # the top rows only


def factor_lists(spark, lines, clients, top, rank=32, rounds=12):
    """(client_id, product_id, rank) by implicit-feedback factors; ids are mapped densely, and only `clients` are scored."""
    counts = checkpointed(lines.groupBy("client_id", "product_id").agg(F.countDistinct("order_id").cast("float").alias("n")))
    ids = {k: checkpointed(counts.select(k).distinct().withColumn(f"{k}_i", (F.dense_rank().over(Window.partitionBy(F.pmod(F.xxhash64(k), F.lit(1024)).cast("int").alias("b")).orderBy(k)) * 1024 + F.pmod(F.xxhash64(k), F.lit(1024))).cast("int"))) for k in ("client_id", "product_id")}
    rows = counts.join(ids["client_id"], "client_id").join(ids["product_id"], "product_id")
    users, items = factors.implicit_factors(rows, "client_id_i", "product_id_i", "n", rank=rank, rounds=rounds, alpha=40.0, reg=0.1, seed=7)
    asked = ids["client_id"].join(clients, "client_id", "left_semi").select(F.col("client_id_i").alias("id"))
    users = users.join(asked, "id", "left_semi")
    got = factors.best_matches(users, items, top).select(F.col("user").alias("client_id_i"), F.col("item").alias("product_id_i"), "rank")
    return got.join(ids["client_id"], "client_id_i").join(ids["product_id"], "product_id_i").select("client_id", "product_id", "rank")


@P.add("c12_single_fold")
def c12(spark, d):
    """Four recommenders trained once before a fold day, on the clients whose last basket is after it."""
    lines = checkpointed(plain(spark, d).select("client_id", "product_id", "order_id", "created"))
    cases = reco.last_basket_cases(lines).where(F.col("as_of") >= F.lit(FOLD).cast("date"))
    before = lines.where(F.col("created") < F.lit(FOLD).cast("date"))
    truth = checkpointed(lines.join(cases, ["client_id", "order_id"]).select("client_id", "product_id").distinct())
    fold = cases.select("client_id", F.lit(FOLD).cast("date").alias("as_of"))
    past_ = reco.history(before, fold)
    per = past_.groupBy("client_id", "product_id").agg(F.countDistinct("order_id").alias("n"))
    lists = {
        "factors": factor_lists(spark, before, truth.select("client_id").distinct(), 10),
        "hybrid": reco.quota_lists(reco.repurchase_at(past_, "product_id"), reco.discovery_at(before, fold, "product_id"), groups(spark, d), "product_id"),
        "most_frequent": ranking.first_per(per, ["client_id"], [F.desc("n"), F.col("product_id")], 10),
        "popular": truth.select("client_id").distinct().join(F.broadcast(popular(before, "product_id", 10))).select("client_id", "product_id", "rank"),
    }
    parts = [reco.evaluate(r, truth, "product_id", 10).select(F.lit(n).alias("model"), "*") for n, r in lists.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


@P.add("c13_quota_sweep")
def c13_quota(spark, d):
    """Metrics of the hybrid under several repurchase quotas, over one set of cases and scores."""
    _, _, truth, own, found = prepared(spark, d)
    parts = [reco.evaluate(reco.quota_lists(own, found, groups(spark, d), "product_id", repurchase=q), truth, "product_id", 25).select(F.lit(q).alias("quota"), "*") for q in (25, 20, 10, 0)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out)


@P.add(
    "c10_last_basket_cases",
    "SELECT DISTINCT l.client_id, v.group_id FROM (SELECT client_id, max((created, order_id)) AS m FROM past_sales GROUP BY 1 HAVING count(DISTINCT order_id) >= 2) l JOIN past_sales v ON v.client_id = l.client_id AND v.order_id = l.m[2]",
)
def c10(spark, d):
    lines = past(spark, d)
    last = lines.groupBy("client_id").agg(F.max(F.struct("created", "order_id")).alias("m"), F.countDistinct("order_id").alias("n")).where("n >= 2").select("client_id", F.col("m.order_id").alias("order_id"))
    return lines.join(last, ["client_id", "order_id"]).select("client_id", "group_id").distinct()


@P.add(
    "c11_evaluation_of_frequency",
    """SELECT count(*) AS n, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS hit_rate, round(avg(coalesce(h, 0) / 5), 6) AS precision, round(avg(coalesce(h, 0) / size), 6) AS recall, round(avg(coalesce(1 / first, 0.0::DOUBLE)), 6) AS mrr FROM
    (SELECT t.client_id, count(*) AS size, count(r.rank) AS h, min(r.rank) AS first FROM truth t LEFT JOIN recs r ON r.client_id = t.client_id AND r.group_id = t.group_id GROUP BY 1)""",
    truth="SELECT DISTINCT client_id, group_id FROM valid_sales WHERE created >= DATE '2000-01-01' AND created < DATE '2000-04-01'",
    recs="SELECT client_id, group_id, rank FROM (SELECT client_id, group_id, row_number() OVER (PARTITION BY client_id ORDER BY count(DISTINCT order_id) DESC, group_id) AS rank FROM past_sales GROUP BY 1, 2) WHERE rank <= 5",
)
def c11(spark, d):
    from tidemark.operators.ranking import first_per

    truth = reco.owned(sales.window(valid(spark, d), END, "2000-04-01"), "group_id")
    per = past(spark, d).groupBy("client_id", "group_id").agg(F.countDistinct("order_id").alias("n"))
    recs = first_per(per, ["client_id"], [F.desc("n"), F.col("group_id")], 5)
    return reco.evaluate(recs, truth, "group_id", 5).select("n", *[F.round(m, 6).alias(m) for m in ("hit_rate", "precision", "recall", "mrr")])


C11_SQL = """SELECT count(*) AS n, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS hit_rate, round(avg(coalesce(h, 0) / 10), 6) AS precision, round(avg(coalesce(h, 0) / size), 6) AS recall, round(avg(coalesce(1 / first, 0.0::DOUBLE)), 6) AS mrr FROM
    (SELECT t.client_id, count(*) AS size, count(g.r) AS h, min(g.r) AS first FROM (SELECT DISTINCT client_id, product_id FROM valid_sales WHERE created >= DATE '2000-01-01' AND created < DATE '2000-04-01') t LEFT JOIN (SELECT * FROM blended WHERE r <= 10) g ON g.client_id = t.client_id AND g.product_id = t.product_id GROUP BY 1)"""


@P.add("c11_evaluation_of_hybrid", C11_SQL, **T, **BLEND)
def c11b(spark, d):
    return rounded(reco.evaluate(hybrid(spark, d), reco.owned(sales.window(valid(spark, d), END, "2000-04-01"), "product_id"), "product_id", 10))


@P.add("c8_matrix_factorisation")
def c8(spark, d):
    """Implicit-feedback factors of products, 32 by 12 rounds; the first five for every client."""
    lines = checkpointed(plain(spark, d).select("client_id", "product_id", "order_id"))
    return factor_lists(spark, lines, lines.select("client_id").distinct(), 5)
