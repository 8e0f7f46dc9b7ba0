"""Scores of the items that clients lack equal a join of all items with all their similar ones, and never make rows for items they have."""

import random

from pyspark.sql import functions as F

from tidemark.operators import reco


def test_scores_equal_the_join(spark):
    rng = random.Random(3)
    items = [f"g{i}" for i in range(12)]
    own = [(m, c, g) for m in (0, 1) for c in range(40) for g in rng.sample(items, rng.choice((1, 3, 11, 12)))] + [(0, 99, "alone"), (0, 98, "alone"), (0, 98, "g1")]
    sim = [(m, a, b, rng.random()) for m in (0, 1) for a in items for b in items if a != b and (a, b) != ("g0", "g1") and rng.random() < 0.6]
    o, s = spark.createDataFrame(own, "m int, client_id long, g string"), spark.createDataFrame(sim, "m int, seed string, cand string, sim double")
    got = reco.lacking_scores(o, s, "g", ["m"])
    joined = o.withColumnRenamed("g", "seed").join(s, ["m", "seed"]).groupBy("m", "client_id", F.col("cand").alias("g")).agg(F.sum("sim").alias("score")).join(o, ["m", "client_id", "g"], "left_anti")
    rows = lambda df: sorted((r.m, r.client_id, r.g, round(r.score, 9)) for r in df.collect())
    assert rows(got) == rows(joined) and len(rows(got)) > 100
    assert rows(reco.lacking_scores(o, s.where("false"), "g", ["m"])) == []


def test_pairs_by_when_both_are_there_add_up_to_those_of_each_date(spark):
    rng = random.Random(4)
    first = [(c, g, rng.randrange(3)) for c in range(30) for g in rng.sample("abcdefgh", rng.choice((1, 2, 5, 8)))]
    f = spark.createDataFrame(first, "client_id long, g string, since int")
    at = f.join(spark.createDataFrame([(i,) for i in range(3)], "m int"), F.col("m") >= F.col("since"))
    for most in (3, 100):
        each = {(r.m, r.seed, r.cand): r.co for r in reco.together(at.drop("since"), "g", ["m"], most).collect()}
        got = {}
        for r in reco.together(f, "g", most=most, since="since").collect():
            for m in range(r.since, 3):
                got[m, r.seed, r.cand] = got.get((m, r.seed, r.cand), 0) + r.co
        assert got == each
