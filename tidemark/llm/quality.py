"""Quality by a sparse rule ensemble: paths of small trees over text statistics become rules, a lasso logistic
regression keeps and weighs a few, and the kept rules are Spark column expressions.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.io import materialise

STATISTICS = ("n_words", "word_length", "distinct_share", "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share", "letter_share", "line_words", "stop_share", "repeat_share")
#: Characters counted as symbols.
SYMBOLS = "$%&#*@^~<>{}[]\\"


def _count(text: Column, ch: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(ch), F.lit("")))


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep and s_*, the statistics of the text; null counts as empty, for which all are 0.

    Built-in functions only. Words, and counts that several statistics use, are worked out once, in selects of their own.
    """
    own = [F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)]
    kept = [f"k_{i}" for i in range(len(keep))]
    text = F.col("text")
    df = docs.select(*own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.select(*kept, "text", F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "").alias("words"), F.length("text").alias("length"))
    df = df.select(
        *kept, "text", "words", "length", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.octet_length("text").alias("bytes"), F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))).alias("plain"),
        _count(text, "\n").alias("breaks"),
    )
    n, chars, every = F.col("n"), F.greatest(F.col("length"), F.lit(1)), F.greatest(F.col("n"), F.lit(1))
    symbols = F.col("bytes") - F.octet_length(F.translate(text, SYMBOLS, ""))
    again = F.size(F.filter(F.zip_with("words", F.slice("words", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    found = {
        "n_words": F.log1p(n.cast("double")),
        "word_length": F.col("plain") / every,
        "distinct_share": F.col("distinct") / every,
        "upper_share": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "digit_share": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "symbol_share": symbols / chars,
        "bang_share": _count(text, "!") / chars,
        "bar_share": _count(text, "|") / chars,
        "letter_share": (F.col("length") - F.regexp_count(text, F.lit(r"\P{L}"))) / chars,
        "line_words": n / (F.col("breaks") + 1),
        "stop_share": F.size(F.filter("words", lambda w: F.length(w) <= 3)) / every,
        "repeat_share": again / every,
    }
    return df.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *[v.cast("double").alias(f"s_{k}") for k, v in found.items()])


@dataclass
class Rule:
    """A conjunction of (statistic, lower bound exclusive, upper bound inclusive) and its weight."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def holds(self) -> Column:
        test = F.lit(True)
        for name, low, high in self.bounds:
            c = F.col(f"s_{name}")
            test = test & (c > low if low > -math.inf else F.lit(True)) & (c <= high if high < math.inf else F.lit(True))
        return test.cast("double")


def paths(description: str) -> list[tuple[tuple[str, float, float], ...]]:
    """The conjunctions on all paths of the trees that Spark prints, each branch node and leaf one."""
    out, stack = [], []
    for line in description.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth]
        stack.append((depth, STATISTICS[int(m[3])], m[4], float(m[5])))
        bounds: dict[str, list[float]] = {}
        for _, name, sign, value in stack:
            b = bounds.setdefault(name, [-math.inf, math.inf])
            if sign == "<=":
                b[1] = min(b[1], value)
            else:
                b[0] = max(b[0], value)
        out.append(tuple(sorted((k, a, b) for k, (a, b) in bounds.items())))
    return list(dict.fromkeys(out))


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as one expression over the s_ columns."""
        z = F.lit(self.intercept)
        for rule in self.rules:
            z = z + F.lit(rule.weight) * rule.holds()
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, most_train: int = 40_000, trees: int = 12, depth: int = 3, penalty: float = 0.002) -> RuleEnsemble:
    """Learns from at most about most_train labelled rows whose crc32(id) mod 5 is not 0, a share by a hash of the id beyond.

    Without labels, or with one label only, there are no rules and the score is that label's share (0.5 for none).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    n = known.count()
    if n > most_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_train / n))
    sample = docs.select(F.col("doc_id"), "text").join(F.broadcast(known), "doc_id")
    table = materialise(with_statistics(sample, ["label"]), "quality-sample").coalesce(4)
    n, ones = table.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0.0, float(n)):
        share = min(max((ones or 0) / n, 0.01), 0.99) if n else 0.5
        return RuleEnsemble([], math.log(share / (1 - share)))
    vectors = VectorAssembler(inputCols=[f"s_{k}" for k in STATISTICS], outputCol="x").transform(table).select("label", "x")
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=10, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=7).fit(vectors)
    rules = [Rule(p) for p in paths(forest.toDebugString)]
    if not rules:
        return RuleEnsemble([], math.log(ones / (n - ones)))
    ruled = table.select("label", *[r.holds().alias(f"r_{i}") for i, r in enumerate(rules)])
    x = VectorAssembler(inputCols=[f"r_{i}" for i in range(len(rules))], outputCol="x").transform(ruled).select("label", "x")
    lasso = LogisticRegression(labelCol="label", featuresCol="x", regParam=penalty, elasticNetParam=1.0, maxIter=60).fit(x)
    for rule, w in zip(rules, lasso.coefficients.toArray()):
        rule.weight = float(w)
    return RuleEnsemble([r for r in rules if abs(r.weight) > 1e-6], float(lasso.intercept))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null and empty texts score by rules that hold for zeros.

    Rows without an id are not held out; repeated rows score alike; an empty table gives no rows; other columns are ignored.
    Without labels the score is 0.5.
    """
    model = fit(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", held.alias("held_out"), model.score().alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
