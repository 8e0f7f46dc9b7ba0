"""Exact top-k search by inner product: term-at-a-time accumulation over an inverted index of vector components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 32768
QUERY_ROWS = 16384
PARTIAL = "query_id long, vec_id long, score long"


def whole(vector: Column) -> Column:
    """The vector is there and every component is a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def scaled(vector: Column, by: int) -> Column:
    """floor(by * x) of each component, as an int; larger ones are an error."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(by))).cast("int"))


def sparse_rows(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term (position in the vector) and weight of every component that is not zero."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    weights = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(weights)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    there = weights != 0
    return rows[there], terms[there], weights[there]


class Postings:
    """Inverted index of a block of vectors: for each term, the block's rows that have it, ascending, and their weights."""

    def __init__(self, ids: np.ndarray, vectors: pa.ChunkedArray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        rows, terms, weights = sparse_rows(vectors)
        rows = place[rows]
        by_term = np.lexsort((rows, terms))
        self.rows, self.weights = rows[by_term], weights[by_term]
        self.at = np.searchsorted(terms[by_term], np.arange(terms.max(initial=-1) + 2))
        self.largest = int(np.abs(weights).max(initial=0))

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The inner product of one sparse query with every row, each term scattering its weighted postings."""
        if self.largest * int(np.abs(weights).sum()) >= 1 << 62:
            raise OverflowError("inner products beyond the range of a long")
        dense = np.zeros(len(self.ids), dtype=np.int64)
        for t, w in zip(terms.tolist(), weights.tolist()):
            if t + 1 < len(self.at):
                a, b = self.at[t], self.at[t + 1]
                dense[self.rows[a:b]] += self.weights[a:b] * w
        return dense

    def best(self, dense: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows of the k highest scores, ties to smaller ids, without those of the id own."""
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        dense[a:b] = np.iinfo(np.int64).min
        n = len(dense)
        if n > k:
            cut = np.partition(dense, n - k)[n - k]
            above = np.flatnonzero(dense > cut)
            found = np.concatenate([above, np.flatnonzero(dense == cut)[: k - len(above)]])
        else:
            found = np.arange(n)
        return found[(found < a) | (found >= b)]


def searcher(k: int):
    """Function of one cell: the partial lists of its queries over its candidates."""

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            index = Postings(candidates["vec_id"].to_numpy(), candidates["w"])
            rows, terms, weights = sparse_rows(queries["w"])
            at = np.searchsorted(rows, np.arange(queries.num_rows + 1))
            for i, own in enumerate(queries["vec_id"].to_pylist()):
                dense = index.scores(terms[at[i] : at[i + 1]], weights[at[i] : at[i + 1]])
                found = index.best(dense, own, k)
                for to, values in zip(out, (np.full(len(found), own), index.ids[found], dense[found])):
                    to.append(values)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return search


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    part_rows: int = PART_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose id is divisible by `every`, the k rows with the highest inner product.

    Components become floor(scale * x); ties go to the smaller id. Candidates are all rows of another id. Rows without an id or a
    vector, or with a null or non-finite component, take no part. Rows repeated with id and vector count once; of one id's
    different vectors all are candidates and the smallest is the query. Vectors of different lengths multiply as if filled up
    with zeros. A query without candidates gives no row, an empty table none. Components beyond an int after scaling, and
    inner products that could leave a long, are errors. Other columns are ignored.

    Every query meets every row, in a grid: candidates lie in cells of about part_rows, queries in cells of about query_rows
    (all counted from the rows), and each cell of one meets each of the other in one task, which holds both and emits k rows a
    query. So a task's memory is bounded, nothing passes the driver, and what is shuffled is the pairs by the cell sizes.
    """
    spark = vectors.sparkSession
    own, vector = F.col(f"`{id_col}`").cast("long"), F.col(f"`{vector_col}`")
    rows = vectors.where(own.isNotNull() & whole(vector)).select(own.alias("vec_id"), scaled(vector, scale).alias("w")).distinct()
    n = vectors.count()
    parts = max(-(-n // part_rows), 2 * spark.sparkContext.defaultParallelism)
    chunks = max(-(-n // (every * query_rows)), 1)
    deal = lambda count, seed: F.pmod(F.xxhash64("vec_id", "w", F.lit(seed)), F.lit(count)).cast("int")
    several = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    here = rows.withColumn("_part", deal(parts, 1)).withColumn("_chunk", several(chunks))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("w").alias("w"))
    asked = asked.withColumn("_chunk", deal(chunks, 2)).withColumn("_part", several(parts))
    partial = here.groupBy("_part", "_chunk").cogroup(asked.groupBy("_part", "_chunk")).applyInArrow(searcher(k), PARTIAL)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(w) AS w FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(v.w AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
