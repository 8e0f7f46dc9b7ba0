"""Vector code compression: integer codebooks per vector part, with equal-average nearest-entry search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.io import materialise
from tidemark.llm.spread import salts_of, spread_join
from tidemark.llm.vector_search import whole

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FAR = np.iinfo(np.int64).max // 4
MOST = 1 << 28


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (ties to the lower index) and the squared distance.

    Entries are sorted by component sum. From a part's own sum the search goes outward, always to the nearer sum; the squared
    gap of the sums over the dimension is a lower bound of the squared distance, so a part is done once that strictly exceeds
    its best distance (an equal one could still be a tie of a lower index).
    """
    d, m = parts.shape[1], len(entries)
    totals = entries.sum(axis=1)
    order = np.argsort(totals, kind="stable")
    totals = totals[order]
    own = parts.sum(axis=1)
    up = np.searchsorted(totals, own)
    down = up - 1
    best, index = np.full(len(parts), FAR // max(d, 1)), np.full(len(parts), m)
    row = np.arange(len(parts))
    while len(row):
        below = np.where(down >= 0, own - totals[np.maximum(down, 0)], FAR)
        above = np.where(up < m, totals[np.minimum(up, m - 1)] - own, FAR)
        gap, lower = np.minimum(below, above), below <= above
        on = gap < FAR
        on[on] = gap[on] * gap[on] <= best[row[on]] * d
        row, own, down, up, lower = row[on], own[on], down[on], up[on], lower[on]
        entry = order[np.where(lower, down, up)]
        away = parts[row] - entries[entry]
        distance = np.einsum("ij,ij->i", away, away)
        better = (distance < best[row]) | ((distance == best[row]) & (entry < index[row]))
        best[row[better]], index[row[better]] = distance[better], entry[better]
        down, up = down - lower, up + ~lower
    return index, best


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) as one row per vector; vectors of another length or out of range are errors."""
    values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.any(np.diff(vectors.offsets.to_numpy(zero_copy_only=False)) != dim):
        raise ValueError("vectors of different lengths")
    if np.any(np.abs(values) >= MOST):
        raise OverflowError("components beyond the range of the distances")
    return values.astype(np.int64).reshape(-1, dim)


def summer(books: np.ndarray):
    """Tasks of a round: for every codebook slot (part, entry, count or component) the sum over the task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), books.shape[1], 1 + books.shape[2]), dtype=np.int64)
        for batch in batches:
            rows = integers(batch.column("v"), len(books) * books.shape[2]).reshape(batch.num_rows, len(books), -1)
            for p in range(len(books)):
                index, _ = nearest(rows[:, p], books[p])
                total[p, :, 0] += np.bincount(index, minlength=books.shape[1])
                by_entry = np.argsort(index, kind="stable")
                used, first = np.unique(index[by_entry], return_index=True)
                if len(used):
                    total[p, used, 1:] += np.add.reduceat(rows[by_entry, p], first, axis=0)
        slots = np.flatnonzero(total)
        yield pa.record_batch([pa.array(slots, pa.int64()), pa.array(total.ravel()[slots], pa.int64())], names=["slot", "value"])

    return run


def coder(books: np.ndarray):
    """Tasks of the last pass: each vector's code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = integers(batch.column("v"), len(books) * books.shape[2]).reshape(batch.num_rows, len(books), -1)
            codes, error = np.empty((batch.num_rows, len(books)), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for p in range(len(books)):
                index, distance = nearest(rows[:, p], books[p])
                codes[:, p] = index
                error += distance
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.record_batch([batch.column("vec_id"), text, pa.array(error, pa.int64()), batch.column("label")], names=["vec_id", "code", "error", "label"])

    return run


def codebooks(kept: DataFrame) -> np.ndarray | None:
    """Codebooks [part, entry, component] of the table (vec_id, v, label), or None for an empty one.

    A round reads the table once; its tasks send a sum for each slot of the codebooks. The driver holds the codebooks alone,
    ENTRIES vectors in all.
    """
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    if not first:
        return None
    dim = len(first[0].v)
    if not dim or dim % PARTS:
        raise ValueError(f"{PARTS} equal parts need a length divisible by {PARTS}, not {dim}")
    books = integers(pa.array([r.v for r in first], pa.list_(pa.float64())), dim).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        sums = kept.select("v").mapInArrow(summer(books), "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect()
        total = np.zeros((PARTS, books.shape[1], 1 + books.shape[2]), dtype=np.int64)
        total.ravel()[[r.slot for r in sums]] = [r.value for r in sums]
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without null or non-finite components.

    A vector is cut in PARTS equal parts of integers floor(SCALE * x); the code is the hex index of each part's nearest codebook
    entry, the error the squared distances' sum. Codebooks start as the parts of the smallest ids (null ids last, ties by
    vector) and move to their parts' floored means ROUNDS times; with fewer rows there are fewer entries. label_error sums the error
    over equal labels, nulls together; NaN labels are equal. Repeated rows each count and are returned each; an empty table gives no
    rows. Vectors of different lengths, of one not divisible by PARTS, or with components of 65,536 and more are errors. Other
    columns are ignored.
    """
    vector = F.col(f"`{vector_col}`")
    kept = vectors.where(whole(vector)).select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("v"), F.col(f"`{label_col}`").alias("label"))
    books = codebooks(kept)
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {types['vec_id']}, code string, error long, label {types['label']}"
    if books is None:
        coded, digest = kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label"), ""
    else:
        coded = materialise(kept.mapInArrow(coder(books), schema), "vector-codes")
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # A label is the key (is null, text), so that nulls meet; text spells equal labels alike.
    keyed = coded.select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("text"))
    rows = keyed.withColumn("_by", F.xxhash64("vec_id", "code"))
    groups = rows.groupBy("none", "text").agg(F.sum("error").alias("label_error"), salts_of("_by").alias("_salts"))
    joined = spread_join(rows, groups, ["none", "text"], "_by")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The rounds spelled out one after the other."""
    near = """(SELECT r, p, k % 16 AS e, k // 16 AS dist FROM (
  SELECT a.r, a.p, min(16 * list_sum(list_transform(list_zip(a.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + c.e) AS k
  FROM parts a JOIN {book} c ON a.p = c.p GROUP BY a.r, a.p))"""
    steps = []
    for i in range(ROUNDS):
        steps.append(f"""
near{i} AS MATERIALIZED {near.format(book=f"book{i}")},
book{i + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(u.w, c.w) AS w FROM book{i} c LEFT JOIN (
    SELECT p, e, list(m ORDER BY j) AS w FROM (
      SELECT p, e, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
        SELECT a.p, a.e, t.j, sum(b.w[t.j]) AS s, count(*) AS n
        FROM near{i} a JOIN parts b ON a.r = b.r AND a.p = b.p, (SELECT unnest(range(1, d + 1)) AS j FROM size) t GROUP BY ALL))
    GROUP BY p, e) u ON c.p = u.p AND c.e = u.e),""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT max(len(w)) // 8 AS d FROM kept),
parts AS MATERIALIZED (
  SELECT r, p, w[p * d + 1 : (p + 1) * d] AS w FROM kept, size, (SELECT unnest(range(8)) AS p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, w FROM parts WHERE r <= 16),{"".join(steps)}
last AS MATERIALIZED {near.format(book=f"book{ROUNDS}")},
codes AS (
  SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM last GROUP BY r),
digest AS (
  SELECT sha256(string_agg(CAST(w[j] AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM book{ROUNDS}, (SELECT unnest(range(1, d + 1)) AS j FROM size))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), digest
"""


ORACLE_SQL = oracle_sql()
