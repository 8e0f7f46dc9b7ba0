"""Exact dedup on a 128-bit content hash, with the bytes compared inside each hash group. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spread import salts_of, spread_join


def squeeze_whitespace(text: Column) -> Column:
    """Each run of space, tab, newline, vertical tab, form feed or carriage return becomes one space; null becomes empty.

    Plain replacements cost a byte search each; the regular expression runs only where two spaces meet.
    """
    flat = F.coalesce(text, F.lit(""))
    for ch in "\t\n\x0b\f\r":
        flat = F.replace(flat, F.lit(ch), F.lit(" "))
    return F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `squeeze_whitespace`; of equal texts the smallest id stays. Null text is the
    empty text. Null ids sort after all others: such a row is kept only when its whole group has no id. Rows repeated
    with the same id share its decision. An empty table gives an empty result; other columns are ignored.

    The grouping key is (md5, text): the hash spreads the rows, the text in the key compares bytes, and partial
    aggregation leaves one row per distinct text and task. The rows join their group's decision under salted keys. So a
    group of copies of any size never meets in one task.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), squeeze_whitespace(F.col(text_col)).alias("norm"))
    keyed = norm.select("doc_id", "norm", F.unhex(F.md5("norm")).alias("h"))
    groups = (
        keyed.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), salts_of("doc_id").alias("_salts"))
        .select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size", "_salts")
    )
    rows = keyed.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    return spread_join(rows, groups, ["h", "sha"], "doc_id").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: of equal texts the row with the smallest id stays, with all its columns.

    Null ids sort after all others, as in `exact_dedup`; of repeated rows with the same id and equal text one stays, the
    smallest by its columns. Columns of any name stay as they are; an empty table gives an empty table.
    """
    norm = squeeze_whitespace(F.col(f"`{text_col}`"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), own.alias("row"))
    rows = docs.select(key.alias("key"), norm.alias("norm")).select("key", "norm", F.unhex(F.md5("norm")).alias("h"))
    return rows.groupBy("h", "norm").agg(F.min("key").alias("first")).select("first.row.*")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
