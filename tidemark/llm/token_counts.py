"""Token counts from flat, unindexed token files by a separator scan.

A file is a plain stream of little-endian unsigned 16-bit ids. A record is the decimal digits of the document's id as
pieces, `head`, the ids of its text, and `end`; nothing else marks where records or blocks begin. Spark's text reader
deals a file to tasks in blocks that begin after the two bytes of `end`, wherever they stand; these can also be the halves of
two neighbouring ids, so a block does not know whether it begins on an id. Each task puts the bytes of its blocks together
again and finds `end` by one vectorised comparison, under both alignments where a block is not the first of its file. A
prefix scan over the blocks' sizes then tells the right one, and another over the ends before a block stitches the records
that blocks cut.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import sentence_pieces
from tidemark.llm.io import materialise, shared_dir
from tidemark.llm.words import column, slices, texts_of

LARGEST_ID = 0x7FFF


def _separator(end: int) -> str:
    """`end` as the two characters that are its bytes; ids below 128 only, so that bytes and characters are the same."""
    if not 0 < end < 128:
        raise ValueError("the end of a document must be an id from 1 to 127")
    return chr(end) + "\0"


def write_token_files(docs: DataFrame, path: str, model: str, head: int = 1, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs and writes their records to flat files under path, with Spark's text writer. Rows without an id are left out.

    Null and empty texts give records without ids between head and end; repeated rows give records of their own; an empty
    table gives no record; other columns are ignored.
    """

    def run(batches):
        pieces = sentence_pieces.load(model)
        if pieces.size > LARGEST_ID:
            raise ValueError("the vocabulary does not fit 15 bits")
        digit, at = pieces.words(pa.array(list("0123456789-")))
        if len(digit) != 11:
            raise ValueError("a digit is not one piece of this model")
        mark = np.array([head], "<u2")
        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                ids, at = pieces.encode(texts_of(batch, "text"))
                ids = ids.astype("<u2")
                names = [digit[["0123456789-".index(c) for c in str(i)]].astype("<u2") for i in column(batch, "doc_id").to_pylist()]
                records = [np.concatenate((name, mark, ids[a:b])).tobytes() for name, a, b in zip(names, at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", _separator(end)).text(path)


def _joined(parts: pa.Array, separator: bytes) -> np.ndarray:
    """The bytes of all parts, each followed by the separator."""
    parts = parts.cast(pa.large_binary())
    at = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    data = np.frombuffer(parts.buffers()[2], np.uint8)[at[0] : at[-1]] if parts.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = np.empty(len(data) + 2 * len(parts), np.uint8)
    ends = at[1:] - at[0] + 2 * np.arange(len(parts))
    gap = np.zeros(len(out), bool)
    gap[ends], gap[ends + 1] = True, True
    out[~gap] = data
    out[ends], out[ends + 1] = separator[0], separator[1]
    return out


def count_tokens(spark: SparkSession, path: str, model: str, head: int = 1, end: int = 2) -> DataFrame:
    """(doc_id, n_tokens) of every record in the files under path; blocks and files may be dealt to tasks in any way.

    An empty file gives no rows; a last record without its end counts as ended. Records of one id give a row each.
    """
    separator = _separator(end)
    blocks = (
        spark.read.option("lineSep", separator)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("block"))
    )

    def scan(batches):
        pieces = sentence_pieces.load(model)
        value = np.full(LARGEST_ID + 2, -1, np.int64)  # the last for what is no id
        digit, _ = pieces.words(pa.array(list("0123456789")))
        value[digit] = np.arange(10)
        minus = int(pieces.words(pa.array(["-"]))[0][0])

        def part(ids: np.ndarray):
            """(digits of the name, number of ids after head, whether head is here) of a piece of a record."""
            at = np.flatnonzero(ids == head)
            if not len(at):
                return ids, 0, False
            return ids[: at[0]], len(ids) - int(at[0]) - 1, True

        def spelled(ids: np.ndarray) -> str:
            return "".join("-" if i == minus else str(value[i]) for i in ids.tolist())

        def rows_of(ids: np.ndarray, place: tuple) -> list[tuple]:
            """The records that lie inside a stretch of ids, and the pieces before its first end and after its last one."""
            ends = np.flatnonzero(ids == end)
            heads = np.flatnonzero(ids == head)
            inner = np.searchsorted(ends, heads)
            whole = (inner > 0) & (inner < len(ends))
            first, stop = ends[inner[whole] - 1] + 1, ends[inner[whole]]
            mid = heads[whole]
            name, width = np.zeros(len(mid), np.int64), mid - first
            negative = ids[np.minimum(first, len(ids) - 1)] == minus if len(mid) else np.zeros(0, bool)
            for k in range(int(min(width.max(), 20)) if len(mid) else 0):
                has = width > k
                d = value[np.minimum(ids[first[has] + k], LARGEST_ID + 1)]
                name[has] = np.where(d >= 0, name[has] * 10 + d, name[has])
            name = np.where(negative, -name, name)
            out = [(*place, None, None, int(i), int(c), None, None, None, None) for i, c in zip(name, stop - mid - 1)]
            lead = int(ends[0]) if len(ends) else len(ids)
            for k, (some, closed) in enumerate([(ids[:lead], len(ends) > 0), (ids[ends[-1] + 1 :] if len(ends) else ids[:0], False)]):
                before, count, has = part(some)
                # ids before a head, or without one, may belong to a name or to a text: stitching tells
                digits = value[np.minimum(before, LARGEST_ID + 1)]
                named = len(before) <= 20 and ((digits >= 0) | (before == minus)).all()
                out.append((*place, k, None, None, count, spelled(before) if named else "", bool(has), len(before), closed))
            return out

        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_())
        names = ["file", "start", "parity", "row", "k", "bytes", "doc_id", "n", "name", "has", "loose", "closes"]
        now, row, passed = None, 0, 0
        for whole in batches:
            for batch in slices(whole, "block", 8 << 20):
                file, start = column(batch, "file").to_pylist(), column(batch, "start").to_numpy()
                cuts = [0, *(i for i in range(1, len(file)) if (file[i], start[i]) != (file[i - 1], start[i - 1])), len(file)]
                for x, y in zip(cuts, cuts[1:]):
                    place = (file[x], int(start[x]))
                    if place != now:
                        now, row, passed = place, 0, 0
                    stream = _joined(column(batch, "block").slice(x, y - x), separator.encode())
                    rows = [(*place, None, row, None, len(stream), None, None, None, None, None, None)]
                    for parity in (0, 1) if place[1] else (0,):
                        # A stretch that begins inside an id has lost that id's low byte, and one that ends inside an id
                        # ends with it: in both cases the second byte of the separator, a zero.
                        own = np.concatenate((np.zeros((parity + passed) % 2, np.uint8), stream))
                        rows += rows_of(own[: len(own) // 2 * 2].view("<u2"), (*place, parity, row))
                    row, passed = row + 1, passed + len(stream)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "file string, start long, parity int, row long, k int, bytes long, doc_id long, n long, name string, has boolean, loose long, closes boolean"
    return stitch(blocks.mapInArrow(scan, schema))


def stitch(found: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) from whole records and the pieces of records that blocks cut.

    Windows hold a row or two for each 8 MB of a file, whatever its records are.
    """
    found = materialise(found, "token-scan")
    sizes = found.where("bytes is not null").groupBy("file", "start").agg(F.sum("bytes").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aligned = sizes.select("file", "start", (before % 2).cast("int").alias("parity"))
    first = (F.col("start") == 0) & F.col("bytes").isNull()
    found = found.where(first).unionByName(found.where((F.col("start") > 0) & F.col("bytes").isNull()).join(aligned, ["file", "start", "parity"], "left_semi"))
    whole = found.where("doc_id is not null").select("doc_id", F.col("n").alias("n_tokens"))
    order = Window.partitionBy("file").orderBy("start", "row", "k")
    cut = found.where("doc_id is null").withColumn("record", F.coalesce(F.sum(F.col("closes").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("file", "record").orderBy("start", "row", "k").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("after", F.coalesce(F.max("has").over(inside), F.lit(False)))
    joined = cut.groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("after"), F.struct("start", "row", "k", "name")))), lambda x: x["name"]), "").alias("name"),
        F.sum(F.when(F.col("after"), F.col("loose") + F.col("n")).otherwise(F.col("n"))).alias("n_tokens"),
    )
    return whole.union(joined.where("name <> ''").select(F.col("name").cast("long"), "n_tokens"))


def token_report(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens for every document with an id: encodes, writes flat files to the shared folder, scans them.

    Null and empty texts have no tokens, rows without an id are left out, repeated rows give a row each, an empty table none.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, model)
    return count_tokens(docs.sparkSession, path, model)
