"""Token-ID files: Parquet list columns laid out for selective reads, written and read by Spark.

A corpus is encoded where it is read, its ids are put in ascending key order (a range shuffle of two bytes
a token where the vocabulary allows, ties by a hash of the text) and written as
one file a range with columns ``key``, ``part``, ``local_start``, ``n_tokens`` and ``ids``. ``ids`` is
dictionary encoded (a vocabulary below 2^16 ids packs into 16 bits a token at most); the sorted or
running columns are delta encoded. Row groups and pages are small enough that a key range, or only
the metadata columns, is read without the token pages of other rows: Parquet's page indexes and
row-group statistics are written for every column, and the files are sorted by key.

A reader gets each row's global ``start``: the sum of the token counts of all files before its own (one
row a file, so that broadcast is bounded by the number of files) plus ``local_start``.

Defined cases: null text counts as empty and is its end id alone; null keys come first; rows of equal
key are ordered by a hash of their text; no rows -> an empty table; extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import by_size, key_ranges, map_batches, partitions
from revlens.llm.words import pieces, tokenizer

ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 128 << 10, 1000
SLICE = 4 << 20  # bytes of text or ids in Python at a time


def encode_lists(texts: pa.Array, path: str, spaces: str, end_id: int | None) -> pa.ListArray:
    """Ids of each text, with the end id if there is one."""
    ids, ends = pieces(path, spaces).encode_column(texts)
    if end_id is not None:
        ids = np.insert(ids, ends[1:], np.uint32(end_id))
        ends = ends + np.arange(len(ends))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))


def packed_type(path: str, end_id: int | None) -> str:
    """The narrowest type that holds every id."""
    most = max(tokenizer(path).get_vocab(with_added_tokens=True).values())
    return "<u2" if max(most, end_id or 0) < 1 << 16 else "<u4"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that few texts and ids are in Python at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def crc_lists(ids: pa.ListArray) -> pa.Array:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    data, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())


def write_tokens(df: DataFrame, out: str, path: str, spaces: str, end_id: int | None = None, key: str = "doc_id",
                 text: str = "text", row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> None:
    """Encode ``df`` and write the token files to ``out``, in ascending order of ``key``."""
    source = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    source = source.select("key", F.xxhash64("text").alias("tie"), "text")
    n = partitions(df)
    kind = packed_type(path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 2, SLICE):
            ids = encode_lists(b.column(2), path, spaces, end_id)
            packed, ends = ids.values.to_numpy().astype(kind).tobytes(), ids.offsets.to_numpy() * np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())],
                                             names=["key", "tie", "packed"])

    # ids are what is moved and sorted, at two bytes a token: a third of the text
    encoded = map_batches(source, encode, source.select("key", "tie").schema.add("packed", "binary"))
    ranged = encoded.select("*", key_ranges(source, "key", "tie", n).alias("range"))
    dealt = ranged.repartitionById(n, "range").sortWithinPartitions("key", "tie", "packed").select("key", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in by_size(batches, 1, SLICE):
            rows = b.column(1).to_pylist()
            counts = np.fromiter(map(len, rows), np.int64, len(rows)) // np.dtype(kind).itemsize
            ends = np.concatenate(([0], np.cumsum(counts)))
            flat = np.frombuffer(b"".join(rows), kind).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(done + ends[:-1]), pa.array(counts), ids],
                names=["key", "part", "local_start", "n_tokens", "ids"])
            done += int(ends[-1])

    schema = source.select("key").schema.add("part", "integer").add("local_start", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    writer = map_batches(dealt, run, schema).write.option("compression", "snappy")
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows,
               "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("key", "local_start", "n_tokens")}
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.parquet(out)


def read_tokens(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, start, n_tokens, ids) of the files at ``out``; select what is needed, the rest is not read."""
    rows = spark.read.parquet(out)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(files), "part").select(
        F.col("key").alias(key), (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids`` replaced by ``ids_crc32``."""
    keep = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], crc_lists(b.column(b.num_columns - 1))],
                                             names=[*b.schema.names[:-1], "ids_crc32"])

    return map_batches(df.select(*keep, ids), run, df.select(*keep).schema.add("ids_crc32", "long"))
