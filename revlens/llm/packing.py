"""Sum-of-squares packing of token sequences into sequences of a fixed size.

Texts longer than the size are cut; the first piece takes the remainder, the others fill a sequence
each, so every text leaves at most one short piece to pack. With N(g) open sequences of gap g, a piece
of length s goes to the gap g >= s for which the sum of N(g)^2 after the move is smallest, the
tightest on ties; a new sequence is opened only where none has room. Pieces come longest first, which
the method leaves open: on the test corpus it then needs 0.1 % over the lower bound instead of 2.8 %.

Scale: pieces are dealt evenly into groups of about ``PIECES_PER_GROUP`` by row number, so no key can
be hot; each group is packed in one streaming pass whose state is its open sequences. A group
ends with a handful of part-filled sequences, which is all that the split costs.

Defined cases: null or empty text is one piece that holds the end id; no rows -> no rows; equal
lengths are placed in key order; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import Scratch, map_batches, partitions
from revlens.llm.tokens import encode_lists, id_lists, slices

SIZE, PIECES_PER_GROUP = 1024, 1 << 17


def token_pieces(df: DataFrame, path: str, spaces: str, end_id: int | None, key: str = "doc_id", text: str = "text",
                 size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """Pieces (key, piece, start, length, ids_crc32 and, if asked for, ids) of at most ``size`` tokens."""
    source = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, piece, start, parts = [], [], [], []
            lists = encode_lists(b.column(1), path, spaces, end_id)
            ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
            for k, (first, last) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                cuts = [first, *range(first + ((last - first) % size or size), last + 1, size)] if last > first else []
                for j, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(k), piece.append(j), start.append(a - first), parts.append(ids[a:z])
            out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                   pa.array([len(x) for x in parts], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in parts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [id_lists(parts)] * with_ids, names=schema.names)

    schema = source.select(key).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema
    return map_batches(source, run, schema)


class Packer:
    """Open sequences by gap; ``put`` places one length and returns (sequence, offset)."""

    def __init__(self, size: int):
        self.size, self.opened = size, 0
        self.n = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, s: int) -> tuple[int, int]:
        n = self.n[s:self.size]
        left = 2 * self.n[:self.size - s] + 1  # what a sequence adds at the gap it is left with
        if len(left):
            left[0] = 0  # a full sequence is no longer open
        change = np.where(n > 0, left - 2 * n + 1, np.iinfo(np.int64).max)
        g = s + int(change.argmin()) if len(change) and (n > 0).any() else self.size
        if g == self.size:
            at, self.opened = self.opened, self.opened + 1
        else:
            at = self.open[g].pop()
            self.n[g] -= 1
        if g > s:
            self.open[g - s].append(at)
            self.n[g - s] += 1
        return at, self.size - g


def _place_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, length descending), g first and length second -> sequence_id and offset added."""
    group, packer = None, Packer(size)
    for b in batches:
        seq, offset = [], []
        for g, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if g != group:
                group, packer = g, Packer(size)
            at, o = packer.put(s)
            seq.append(2 * (g << 32 | at))
            offset.append(o)
        yield pa.RecordBatch.from_arrays([*b.columns[2:], b.column(1), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
                                         names=[*b.schema.names[2:], "length", "sequence_id", "offset"])


def place(pieces: DataFrame, key: str = "doc_id", size: int = SIZE, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """``pieces`` (a written table with ``length`` of 1 to ``size``) with ``sequence_id`` and ``offset``."""
    rest = [c for c in pieces.columns if c not in ("length", "sequence_id", "offset")]
    pieces = pieces.select("length", *rest)
    short = pieces.where(F.col("length") < size)
    groups = max(1, -(-short.count() // per_group))
    dealt = short.select(F.pmod(F.monotonically_increasing_id(), F.lit(groups)).alias("__g"), "length", *rest)
    dealt = dealt.repartition(min(groups, partitions(pieces)), "__g").sortWithinPartitions("__g", F.desc("length"), key, "piece")
    schema = pieces.select(*rest, "length").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _place_batches(batches, size)

    full = pieces.where(F.col("length") == size).select(
        *rest, "length", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return map_batches(dealt, run, schema).unionByName(full)


def pack(df: DataFrame, path: str, spaces: str, end_id: int | None, key: str = "doc_id", text: str = "text",
         size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """Pieces of every text with their ids (if asked for) and their place in the packed sequences."""
    pieces = token_pieces(df, path, spaces, end_id, key, text, size, with_ids)
    return place(Scratch(df.sparkSession, "pieces").keep(pieces), key, size)


def sequences(packed: DataFrame) -> DataFrame:
    """From ``pack`` with ids: (sequence_id, ids), each at most one sequence long."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
