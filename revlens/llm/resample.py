"""Importance resampling towards a target distribution, by bit-sliced aggregation.

Features of a text are its runs of one to ``longest`` words, hashed into ``BUCKETS`` buckets. A bucket's gain is
the scaled and floored log ratio of its smoothed shares in the target texts and in the corpus; a text's weight
is the floored mean of its features' gains. Texts are drawn without replacement: the highest scores, a
score being the weight plus Gumbel noise that depends on nothing but the id.

Weights are summed without a multiplication a feature. The counts of a text's buckets are cut into bit
planes (plane ``j`` holds bit ``j`` of all bucket counts, one bit a bucket), and so are the gains in two's complement
(the highest plane counts negatively). ``AND`` of a count plane with a gain plane, its popcount and one shift
by ``j + k`` add up to the exact sum of gains; only texts that have a count of 2^j enter plane ``j``.

Scale: nothing is shuffled but one row a bucket and task (totals) and narrow rows of id and score (ranks);
totals and gains have a fixed size. Ranks come from a range sort whose ties end in a row number, so no
value is too frequent for its task.

Defined cases: null text is an empty one; no features -> weight 0; a null id hashes as ``<seed>:`` and loses
ties; repeated rows are documents each; no target texts -> counts of 0; no rows -> no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import Scratch, by_size, map_batches, partitions, utf8

BUCKETS, LONGEST, SCALE = 10_000, 2, 1000
#: Lower case of A-Z; digits, letters and bytes of other characters stay, the rest parts words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ROWS = 64  # texts whose planes are in memory together


def words(data: bytes) -> list[bytes]:
    return data.translate(_BYTES).split()


def features(found: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every run of 1 to ``longest`` words: a run's crc32 goes on from that of the run before."""
    crc, ends, runs = zlib.crc32, [0] * len(found), []
    for n in range(longest):
        if n:
            ends = [crc(b" ", c) for c in ends]
        ends = list(map(crc, found[n:], ends))
        runs.append(ends)
    return (np.fromiter(chain.from_iterable(runs), np.uint32, sum(map(len, runs))) % np.uint32(buckets)).astype(np.int64)


def totals(df: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: summed in each task, then by Spark; one number a bucket is collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in by_size(batches, 0):
            for data in b.column(0).to_pylist():
                n += np.bincount(features(words(data), longest, buckets), minlength=buckets)
        at = n.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = map_batches(df.select(utf8(f"`{text}`").alias("text")), count, "bucket int, n long")
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole-number gain of each bucket, in doubles."""
    wide, all_corpus, all_target = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    ratio = ((float(t + 1) * all_corpus) / (float(s + 1) * all_target) for t, s in zip(target.tolist(), corpus.tolist(), strict=True))
    return np.fromiter((math.floor(scale * math.log(r)) for r in ratio), np.int64, wide)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, rows, words): bit ``k`` of every value of each row, 64 to a word."""
    rows, wide = values.shape
    out = np.zeros((bits, rows, -(-wide // 64) * 8), np.uint8)
    for k in range(bits):
        packed = np.packbits((values >> k & 1).astype(np.uint8), axis=1, bitorder="little")
        out[k, :, :packed.shape[1]] = packed
    return out.view(np.uint64)


class Gains:
    """Bit planes of the gains, as broadcast to the tasks."""

    def __init__(self, values: np.ndarray):
        self.bits = int(max(values.max(initial=0), -1 - values.min(initial=0))).bit_length() + 1
        self.planes = planes(values[None, :].astype(np.int64), self.bits)[:, 0]
        self.worth = np.array([1 << k for k in range(self.bits - 1)] + [-(1 << self.bits - 1)], np.int64)

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """Sum of count times gain of each row of bucket counts."""
        out = np.zeros(len(counts), np.int64)
        most = counts.max(axis=1, initial=0)
        for j in range(int(most.max(initial=0)).bit_length()):
            rows = (most >> j > 0).nonzero()[0]
            plane = planes(counts[rows] >> j, 1)[0]
            both = np.bitwise_count(plane[:, None, :] & self.planes[None, :, :]).sum(axis=2, dtype=np.int64)
            out[rows] += (both @ self.worth) << j
        return out


def weigh(df: DataFrame, model: Gains, text: str = "text", keep: list[str] | None = None, longest: int = LONGEST,
          buckets: int = BUCKETS, names: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """Columns ``keep`` (all by default) with the numbers of words and features and the weight of each text."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]

    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, last):
            found = [words(x) for x in b.column(last).to_pylist()]
            total, many = [], []
            for at in range(0, len(found), ROWS):
                parts = [features(w, longest, buckets) for w in found[at:at + ROWS]]
                counts = np.stack([np.bincount(p, minlength=buckets) for p in parts])
                total.append(model.sums(counts))
                many += [len(p) for p in parts]
            total, many = np.concatenate(total), np.array(many, np.int64)
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array([len(w) for w in found], pa.int64()), pa.array(many), pa.array(weight)],
                                             names=[*keep, *names])

    source = df.select(*[F.col(f"`{c}`") for c in keep], utf8(f"`{text}`").alias("__text"))
    schema = source.drop("__text").schema
    for c in names:
        schema = schema.add(c, "long")
    return map_batches(source, run, schema)


def noise(key: str, seed: int = 7, scale: int = SCALE) -> int:
    """Gumbel noise of an id, from the first 32 bits of the SHA-256 of ``<seed>:<id>``."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(weighed: DataFrame, key: str = "doc_id", weight: str = "weight", seed: int = 7) -> DataFrame:
    """``weighed`` with ``score``: weight and the id's noise."""
    keep = [c for c in weighed.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = np.array([noise(k or "", seed) for k in b.column(len(keep)).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n + b.column(len(keep) + 1).to_numpy())], names=[*keep, "score"])

    source = weighed.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{key}`").cast("string").alias("__key"), F.col(f"`{weight}`").alias("__w"))
    return map_batches(source, run, source.drop("__key", "__w").schema.add("score", "long"))


def draw(rows: DataFrame, percent: int, key: str = "doc_id", least_words: int = 20) -> DataFrame:
    """``rows`` (a written table with ``n_words`` and ``score``) with ``rank``: 1, 2, ... for the drawn
    ``percent`` of the rows of at least ``least_words`` words, highest score first, ties to the smaller id."""
    scratch = Scratch(rows.sparkSession, "draw")
    numbered = scratch.keep(rows.withColumn("__row", F.monotonically_increasing_id()))
    able = numbered.where(F.col("n_words") >= least_words).select("score", F.col(f"`{key}`").alias("id"), "__row")
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("__row")]
    # number the rows of each sort partition, then add what lies before it: one row a partition
    placed = scratch.keep(able.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).select(
        "__row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    drawn = percent * placed.count() // 100
    ranks = placed.join(F.broadcast(sizes), "part").select("__row", (F.col("base") + F.col("at") + 1).alias("rank")).where(F.col("rank") <= drawn)
    return numbered.join(ranks, "__row", "left").drop("__row")
