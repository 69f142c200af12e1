"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import ensure_checkpoint_dir

SPACE = 32


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id gives -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(-1))


def utf8(col: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def text_keys(text: str = "text") -> list[Column]:
    """128-bit key of a text as two columns ``k1`` and ``k2``; a null text has that of an empty one."""
    data = utf8(text)
    return [F.xxhash64(data).alias("k1"), F.xxhash64(F.lit(1), data).alias("k2")]


class Scratch:
    """Tables of one call in a folder of its own below ``spark.checkpoint.dir``.

    ``drop()`` removes the folder; call it only when nothing lazy reads from it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def keep(self, df: DataFrame, *, codec: str = "zstd") -> DataFrame:
        """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
        self._n += 1
        out = f"{self.path}/{self._n}"
        df.write.option("compression", codec).parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame, at_least: int = 1) -> int:
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, everything that is no letter -> space."""
    out = np.full(0x110000, SPACE, dtype=np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def by_size(batches: Iterator[pa.RecordBatch], column: int = -1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of the text (or binary) in ``column``, so that few long texts are in
    Python at a time; one longer text is a batch of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column % b.num_columns)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield b.slice(at, end - at)
            at = end


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` whose Python workers can import this package.

    On a cluster the package is installed on the executors; where driver and executors see the same
    folders (local sessions), the source tree is put on the workers' path.
    """
    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), root) if x)
    return df.mapInArrow(fn, schema)


LEAST = -(1 << 63)


def key_ranges(df: DataFrame, key: str, tie: str, n: int) -> Column:
    """Range number, 0 to n - 1, of each row in the order of (``key``, ``tie``), both longs, nulls first.

    Bounds are quantiles of the key alone, so the pass that finds them reads one column. A key so
    frequent that several bounds fall on it is spread over their ranges by ``tie``, in order."""
    known = F.coalesce(F.col(key).cast("long"), F.lit(LEAST))
    found = df.select(known.cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted(min(max(int(b), LEAST), -LEAST - 1) for b in found)
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def count(below) -> Column:
        """Binary search: how many bounds are ``below`` the key."""
        def halve(s: Column, _: Column) -> Column:
            mid = F.shiftright(s["lo"] + s["hi"], 1)
            up = below(F.element_at(table, F.least(mid + 1, F.lit(len(bounds)))))
            open_ = s["lo"] < s["hi"]
            return F.struct(F.when(open_ & up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(s["hi"]).alias("hi"))

        whole = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), whole, halve, lambda s: s["lo"])

    low, high = count(lambda b: b < known), count(lambda b: b <= known)
    share = (F.col(tie).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(low == high, low).otherwise(F.least(low + F.floor(share * (high - low + 1)).cast("int"), high))
