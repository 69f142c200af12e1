"""SimHash near-duplicates: 64-bit fingerprints linked by bit-sliced comparison.

Fingerprint: XXH64 of every shingle, one majority vote a bit. Two fingerprints link at ``radius``
or fewer differing bits. The 64 bits are cut into ``blocks`` blocks; two linked fingerprints agree
on at least ``blocks - radius`` of them, so each fingerprint is filed once under every choice of
that many blocks and only rows of one file are compared: no link is lost. With 6 blocks and radius
4 that is 15 files keyed by 20 to 22 bits.

Inside a file, fingerprints lie as bit planes (one machine word holds one bit of 64 fingerprints).
A query's bit flips a whole plane; differing bits are added to counters by carry-save full adders,
three planes at a time, and words whose 64 fingerprints all exceed the radius are abandoned.

Scale: equal fingerprints are one row from the start; a file of more than ``rows_per_part`` rows is
cut into parts that meet pairwise in separate tasks; a task returns a spanning forest of its links,
never all pairs; components are found by alternating stars. Hashing needs no shuffle.

Defined cases: null or wordless text -> fingerprint 0, linked like any other; a null id never names
a component unless all its ids are null (then the component id is null); repeated rows each get
their row; no rows -> no rows; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import Scratch, by_size, map_batches, partitions, utf8
from revlens.llm.components import components

SEED, BITS = 42, 64
WORDS_OF = 4096  # rows of a part
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes, width: int = 4) -> int:
    """Fingerprint of a text given as UTF-8: A-Z lowered, split at ASCII white space."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)),
                             np.uint64, len(words) - width + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 4) -> DataFrame:
    """Columns ``keep`` (all by default) and ``fp``, the fingerprint as a signed long."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            fps = _signed([fingerprint(x, width) for x in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fps], names=[*b.schema.names[:-1], "fp"])

    source = df.select(*[F.col(f"`{c}`") for c in keep], utf8(f"`{text}`").alias("__text"))
    return map_batches(source, run, source.drop("__text").schema.add("fp", "long"))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 values: row b holds bit b of all values, 64 to a word."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    wide = np.zeros((BITS, -(-len(values) // 64) * 64), np.uint8)
    wide[:, :len(values)] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _exceeds(c: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the counters ``c`` (and sticky ``over``) whose count is above ``radius``."""
    above, equal = over.copy(), ~over
    for k in reversed(range(len(c))):
        if radius >> k & 1:
            equal &= c[k]
        else:
            above |= equal & c[k]
            equal &= ~c[k]
    return above


def within(queries: np.ndarray, sliced: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Boolean matrix (queries x n): at most ``radius`` bits differ. ``sliced``: planes of n values."""
    width = sliced.shape[1]
    flips = (0 - ((queries[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1))).astype(np.uint64)
    at_q, at_w = np.repeat(np.arange(len(queries)), width), np.tile(np.arange(width), len(queries))
    depth = max(2, radius.bit_length())
    c = [np.zeros(len(at_q), np.uint64) for _ in range(depth)]
    over = np.zeros(len(at_q), np.uint64)
    dense = True

    def differ(b: int) -> np.ndarray:
        return (sliced[b][None, :] ^ flips[:, b][:, None]).ravel() if dense else sliced[b][at_w] ^ flips[at_q, b]

    for step, b in enumerate(range(0, BITS, 3)):
        x, y, z = (differ(b + k) if b + k < BITS else None for k in range(3))
        if y is None:
            total, twos = x, np.zeros_like(x)
        elif z is None:
            total, twos = x ^ y, x & y
        else:
            half = x ^ y
            total, twos = half ^ z, (x & y) | (half & z)
        carry = c[0] & total
        c[0] ^= total
        half = carry ^ twos  # full adder into the second counter
        up = (carry & twos) | (c[1] & half)
        c[1] ^= half
        for k in range(2, depth):
            c[k], up = c[k] ^ up, c[k] & up
        over |= up
        if step % 4 == 3:  # abandon words all of whose fingerprints exceed the radius
            alive = _exceeds(c, over, radius) != ALL
            if alive.mean() < 0.7:
                at_q, at_w, over, c, dense = at_q[alive], at_w[alive], over[alive], [k[alive] for k in c], False
                if not len(at_q):
                    break
    out = np.zeros((len(queries), width), np.uint64)
    out[at_q, at_w] = ~_exceeds(c, over, radius)
    return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def forest(values: np.ndarray, radius: int) -> np.ndarray:
    """Root index of each value's component under the link relation, each pair compared once."""
    n = len(values)
    root = np.arange(n)
    sliced_at, sliced, step = 0, planes(values), 256

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def flatten() -> None:
        while True:
            up = root[root]
            if (up == root).all():
                return
            root[:] = up

    for at in range(0, n, step):
        if at - sliced_at >= max(step, n // 8):  # rows already queried leave the planes
            sliced_at, sliced = at, planes(values[at:])
        linked = within(values[at:at + step], sliced, n - sliced_at, radius)
        linked[:, :at - sliced_at] = False
        while True:
            flatten()
            open_ = linked & (root[at:at + step][:, None] != root[sliced_at:][None, :])
            found = open_.any(axis=0).nonzero()[0]
            if not len(found):
                break
            first = open_[:, found].argmax(axis=0)
            pairs = np.unique(np.stack([root[at + first], root[sliced_at + found]], axis=1), axis=0)
            for a, b in pairs.tolist():
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    flatten()
    return root


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (g1, g2, fp) sorted by group -> spanning links (u, v) of each group."""
    held: list[np.ndarray] = []

    def close(rows: np.ndarray) -> list[np.ndarray]:
        new = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        starts = new.nonzero()[0]
        sizes = np.diff(np.concatenate((starts, [len(rows)])))
        out = []
        two = starts[sizes == 2]
        if len(two):
            a, b = rows[two, 2], rows[two + 1, 2]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            out.append(np.stack([a[near], b[near]], axis=1))
        for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            v = np.ascontiguousarray(rows[s:s + size, 2])
            r = forest(v.view(np.uint64), radius)
            moved = (r != np.arange(size)).nonzero()[0]
            out.append(np.stack([v[moved], v[r[moved]]], axis=1))
        return out

    def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found and len(pairs := np.concatenate(found)):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
        rows = np.concatenate([*held, rows]) if held else rows
        last = int((rows[:, :2] == rows[-1, :2]).all(axis=1).argmax())  # start of the unfinished group
        held = [rows[last:]]
        if last:
            yield from emit(close(rows[:last]))
    if held:
        yield from emit(close(held[0]))


def _files(fp: str, radius: int, blocks: int) -> Column:
    """Array of file keys: file number above the agreeing blocks' bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    cut = [F.shiftrightunsigned(F.col(fp), a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(t).cast("long")
        for k in chosen:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(cut[k])
        keys.append(key)
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = 4, blocks: int = 6, rows_per_part: int = WORDS_OF) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``) that connect exactly what is
    within ``radius`` bits of each other: a spanning forest of each compared group."""
    filed = distinct.select("fp", F.explode(_files("fp", radius, blocks)).alias("g1"))
    big = (filed.groupBy("g1").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_part)
           .select("g1", F.ceil(F.col("n") / rows_per_part).cast("int").alias("parts")))
    n, part = F.coalesce("parts", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = (filed.join(big, "g1", "left").select("g1", "fp", part.alias("p"), F.explode(F.sequence(F.lit(0), n - 1)).alias("q"))
             .select("g1", (F.least("p", "q").cast("long") * (1 << 31) + F.greatest("p", "q")).alias("g2"), "fp"))
    grouped = dealt.repartition(partitions(distinct), "g1", "g2").sortWithinPartitions("g1", "g2", "fp")
    return map_batches(grouped, partial(_links, radius=radius), "u long, v long")


def near_duplicates(hashed: DataFrame, key: str = "doc_id", radius: int = 4, blocks: int = 6) -> DataFrame:
    """``hashed``: rows of ``key`` and ``fp`` (see ``fingerprints``), best read from a written table.

    Returns (fp, component_id, keeper): for each distinct fingerprint, the smallest key of its
    component, and whether that key belongs to this very fingerprint."""
    scratch, rounds = (Scratch(hashed.sparkSession, x) for x in ("simhash", "simhash-rounds"))
    distinct = scratch.keep(hashed.groupBy("fp").agg(F.min(F.col(key)).alias("low")))
    roots = components(links(distinct.select("fp"), radius, blocks), rounds)
    placed = scratch.keep(distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
                          .select("fp", "low", F.coalesce("v", "fp").alias("root")))
    rounds.drop()
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("b"))
    return placed.join(best, "root").select("fp", F.col("b.low").alias("component_id"), (F.col("fp") == F.col("b.fp")).alias("keeper"))
