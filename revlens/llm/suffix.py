"""Repeated byte strings across all texts: depth-limited most-significant-digit suffix sort.

A byte goes if it lies in a string of ``WINDOW`` bytes that also starts anywhere else, in the same
text or another. A full suffix array would order every suffix to the end; here suffixes are told
apart only through ``WINDOW`` bytes, digit by digit, and whatever is alone in its group leaves at
once. The groups that are left at that depth are exactly the repeated windows.

* First digit, dealt out by Spark: a gram of ``gram`` bytes, a power of two below the window. Of each window's grams only the one of
  smallest hash is kept (leftmost on ties). The choice depends on nothing but the window's bytes, so
  equal windows choose the same gram at the same place, and every window holds one: grouping only
  these anchors (about one in 170 bytes) by their gram loses no repeat. Alone in its group: gone.
* Next digits, eight bytes at a time, inside a group: the suffix at the anchor is sorted to the
  right and its reverse to the left, ``msd_order`` splitting groups until they are alone or the depth
  is reached. Two windows ``i`` bytes before their anchors are equal just if the left sorts share
  ``i`` and the right sorts ``WINDOW - i`` bytes, so the first and last such ``i`` of a member bound the
  bytes it loses (all its windows hold the anchor, so they form one span).

Texts are keyed by a 128-bit hash and handled once each; a text with a copy loses everything. They
are written once, bucketed by key, so joins move only anchors and spans. Groups of more than
``hot`` members (a line in a third of all texts) go another, equally exact way without one task
holding them: their windows' 128-bit digests are counted by an aggregate that combines map-side.

Defined cases: null text counts as empty; texts under ``WINDOW`` bytes lose nothing; overlaps count;
periodic texts repeat themselves; no rows -> no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import Scratch, map_batches, partitions, utf8

WINDOW, GRAM = 400, 64
HOT = 50_000  # members of a group beyond which its windows are counted by digest
SLAB = 1 << 20  # grams per piece of a very long text; positions fit in 20 bits
ROWS = 20_000  # rows a task sorts at a time (whole groups)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of the ``gram`` (a power of two) bytes at every position, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * MIX[0]
    width = 1
    while width < gram:
        if len(h) <= width:
            return np.empty(0, np.uint64)
        a = h[:-width] * MIX[1]
        a += h[width:]
        a ^= a >> np.uint64(29)
        a *= MIX[0]
        h, width = a, 2 * width
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors: the smallest gram of every window."""
    h = gram_hashes(data, gram)
    w = window - gram + 1
    if len(h) < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low, found = np.uint64(SLAB - 1), []
    for at in range(0, len(h) - w + 1, SLAB - w + 1):
        piece = h[at:at + SLAB]
        key = (piece & ~low) | np.arange(len(piece), dtype=np.uint64)
        rows = -(-len(key) // w)
        wide = np.full(rows * w, ~np.uint64(0))
        wide[:len(key)] = key
        wide = wide.reshape(rows, w)
        ahead = np.minimum.accumulate(wide, axis=1).ravel()
        behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - w + 1
        best = np.minimum(behind[:n], ahead[w - 1:w - 1 + n])
        best = best[np.concatenate(([True], best[1:] != best[:-1]))]
        found.append(np.unique((best & low).astype(np.int64)) + at)
    pos = np.unique(np.concatenate(found))
    return pos, h[pos]


def msd_order(digits: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, digits) and, in that order, how many digits each row shares with the
    one before it (-1: another group). Rows leave the passes when they are alone."""
    n, depth = digits.shape
    order = np.argsort(group, kind="stable")
    shared = np.full(n, depth, np.int64)
    shared[np.concatenate(([True], group[order][1:] != group[order][:-1]))] = -1
    live = np.arange(n)  # places in the order that are in groups of two or more
    for d in range(depth):
        start = shared[live] < depth
        alone = start & np.concatenate((start[1:], [True]))
        live = live[~alone]
        if not len(live):
            break
        part = np.cumsum(shared[live] < depth)
        digit = digits[order[live], d]
        by = np.lexsort((digit, part))
        order[live], digit = order[live][by], digit[by]
        split = np.concatenate(([False], (digit[1:] != digit[:-1]) & (part[1:] == part[:-1])))
        shared[live[split]] = d
    return order, shared


def _words(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
    return raw, raw.view(">u8").astype(np.uint64)


def _sorted_side(rows: list[bytes], width: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, bytes shared with the row before, and most bytes shared with any row of the group."""
    width8 = -(-width // 8) * 8
    raw, words = _words(rows, width8)
    order, shared = msd_order(words, group)
    size = np.fromiter(map(len, rows), np.int64, len(rows))[order]
    lcp = np.full(len(rows), -1, np.int64)
    same = shared >= 0
    at = same.nonzero()[0]
    a, b = raw[order[at]], raw[order[at - 1]]
    differ = a != b
    exact = np.where(differ.any(axis=1), differ.argmax(axis=1), width8)
    lcp[at] = np.minimum(exact, np.minimum(size[at], size[at - 1]))
    most = np.empty(len(rows), np.int64)
    most[order] = np.maximum(lcp, np.concatenate((lcp[1:], [-1])))
    return order, lcp, most


def repeated_offsets(group: np.ndarray, left: list[bytes], right: list[bytes], window: int = WINDOW,
                     gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole groups: the smallest and largest ``i`` such that the window starting ``i``
    bytes before the anchor is that of another row too (-1: none). ``left`` is reversed."""
    n, reach = len(group), window - gram
    lo, hi = np.full(n, -1), np.full(n, -1)
    l_order, l_lcp, l_most = _sorted_side(left, reach, group)
    r_order, r_lcp, r_most = _sorted_side(right, window, group)
    l_size = np.fromiter(map(len, left), np.int64, n)
    r_size = np.fromiter(map(len, right), np.int64, n)
    possible = l_most + r_most >= window  # the others share too little with anyone

    def sweep(offsets, out: np.ndarray) -> None:
        open_ = possible.copy()
        for i in offsets:
            can = possible & (l_most >= i) & (r_most >= window - i) & (l_size >= i) & (r_size >= window - i)
            wanted = can & open_
            if not wanted.any():
                if not open_.any():
                    return
                continue
            l_class, r_class = np.empty(n, np.int64), np.empty(n, np.int64)
            l_class[l_order] = np.cumsum(l_lcp < i)
            r_class[r_order] = np.cumsum(r_lcp < window - i)
            busy = np.isin(group, group[wanted]) if n > 4 * wanted.sum() else np.ones(n, bool)
            rows = (can & busy).nonzero()[0]
            key = l_class[rows] * (n + 1) + r_class[rows]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            hit = rows[by[twice]]
            hit = hit[open_[hit]]
            out[hit] = i
            open_[hit] = False

    sweep(range(reach, -1, -1), hi)
    possible &= hi >= 0
    sweep(range(reach + 1), lo)
    return lo, hi


def _anchor_batches(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> (h, k1, k2, a), and h null for a span that repeats inside its own text."""
    reach = window - gram
    for b in batches:
        out = []
        for k1, k2, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            pos, h = anchors(np.frombuffer(text, np.uint8), window, gram)
            values, count = np.unique(h, return_counts=True)
            own = []
            if (count > 1).any():  # keep one anchor of those whose whole surroundings are equal
                seen: dict[int, list[int]] = {}
                view = memoryview(text)
                for k in np.isin(h, values[count > 1]).nonzero()[0].tolist():
                    p = int(pos[k])
                    if p >= reach and p + window <= len(text):
                        seen.setdefault(xxhash.xxh3_128_intdigest(view[p - reach:p + window]), []).append(k)
                drop = [k for ks in seen.values() for k in ks[1:]]
                own = [int(pos[k]) for ks in seen.values() if len(ks) > 1 for k in ks]
                pos, h = np.delete(pos, drop), np.delete(h, drop)
            out.append((np.concatenate((h.view(np.int64), np.zeros(len(own), np.int64))), np.concatenate((np.zeros(len(h), bool), np.ones(len(own), bool))),
                        np.full(len(h) + len(own), k1), np.full(len(h) + len(own), k2), np.concatenate((pos, np.array(own, np.int64)))))
        if out:
            h, none, k1, k2, a = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64(), mask=none), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(a, pa.int64())],
                                             names=["h", "k1", "k2", "a"])


def _context_batches(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, at) -> one row an anchor with the bytes on both sides; the left ones reversed."""
    reach = window - gram
    for b in batches:
        for k1, k2, text, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            rows = [(x["h"], k1, k2, x["a"], text[max(0, x["a"] - reach):x["a"]][::-1], text[x["a"]:x["a"] + window]) for x in at]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.binary(),) * 2, strict=True)],
                                             names=["h", "k1", "k2", "a", "l", "r"])


def _span_batches(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by h -> spans (k1, k2, s, e)."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h = t.column("h").to_numpy()
        lo, hi = repeated_offsets(h, t.column("l").to_pylist(), t.column("r").to_pylist(), window, gram)
        hit = hi >= 0
        a = t.column("a").to_numpy()[hit]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(t.column(k).to_numpy()[hit]) for k in ("k1", "k2")]
                                             + [pa.array(a - hi[hit]), pa.array(a - lo[hit] + window)], names=["k1", "k2", "s", "e"])

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS:
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield from solve(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                rows = t.num_rows - cut
    if rows:
        yield from solve(pa.Table.from_batches(held))


def _digest_batches(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text, at) -> digest and start of every window that holds one of the anchors ``at``."""
    reach, two = window - gram, 1 << 63
    for b in batches:
        for k1, k2, text, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            starts = sorted({s for x in at for s in range(max(0, x["a"] - reach), min(x["a"], len(text) - window) + 1)})
            view = memoryview(text)
            d = [xxhash.xxh3_128_intdigest(view[s:s + window]) for s in starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(x >> 64) - two for x in d], pa.int64()), pa.array([(x & (2 * two - 1)) - two for x in d], pa.int64()),
                 pa.array([k1] * len(d), pa.int64()), pa.array([k2] * len(d), pa.int64()), pa.array(starts, pa.int64())],
                names=["d1", "d2", "k1", "k2", "s"])


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def text_key(text: str = "text") -> list[Column]:
    """128-bit key of a text as two columns ``k1`` and ``k2``."""
    data = utf8(text)
    return [F.xxhash64(data).alias("k1"), F.xxhash64(F.lit(1), data).alias("k2")]


def repeated_spans(df: DataFrame, text: str = "text", window: int = WINDOW, hot: int = HOT, gram: int = GRAM) -> DataFrame:
    """One row per distinct text of ``window`` bytes or more: (k1, k2, text as bytes, spans), ``spans``
    being the maximal runs (s, e) of repeated bytes in order; empty where nothing repeats."""
    spark = df.sparkSession
    scratch = Scratch(spark, "repeats")
    n = partitions(df)
    data = df.select(*text_key(text), utf8(text).alias("text")).where(F.octet_length("text") >= window)
    distinct = data.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    name = f"repeats_{scratch.path[-12:]}"
    (distinct.write.option("path", f"{scratch.path}/texts").option("compression", "zstd")
     .bucketBy(n, "k1", "k2").saveAsTable(name))
    texts = spark.table(name)
    found = scratch.keep(map_batches(texts.select("k1", "k2", "text"), partial(_anchor_batches, window=window, gram=gram), "h long, k1 long, k2 long, a long"))
    shared = found.where("h is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    alike = found.join(shared, "h").groupBy("k1", "k2").agg(
        F.collect_list(F.when(F.col("n") <= hot, F.struct("a", "h"))).alias("few"),
        F.collect_list(F.when(F.col("n") > hot, F.struct("a", "h"))).alias("many"))
    alike = scratch.keep(alike)
    at = lambda kind: texts.join(alike.where(F.size(kind) > 0), ["k1", "k2"]).select("k1", "k2", "text", kind)
    contexts = map_batches(at("few"), partial(_context_batches, window=window, gram=gram), "h long, k1 long, k2 long, a long, l binary, r binary")
    spans = map_batches(contexts.repartition(n, "h").sortWithinPartitions("h"), partial(_span_batches, window=window, gram=gram), "k1 long, k2 long, s long, e long")
    spans = spans.union(found.where("h is null").select("k1", "k2", (F.col("a") - (window - gram)).alias("s"), (F.col("a") + window).alias("e")))
    if not alike.where(F.size("many") > 0).isEmpty():
        digests = scratch.keep(map_batches(at("many"), partial(_digest_batches, window=window, gram=gram), "d1 long, d2 long, k1 long, k2 long, s long"))
        place = F.struct("k1", "k2", "s")
        twice = digests.groupBy("d1", "d2").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("d1", "d2")
        spans = spans.union(digests.join(twice, ["d1", "d2"], "left_semi").select("k1", "k2", "s", (F.col("s") + window).alias("e")))
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = scratch.keep(map_batches(spans, _merge_batches, "k1 long, k2 long, spans array<struct<s:long,e:long>>"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.octet_length("text").cast("long").alias("e")))
    spark.sql(f"DROP TABLE {name}")  # the entry only; the files stay for what reads them
    return texts.join(spans, ["k1", "k2"], "left").select(
        "k1", "k2", "text", F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<s:long,e:long>>"))).alias("spans"))


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for b in batches:
        merged = [[{"s": s, "e": e} for s, e in merge_spans([(x["s"], x["e"]) for x in row])] for row in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(merged, kind)], names=["k1", "k2", "spans"])


def _kept_batches(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[(x["s"], x["e"]) for x in row] for row in b.column(3).to_pylist()]
        kept = [cut(t, s) for t, s in zip(b.column(2).to_pylist(), spans, strict=True)]
        last = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sum(e - s for s, e in x) for x in spans], pa.int64()), pa.array([len(x) for x in spans], pa.int64()), last],
                                         names=["k1", "k2", "n_removed", "n_spans", "kept"])


def kept_texts(spans: DataFrame, digest: bool = False) -> DataFrame:
    """From ``repeated_spans``: (k1, k2, n_removed, n_spans, kept), ``kept`` being the remaining bytes,
    or their SHA-256 in hex with ``digest``."""
    kind = "string" if digest else "binary"
    return map_batches(spans, partial(_kept_batches, digest=digest), f"k1 long, k2 long, n_removed long, n_spans long, kept {kind}")


def without_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``df`` with the bytes of repeated windows cut out of ``text``; a character that a cut goes through goes whole."""
    spans = repeated_spans(df, text, window, gram=gram).where(F.size("spans") > 0)
    kept = Scratch(df.sparkSession, "kept").keep(kept_texts(spans).select("k1", "k2", F.col("kept").alias("__kept")))
    k1, k2 = text_key(f"`{text}`")
    keyed = df.select("*", k1.alias("__k1"), k2.alias("__k2"))
    joined = keyed.join(kept.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left")
    left = F.when(F.col("__kept").isNull(), F.col(f"`{text}`")).otherwise(_characters(F.col("__kept")))
    return joined.select(*[left.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def _characters(data: Column) -> Column:
    """Bytes as text, without what is no whole character."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))
