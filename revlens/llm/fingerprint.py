"""Document fingerprints by prefix polynomial hashes.

For code points c_0, c_1, ... the prefix arrays hold sum(c_i * B^i) modulo two primes below 2^31. The
difference of two prefixes, divided by B^start, hashes any span, so two spans are compared in constant
time, and the longest common extension of two positions is found by binary search over its length.

The fingerprint keeps the length, the whole text's hash and the hashes of the spans at either end whose
lengths lie on a fixed geometric grid. Agreement on a longer span implies it on the shorter ones, so two
fingerprints locate their longest common prefix and suffix on that grid by binary search too. It also
keeps length and hash of every inner span: the text is cut after each window of ``WINDOW`` code points
whose own hash (from the prefix arrays) is a multiple of ``MEAN``, so cuts depend on the text around them
only and fall alike in near copies. The likeness of two fingerprints is the part of the longer text covered
by the two common ends and by the spans both share (equal spans pair 1:1), 1 just for equal texts. An edit
costs about the span it falls in.

``with_next`` brings each text and the one after it (ascending key) together with one shuffle of the
texts: rows are dealt into key ranges, streamed in order inside a range, and only the last text of a
range is joined to the first of the next (one row a range, the only thing broadcast).

Defined cases: null text counts as empty; two empty texts are equal (likeness 1), an empty and another
one share nothing (0); rows of equal key are ordered by a hash of their text; a single row is its own
next one; null keys come first; no rows -> no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import Scratch, code_points, key_ranges, map_batches, partitions

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Inner spans: window that decides a cut, mean and longest span, in code points; hex digits of a stored span.
WINDOW, MEAN, LONGEST, DIGITS = 8, 32, 255, 10


def _grid(limit: int = 1 << 40) -> list[int]:
    out = list(range(1, 9))
    while out[-1] < limit:
        out.append(out[-1] + out[-1] // 8)
    return out


GRID = _grid()
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo prime, grown by doubling and kept for the next text."""
    have = _POWERS.get((base, prime), np.ones(1, np.uint64))
    while len(have) < n:
        top = np.uint64(pow(base, len(have), prime))
        have = np.concatenate((have, have * top % np.uint64(prime)))
    _POWERS[base, prime] = have
    return have[:n]


class PrefixHash:
    """Prefix arrays of a text: span hashes in constant time, common extensions by binary search."""

    def __init__(self, text: str):
        c = code_points(text).astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.prefix = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            sums = np.cumsum(c * _powers(base, prime, self.n) % np.uint64(prime)) % np.uint64(prime)
            self.prefix.append(np.concatenate((np.zeros(1, np.uint64), sums)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end), the same for equal spans anywhere."""
        out = np.zeros(len(start), np.uint64)
        for h, base, prime in zip(self.prefix, BASES, PRIMES, strict=True):
            p = np.uint64(prime)
            back = _powers(pow(base, -1, prime), prime, self.n + 1)[start]
            out = (out << np.uint64(31)) | ((h[end] + p - h[start]) % p * back % p)
        return out

    def span(self, start: int, end: int) -> int:
        out = 0
        for h, base, prime in zip(self.prefix, BASES, PRIMES, strict=True):
            back = _powers(pow(base, -1, prime), prime, self.n + 1)
            out = (out << 31) | (int(h[end]) - int(h[start])) * int(back[start]) % prime
        return out

    def cuts(self) -> np.ndarray:
        """Content-defined cuts of the text, its two ends included; none further apart than ``LONGEST``."""
        inner = np.empty(0, np.int64)
        if self.n > WINDOW:
            h, p = self.prefix[0], np.uint64(PRIMES[0])
            back = _powers(pow(BASES[0], -1, PRIMES[0]), PRIMES[0], self.n + 1)
            window = (h[WINDOW:-1] + p - h[:-WINDOW - 1]) * back[:self.n - WINDOW] % p
            inner = (window % np.uint64(MEAN) == 0).nonzero()[0] + WINDOW
        at = np.concatenate(([0], inner, [self.n]))
        more = np.maximum(np.diff(at) - 1, 0) // LONGEST
        if more.any():
            first = np.repeat(np.cumsum(more) - more, more)
            far = np.repeat(at[:-1], more) + LONGEST * (np.arange(more.sum()) - first + 1)
            at = np.sort(np.concatenate((at, far)))
        return at

    def extension(self, at: int, other: PrefixHash, other_at: int) -> int:
        """Length of the longest common extension to the right of two positions."""
        low, high = 0, min(self.n - at, other.n - other_at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(at, at + mid) == other.span(other_at, other_at + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self) -> str:
        """``length:whole:prefix spans:suffix spans:inner spans`` in hex, spans cut to 32 bits, inner ones
        with two digits of length before."""
        size = np.array([g for g in GRID[:bisect_left(GRID, self.n + 1)]], np.int64)
        zero, end = np.zeros_like(size), np.full_like(size, self.n)
        ends = [self.spans(zero, size), self.spans(end - size, end)]
        cut = [e.astype(">u4").tobytes().hex() for e in ends]
        at = self.cuts()
        inner = np.empty(len(at) - 1, np.dtype([("length", "u1"), ("hash", ">u4")]))
        inner["length"], inner["hash"] = np.diff(at), self.spans(at[:-1], at[1:])
        return f"{self.n:x}:{self.span(0, self.n):016x}:{cut[0]}:{cut[1]}:{inner.tobytes().hex() if self.n else ''}"


def _shared(a: str, b: str) -> int:
    """Longest grid length at which the span hashes of two ends agree, by binary search."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        mid = (low + high + 1) // 2
        if a[8 * mid - 8:8 * mid] == b[8 * mid - 8:8 * mid]:
            low = mid
        else:
            high = mid - 1
    return GRID[low - 1] if low else 0


def _outside(spans: list[str], shared: set[str], start: int, end: int) -> dict[str, list[int]]:
    """For each shared span the lengths of its places between ``start`` and ``end``, longest first."""
    out: dict[str, list[int]] = {s: [] for s in shared}
    at = 0
    for s in spans:
        to = at + int(s[:2], 16)
        if s in shared and to > start and at < end:
            out[s].append(min(to, end) - max(at, start))
        at = to
    for lengths in out.values():
        lengths.sort(reverse=True)
    return out


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (n, _, ap, az, ai), (m, _, bp, bz, bi) = a.split(":"), b.split(":")
    n, m = int(n, 16), int(m, 16)
    short, long = sorted((n, m))
    head, tail = _shared(ap, bp), _shared(az, bz)
    both = min(head + tail, short)
    if both < short:
        of_a, of_b = ([x[k:k + DIGITS] for k in range(0, len(x), DIGITS)] for x in (ai, bi))
        if shared := set(of_a).intersection(of_b):
            in_a, in_b = _outside(of_a, shared, head, n - tail), _outside(of_b, shared, head, m - tail)
            both = min(both + sum(min(x, y) for s in shared for x, y in zip(in_a[s], in_b[s], strict=False)), short)
    return min(both / long, 1 - 2.0 ** -30) if long else 0.0


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first code points of the one that follows."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(df: DataFrame, run, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``run(key array, texts, next texts) -> arrays`` over every row and its successor by key."""
    n = partitions(df)
    source = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    tied = source.select("key", F.xxhash64("text").alias("tie"), "text")
    ranged = tied.select(key_ranges(source, "key", "tie", n).alias("part"), "key", "tie", "text")
    ordered = ranged.repartitionById(n, "part").sortWithinPartitions("part", "key", "tie", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            held = rows.slice(rows.num_rows - 1)
            part = rows.column("part").to_numpy()
            inside = (part[1:] == part[:-1]).nonzero()[0]
            texts = rows.column("text").to_pylist()
            if len(inside):
                yield run(rows.column("key").take(pa.array(inside)).combine_chunks(), [texts[k] for k in inside], [texts[k + 1] for k in inside])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield run(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist())

    # the last row of each range and the first of the next one that has rows; after the last, the first
    place = F.struct("key", "tie")
    ends = Scratch(df.sparkSession, "ends").keep(ranged.groupBy("part").agg(F.min(place).alias("a"), F.max(place).alias("z")))
    order = Window.orderBy("part")  # one row a range
    first = F.first("a").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select("part", "z", F.coalesce(F.lead("a").over(order), first).alias("a"))

    def text_of(side: str) -> DataFrame:
        few = F.broadcast(ends.select(F.col("part").alias("p"), F.col(f"{side}.key").alias("k"), F.col(f"{side}.tie").alias("t")))
        hit = ranged.join(few, ranged["key"].eqNullSafe(F.col("k")) & (ranged["tie"] == F.col("t")))
        return hit.select("p", "key", "text").dropDuplicates(["p"])

    seam = text_of("z").join(text_of("a").select("p", F.col("text").alias("next")), "p").select("key", "text", "next")
    return map_batches(ordered, stream, schema).union(map_batches(seam, pairs, schema))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likenesses; the exact
    common prefix of a text with its edited text and with the next one as ``lcp_edited``, ``lcp_next``."""
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lcp_edited", "lcp_next"]

    def run(keys: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
        out = []
        last: tuple[str, PrefixHash, str] | None = None
        for t, f in zip(texts, following, strict=True):
            one = last[1:] if last and last[0] == t else (h := PrefixHash(t), h.fingerprint())
            after = one if f == t else (h := PrefixHash(f), h.fingerprint())
            last = (f, *after)
            e = edited(t, f)
            new = one if e == t else (h := PrefixHash(e), h.fingerprint())
            out.append((one[0].n, hashlib.sha256(e.encode()).hexdigest(), one[1], new[1], likeness(one[1], new[1]), likeness(one[1], after[1]),
                        one[0].extension(0, new[0], 0), one[0].extension(0, after[0], 0)))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    kind = df.select(F.col(f"`{key}`").alias("key")).schema["key"].dataType.simpleString()
    schema = (f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double, lcp_edited long, lcp_next long")
    return with_next(df, run, schema, key, text).withColumnRenamed("key", key)
