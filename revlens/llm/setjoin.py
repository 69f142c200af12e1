"""Jaccard join of shingle sets, with skips by what is known of positions and of similar sets.

Two sets link when their shared part is at least ``percent`` % of their union: exactly when they differ in
at most (100 - percent) / (100 + percent) of their added sizes. Every set's shingles are ordered by (count of the
shingle's bucket over the corpus, shingle), rarest first; linked sets share a shingle among the first few
of that order, their prefixes. Only prefixes are indexed.

* Skips by position. A list of one shingle is ordered by the position it has in its sets, then by set
  size: blocks of equal position. What is left of two sets after that position bounds what they can share,
  so a probe leaves a block at the first set too large for it and leaves the list at the first block that is too
  late. Pairs that pass are held against a 256-bit parity sketch: every shingle flips one bit, so
  sketches differ in no more bits than sets differ in shingles.
* Skips by similar sets. Sets that agree on two min-hashes are held against the most central set of their
  group, the one whose shingles are most frequent on average (an original rather than an edited copy).
  A verified neighbour of such a leader follows it: the leader's answers stand for it, so only the prefix
  shingles that the leader lacks are probed for it, under the leader's name. Entries of a leader cover the
  sizes and the differences of all its followers, so a pair of classes that passes is a superset of the
  pairs of their members. Leaders are compared first. Where their shared part and the members' known
  differences leave a link possible, the members of these classes are indexed by themselves, and only members
  that nothing connects yet meet.

All bounds err on the safe side and every link is verified on whole sets, so links connect exactly what
the definition connects. Classes need no pairs among their members, equal sets are one set from the start.

Scale: distinct texts are written once, bucketed by key; sets are made from them where they are needed, never
shuffled. The order comes from a table of ``1 << ORDER`` counts, summed map-side. Lists of over ``PART`` entries
are cut into parts that meet pairwise in tasks of their own, so none is one task's work. Near copies
that are too different to link meet only in a list's arithmetic, not as pairs that are written.

Shingles are 64-bit hashes. Defined cases: null or wordless text -> no shingles, linked with nothing, a
component of its own; fewer words than a shingle -> the whole sequence is one; null ids never name a
component unless all its ids are null; repeated rows each get their row; no rows -> no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import Scratch, by_size, map_batches, partitions, text_keys, utf8
from revlens.llm.components import components

PERCENT, WIDTH = 90, 3
ORDER = 18  # bits of the table of counts
BANDS = 4  # pairs of min-hashes
PART = 4096  # entries of a list that meet in one task
SKETCH = 4  # words of a parity sketch
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * odd
    return h ^ (h >> np.uint64(29))


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, ascending, of a text given as UTF-8: A-Z lowered, split at ASCII white space."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:  # never equal to a longer sequence, whose hash mixes ``width`` words
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - width + 1
    h = w[:n].copy()
    for k in range(1, width):
        h = _mix(h, ODD[0]) + w[k:k + n] * ODD[k % 4]
    return np.unique(_mix(h, ODD[1]))


def least_shared(total: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that linked sets of ``total`` shingles in all share at least."""
    return -(-percent * total // (100 + percent))


def linked(shared: Column, total: Column, percent: int) -> Column:
    return 100 * shared >= percent * (total - shared)


class Order:
    """The common order of shingles and what it says of one set."""

    def __init__(self, counts: np.ndarray, percent: int, part: int = PART):
        self.counts, self.percent, self.part = counts, percent, part
        self.shift = np.uint64(64 - int(len(counts)).bit_length() + 1)

    def count_of(self, s: np.ndarray) -> np.ndarray:
        return self.counts[(s >> self.shift).astype(np.int64)]

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set and the counts of their buckets."""
        count = self.count_of(s)
        take = len(s) - (self.percent * len(s) + 99) // 100 + 1
        first = np.lexsort((s, count))[:take] if take < len(s) else np.lexsort((s, count))
        return s[first], count[first]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch: bit ``b`` says whether an odd number of shingles fall on it."""
    bits = np.bincount((_mix(s, ODD[2]) >> np.uint64(56)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _bands(s: np.ndarray) -> list[int]:
    """Keys of the leader search: each mixes two min-hashes."""
    low = np.array([[_mix(s ^ (ODD[k] << np.uint64(j)), ODD[3 - j]).min() for j in (1, 2)] for k in range(BANDS)], np.uint64)
    return (_mix(low[:, 0], ODD[0]) ^ low[:, 1] * ODD[1]).view(np.int64).tolist()


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> a row a text, and at the end the counts of the task's shingles by bucket."""
    counts = np.zeros(1 << ORDER, np.int64)
    names = ["k1", "k2", "n", "s1", "s2", "bands", "bucket", "seen"]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    for b in by_size(batches, 2):
        rows = []
        for data in b.column(2).to_pylist():
            s = shingles(data, width)
            if not len(s):
                rows.append((0, 0, 0, None))
                continue
            np.add.at(counts, (s >> np.uint64(64 - ORDER)).astype(np.int64), 1)
            d = xxhash.xxh3_128_digest(s.tobytes())
            rows.append((len(s), *np.frombuffer(d, np.int64).tolist(), _bands(s)))
        n, s1, s2, bands = zip(*rows, strict=True)
        none = [None] * len(rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                                          pa.array(bands, longs), pa.array(none, ints), pa.array(none, ints)], names=names)
    at = counts.nonzero()[0]
    for i in range(0, len(at), 1 << 14):
        part = at[i:i + (1 << 14)]
        nothing = [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), longs)]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([part], ints), pa.array([counts[part]], ints)], names=names)


def _central(batches: Iterator[pa.RecordBatch], order: Order, width: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, score): how frequent a set's shingles are on average (of the logarithm)."""
    for b in by_size(batches, 1):
        found = [shingles(x, width) for x in b.column(1).to_pylist()]
        score = [int(1e6 * np.log2(1 + order.count_of(s)).mean()) for s in found]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.int64())], names=["id", "score"])


def _entries(batches: Iterator[pa.RecordBatch], order: Order, width: int) -> Iterator[pa.RecordBatch]:
    """(id, key, lo, hi, gap, text) -> index entries, one a prefix shingle. A class with followers stands at
    position 0, as its members' positions differ from its leader's. Entries of equal ``key`` don't meet."""
    for b in by_size(batches, 5, 1 << 20):
        out = []
        for i, key, lo, hi, gap, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            s = shingles(data, width)
            first, count = order.prefix(s)
            n = len(first)
            pos = np.arange(n, dtype=np.int32) if gap == 0 else np.zeros(n, np.int32)
            out.append((first.view(np.int64), count > order.part, np.full(n, i), np.full(n, key), np.full(n, lo, np.int32), np.full(n, hi, np.int32), np.full(n, gap, np.int32), pos, np.tile(sketch(s), (n, 1))))
        yield _entry_batch([np.concatenate(x) for x in zip(*out, strict=True)])


ENTRY = "token long, often boolean, id long, key long, lo int, hi int, gap int, pos int, w0 long, w1 long, w2 long, w3 long"


def _entry_batch(c: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in c[:8]] + [pa.array(np.ascontiguousarray(c[8][:, k])) for k in range(SKETCH)],
                                      names=[x.split()[0] for x in ENTRY.split(", ")])


def _compare(batches: Iterator[pa.RecordBatch], order: Order, width: int, fresh: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> what the sets share and, if ``fresh``, a's prefix shingles that b's prefix lacks."""
    last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for b in by_size(batches, 2):
        rows = []
        for i, j, x, y in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if j != last[0]:
                last = (j, shingles(y, width))
            s, t = shingles(x, width), last[1]
            shared = len(np.intersect1d(s, t, assume_unique=True))
            new, often, marks = [], [], []
            if fresh and 100 * shared >= order.percent * (len(s) + len(t) - shared):
                first, count = order.prefix(s)
                other = ~np.isin(first, order.prefix(t)[0])
                new, often = first[other].view(np.int64).tolist(), (count[other] > order.part).tolist()
                marks = sketch(t).tolist()
            rows.append((i, j, len(s), len(t), shared, new, often, marks))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                         names=["a", "b", "na", "nb", "shared", "new", "often", "marks"])


def probe(token: np.ndarray, side: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, gap: np.ndarray, pos: np.ndarray,
          marks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of one token) that may link. Rows are sorted by (token, pos, lo); ``side`` is the part
    of a long list: -1 in a list that was not cut or in a part met by itself, else rows meet only the other part.

    All probes advance together, each by one step: on to the next row, to the next block, or out of the list.
    With total size s, linked sets share ceil(p s / (100 + p)) or more; a set whose ``pos`` first shingles are
    known not to be shared has ``hi - pos`` left."""
    n = len(token)
    p, q = percent, 100 + percent
    new_block = np.concatenate((token[1:] != token[:-1], [True])) | np.concatenate((pos[1:] != pos[:-1], [True]))
    ends = new_block.nonzero()[0] + 1
    after = ends[np.searchsorted(ends, np.arange(n), side="right")]  # first row of the next block
    lo, hi, gap, pos = (x.astype(np.int64) for x in (lo, hi, gap, pos))
    # the largest size that a partner can have: by size alone, and by what is left of this set
    most = np.minimum(100 * hi // p, (q * (hi - pos) - p * lo) // p)
    probes, at = np.arange(n), np.arange(1, n + 1)
    out_a, out_b = [], []
    while len(probes):
        inside = at < n
        probes, at = probes[inside], at[inside]
        here = (token[at] == token[probes]) & ((q * pos[at] + p * lo[probes]) <= 100 * most[probes])  # later blocks: later still
        probes, at = probes[here], at[here]
        if not len(probes):
            break
        block_over = lo[at] > most[probes]  # later rows of this block are larger still
        total = lo[at] + lo[probes]
        fits = ~block_over & (100 * hi[at] >= p * lo[probes]) & (hi[at] - pos[at] >= -(-p * total // q))
        fits &= (side[at] < 0) | (side[at] != side[probes])
        a, b = probes[fits], at[fits]
        if len(a):
            apart = np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int64) - gap[a] - gap[b]
            near = (apart * q <= (hi[a] + hi[b]) * (100 - p)) & (key[a] != key[b])
            out_a.append(a[near])
            out_b.append(b[near])
        at = np.where(block_over, after[at], at + 1)
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _pairs(batches: Iterator[pa.RecordBatch], percent: int, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (token, parts met, pos, lo) -> candidate pairs of ids, smaller first, each once a run."""

    def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = {k: t.column(k).to_numpy() for k in t.column_names if k[0] != "w"}
        marks = np.stack([t.column(f"w{k}").to_numpy().view(np.uint64) for k in range(SKETCH)], axis=1)
        group = np.cumsum(np.concatenate(([True], (c["token"][1:] != c["token"][:-1]) | (c["met"][1:] != c["met"][:-1]))))
        alone = np.bincount(group)[group] == 1
        use = ~alone
        if not use.any():
            return
        a, b = probe(group[use], c["side"][use], c["key"][use], *(c[k][use] for k in ("lo", "hi", "gap", "pos")), marks[use], percent)
        if len(a):
            ids = c["id"][use]
            both = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    held, many = [], 0
    for b in batches:
        held.append(b)
        many += b.num_rows
        if many >= rows:
            t = pa.Table.from_batches(held)
            token, met = t.column("token").to_numpy(), t.column("met").to_numpy()
            last = int(((token == token[-1]) & (met == met[-1])).argmax())  # this list may go on
            if last:
                yield from close(t.slice(0, last))
                held = t.slice(last).combine_chunks().to_batches()
                many = t.num_rows - last
    if many:
        yield from close(pa.Table.from_batches(held))


@dataclass
class Similar:
    """What a join found. ``texts``: (k1, k2, n, id), a row a distinct text, ``id`` naming its set (null if it
    has no shingles). ``links``: (a, b, shared, total), verified links between sets, enough to connect each
    component (never all pairs of a class). ``roots``: (u, v), every set that is not its component's smallest."""

    texts: DataFrame
    links: DataFrame
    roots: DataFrame


def similar_sets(df: DataFrame, text: str = "text", percent: int = PERCENT, width: int = WIDTH, part: int = PART) -> Similar:
    """Join the sets of all texts of ``df``."""
    spark = df.sparkSession
    scratch, rounds, n = Scratch(spark, "setjoin"), Scratch(spark, "setjoin-rounds"), partitions(df)
    data = df.select(*text_keys(f"`{text}`"), utf8(f"`{text}`").alias("text"))
    name = f"setjoin_{uuid.uuid4().hex[:12]}"
    (data.groupBy("k1", "k2").agg(F.first("text").alias("text")).write.option("path", f"{scratch.path}/texts")
     .option("compression", "zstd").bucketBy(n, "k1", "k2").saveAsTable(name))
    stored = spark.table(name)
    kind = "k1 long, k2 long, n int, s1 long, s2 long, bands array<long>, bucket array<int>, seen array<int>"
    described = scratch.keep(map_batches(stored.select("k1", "k2", "text"), partial(_describe, width=width), kind))
    order = _order(described, percent, part)

    # equal sets are one set, held by one of its texts
    rows = described.where("n > 0")
    one = rows.groupBy("s1", "s2").agg(F.min(F.struct("k1", "k2")).alias("t"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = scratch.keep(one.select("s1", "s2", "t.k1", "t.k2", "n", "bands", F.monotonically_increasing_id().alias("id")))
    own = sets.select("id", "k1", "k2")
    texts = described.where("k1 is not null").join(sets.select("s1", "s2", "id"), ["s1", "s2"], "left")
    texts = scratch.keep(texts.select("k1", "k2", "n", F.when(F.col("n") > 0, F.col("id")).alias("id")))

    def texts_of(ids: DataFrame) -> DataFrame:
        return scratch.keep(ids.distinct().join(own, "id").join(stored, ["k1", "k2"]).select("id", "text"))

    def compare(pairs: DataFrame, held: DataFrame, fresh: bool = False) -> DataFrame:
        """Each set's text once, then joins whose busy sets (a leader of many) Spark can split."""
        x = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        y = x.join(held.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        kind = "a long, b long, na int, nb int, shared int, new array<long>, often array<boolean>, marks array<long>"
        return scratch.keep(map_batches(y.select("a", "b", "x", "y"), partial(_compare, order=order, width=width, fresh=fresh), kind))

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))

    # leaders and followers
    filed = sets.select("id", "n", F.posexplode("bands").alias("band", "slot"))
    filed = scratch.keep(filed.join(filed.groupBy("band", "slot").agg(F.count("*").alias("many")).where("many > 1"), ["band", "slot"]))
    alike = texts_of(filed.select("id"))
    scores = scratch.keep(map_batches(alike, partial(_central, order=order, width=width), "id long, score long"))
    heads = scratch.keep(filed.join(scores, "id").groupBy("band", "slot").agg(F.max(F.struct("score", "id", "n")).alias("head")))
    tried = filed.join(heads, ["band", "slot"]).where(F.col("id") != F.col("head.id"))
    fair = 100 * F.least("n", "head.n") >= percent * F.greatest("n", "head.n")
    tried = scratch.keep(tried.where(fair).select(F.col("id").alias("a"), F.col("head.id").alias("b")).distinct())
    stars = compare(tried, alike, fresh=True)
    stars = stars.where(linked(F.col("shared"), F.col("na") + F.col("nb"), percent))
    led = stars.select(F.col("a").alias("b")).distinct()
    follow = stars.join(led, "b", "left_anti").groupBy("a").agg(F.min(F.struct("b", "na", "nb", "shared", "new", "often", "marks")).alias("f")).select("a", "f.*")
    follow = scratch.keep(follow)
    classes = follow.groupBy(F.col("b").alias("id")).agg(
        F.min(F.least("na", "nb")).alias("lo"), F.max(F.greatest("na", "nb")).alias("hi"),
        F.max(F.col("na") + F.col("nb") - 2 * F.col("shared")).alias("gap"), F.max(F.col("na") - F.col("shared")).alias("gain"))
    leaders = sets.join(follow.select(F.col("a").alias("id")), "id", "left_anti").join(classes, "id", "left").select(
        "id", "k1", "k2", "n", F.coalesce("lo", "n").alias("lo"), F.coalesce("hi", "n").alias("hi"),
        F.coalesce("gap", F.lit(0)).alias("gap"), F.coalesce("gain", F.lit(0)).alias("gain"))
    leaders = scratch.keep(leaders)

    # the index: leaders' prefixes, and what followers add to them under their leader's name
    held = leaders.join(stored, ["k1", "k2"]).select("id", F.col("id").alias("key"), "lo", "hi", "gap", "text")
    entries = map_batches(held, partial(_entries, order=order, width=width), ENTRY)
    added = follow.select(F.col("b").alias("id"), "marks", F.explode(F.arrays_zip("new", "often")).alias("e")).groupBy(
        "id", F.col("e.new").alias("token")).agg(F.first("e.often").alias("often"), F.first("marks").alias("m"))
    added = added.join(leaders.select("id", "lo", "hi", "gap"), "id").select(
        "token", "often", "id", F.col("id").alias("key"), "lo", "hi", "gap", F.lit(0).alias("pos"), *[F.col("m")[k].alias(f"w{k}") for k in range(SKETCH)])
    entries = scratch.keep(entries.unionByName(added))
    candidates = scratch.keep(_candidates(entries, percent, part, n))

    # leaders first; members only where they may still link and nothing connects them yet
    met = compare(candidates, texts_of(both(candidates)))
    known = ["a", "b", "shared", (F.col("na") + F.col("nb")).alias("total")]
    total = F.col("na") + F.col("nb")
    links = scratch.keep(stars.select(*known).union(met.where(linked(F.col("shared"), total, percent)).select(*known)))

    def connect() -> DataFrame:
        return scratch.keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), rounds))

    roots = connect()
    open_ = scratch.keep(_open_classes(met, leaders, roots, percent))
    if not open_.isEmpty():
        of = follow.select(F.col("b").alias("class"), F.col("a").alias("id"), F.col("na").alias("n")).union(leaders.select("id", "id", "n"))
        of = of.join(open_.select(F.col("id").alias("class")), "class", "left_semi").join(roots.select(F.col("u").alias("id"), "v"), "id", "left")
        of = of.select("id", F.coalesce("v", "id").alias("key"), F.col("n").alias("lo"), F.col("n").alias("hi"), F.lit(0).alias("gap"))
        own_text = of.join(own, "id").join(stored, ["k1", "k2"]).select("id", "key", "lo", "hi", "gap", "text")
        entries = scratch.keep(map_batches(own_text, partial(_entries, order=order, width=width), ENTRY))
        pairs = scratch.keep(_candidates(entries, percent, part, n))
        more = compare(pairs, texts_of(both(pairs)))
        links = scratch.keep(links.union(more.where(linked(F.col("shared"), total, percent)).select(*known)))
        roots = connect()
    rounds.drop()
    spark.sql(f"DROP TABLE {name}")  # the entry only; nothing reads the texts any more
    return Similar(texts, links, roots)


def _order(described: DataFrame, percent: int, part: int) -> Order:
    counts = np.zeros(1 << ORDER, np.int64)
    seen = described.where("bucket is not null").select(F.explode(F.arrays_zip("bucket", "seen")).alias("e"))
    table = seen.groupBy("e.bucket").agg(F.sum("e.seen").alias("seen")).toPandas()  # 1 << ORDER rows at most
    counts[table["bucket"].to_numpy(np.int64)] = table["seen"].to_numpy(np.int64)
    return Order(counts, percent, part)


def _candidates(entries: DataFrame, percent: int, part: int, n: int) -> DataFrame:
    """Distinct pairs (a, b) of classes that some list leaves possible."""
    # a list can't be longer than its bucket's count, so only shingles of frequent buckets are counted
    long = entries.where("often").groupBy("token").agg(F.count("*").alias("many")).where(F.col("many") > part)
    long = long.select("token", F.ceil(F.col("many") / part).cast("int").alias("parts"))
    whole = entries.where("not often").withColumns({"met": F.lit(0).cast("long"), "side": F.lit(-1)})
    some = entries.where("often").join(long, "token", "left")
    mine, last = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"), F.coalesce("parts", F.lit(1)) - 1
    some = some.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    pair = F.least("side", "other").cast("long") * (1 << 31) + F.greatest("side", "other")
    some = some.withColumn("met", pair).withColumn("side", F.when(F.col("side") == F.col("other"), F.lit(-1)).otherwise(F.col("side"))).drop("parts", "other")
    columns = ["token", "met", "side", "id", "key", "lo", "hi", "gap", "pos", *[f"w{k}" for k in range(SKETCH)]]
    dealt = whole.select(columns).union(some.select(columns)).repartition(n, "token", "met").sortWithinPartitions("token", "met", "pos", "lo")
    return map_batches(dealt, partial(_pairs, percent=percent), "a long, b long").distinct()


def _open_classes(met: DataFrame, leaders: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Ids of classes some of whose members may link across although their leaders don't."""
    size = leaders.select("id", "lo", "gain", "gap")
    a, b = (size.withColumnsRenamed({"id": x, "lo": f"{x}_lo", "gain": f"{x}_gain", "gap": f"{x}_gap"}) for x in "ab")
    open_ = met.where(~linked(F.col("shared"), F.col("na") + F.col("nb"), percent)).join(a, "a").join(b, "b")
    most = F.col("shared") + F.col("a_gain") + F.col("b_gain")
    open_ = open_.where((F.col("a_gap") + F.col("b_gap") > 0) & ((100 + percent) * most >= percent * (F.col("a_lo") + F.col("b_lo"))))
    for x in "ab":
        open_ = open_.join(roots.select(F.col("u").alias(x), F.col("v").alias(f"{x}_root")), x, "left")
    open_ = open_.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    return open_.select(F.col("a").alias("id")).union(open_.select("b")).distinct()


def components_of(df: DataFrame, found: Similar, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``df``: the smallest key reachable by links."""
    scratch = Scratch(df.sparkSession, "setjoin-rows")
    rows = df.select(F.col(f"`{key}`").alias(key), *text_keys(f"`{text}`"))
    named = found.texts.join(found.roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left")
    named = named.select("k1", "k2", "n", F.coalesce("root", "id").alias("root"))
    named = scratch.keep(named.join(rows.groupBy("k1", "k2").agg(F.min(key).alias("low")), ["k1", "k2"]))
    low = scratch.keep(named.where("root is not null").groupBy("root").agg(F.min("low").alias("low")))
    named = named.drop("low").join(low, "root", "left")
    return rows.join(named, ["k1", "k2"]).select(key, F.col("n").cast("long").alias("n_shingles"),
                                                 F.when(F.col("root").isNull(), F.col(key)).otherwise(F.col("low")).alias("component_id"))
