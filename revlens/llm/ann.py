"""Approximate nearest neighbours by adaptive dimension scan over an inverted-file index.

Nearness is the largest inner product. Adding one coordinate, sqrt(M^2 - |x|^2) with M the largest norm,
turns it into the smallest Euclidean distance; a fixed random rotation then spreads every distance evenly
over the coordinates. k-means centres, fitted on a bounded sample, file every vector under one list. The
number of lists grows with the square root of the rows: beyond ``COARSE`` of them a cell is cut by a second
set of centres, of the vectors less their cell's centre, which all cells share. A query probes the lists
nearest to it: as many as hold ``TARGET`` of the true neighbours, among all rows, of ``ASKED`` sample vectors.

A probed list is scanned in column blocks. After each block a candidate's distance is estimated from
the coordinates seen so far, and a hypothesis test drops it when the estimate, less its error bound, is
already beyond the query's current k-th distance. Survivors are scored by the exact inner product in
double precision.

Scale: lists are cut into parts of at most ``PART`` vectors, so a list with a third of all vectors is many
tasks' work; a task holds one part and streams the queries that probe it. Only the centres and one
number a list (at most ``COARSE`` times an eighth of the sample) are broadcast; each part returns at most k
rows a query. Lists and probed neighbourhoods being measured on all rows, a query's work grows with the
square root of the rows, not with the rows.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do
rows without an id or with another number of components than most; a query has its own row (by id) left
out; equal scores are ranked by id; fewer candidates than k give fewer rows; repeated rows are candidates
each. More columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import Scratch, map_batches, partitions

#: Bounds and targets of the fit.
SAMPLE, COARSE, TARGET, ASKED = 16_384, 1024, 0.97, 256
PART, STEPS, EPSILON, SEED = 4096, (16, 32, 48), 2.1, 7


def usable(vector: str, key: str) -> Column:
    """Rows that take part (their number of components aside)."""
    v = F.col(vector)
    return (F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def _means(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres, eight rounds."""
    centres = x[rng.permutation(len(x))[:lists]]
    for _ in range(8):
        at = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    far = (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.argmin(far, axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]


class Index:
    """Rotation, centres (rotated) of cells and inside cells, and the numbers of cells and lists a query probes."""

    def __init__(self, sample: np.ndarray, largest: float, rows: int, coarse: int = COARSE):
        rng = np.random.default_rng(SEED)
        self.largest = largest
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.float32)
        x = self.place(sample)
        lists, most = max(1, int(np.sqrt(rows) / 3)), max(1, len(x) // 8)
        self.centres = _means(x, min(lists, coarse, most), rng)
        inside = min(-(-lists // len(self.centres)), most) if lists > coarse else 1
        rest = x - self.centres[nearest(x, self.centres, 1)[:, 0]]
        self.inner = _means(rest, inside, rng) if inside > 1 else np.zeros((1, d), np.float32)
        # squared distance of q to centre c + i, but for |q - c|^2 and -2 q i
        self.cross = 2 * self.centres @ self.inner.T + (self.inner * self.inner).sum(axis=1)[None, :]
        self.cells, self.probes = len(self.centres), self.lists

    @property
    def lists(self) -> int:
        return len(self.centres) * len(self.inner)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Vectors with their added coordinate, rotated."""
        norm = np.einsum("ij,ij->i", x, x, dtype=np.float64)
        extra = np.sqrt(np.maximum(self.largest ** 2 - norm, 0))
        return np.concatenate((x, extra[:, None]), axis=1).astype(np.float32) @ self.rotation

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate((q, np.zeros((len(q), 1))), axis=1).astype(np.float32) @ self.rotation

    def home(self, x: np.ndarray) -> np.ndarray:
        """The list of each placed vector."""
        cell = nearest(x, self.centres, 1)[:, 0]
        if len(self.inner) == 1:
            return cell
        return cell * len(self.inner) + nearest(x - self.centres[cell], self.inner, 1)[:, 0]

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The lists each placed query probes, nearest first, of its nearest cells."""
        if len(self.inner) == 1:
            return nearest(q, self.centres, self.probes)
        far = (self.centres * self.centres).sum(axis=1)[None, :] - 2 * q @ self.centres.T
        cells = np.argsort(far, axis=1, kind="stable")[:, :self.cells]
        turned = -2 * q @ self.inner.T
        out = np.empty((len(q), min(self.probes, self.cells * len(self.inner))), np.int64)
        for i, c in enumerate(cells):
            near = (far[i, c][:, None] + turned[i][None, :] + self.cross[c]).ravel()
            best = np.argsort(near, kind="stable")[:out.shape[1]]
            out[i] = c[best // len(self.inner)] * len(self.inner) + best % len(self.inner)
        return out

    def aim(self, asked: np.ndarray, neighbours: list[np.ndarray]) -> None:
        """Probe as many cells and lists as hold ``TARGET`` of the neighbours' lists, given for each asked vector."""
        many = [len(x) for x in neighbours]
        if not sum(many):
            return
        lists, row = np.concatenate(neighbours), np.repeat(np.arange(len(asked)), many)
        q, inside = self.query(asked), len(self.inner)

        def depth(order: np.ndarray, wanted: np.ndarray, part: float) -> int:
            rank = np.empty((len(order), order.max() + 1), np.int64)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
            deep = np.sort(rank[row, wanted])
            return int(deep[min(len(deep) - 1, int(np.ceil(part * len(deep))))]) + 1

        self.cells = depth(nearest(q, self.centres, len(self.centres)), lists // inside, TARGET if inside == 1 else (1 + TARGET) / 2)
        self.probes = self.cells
        if inside > 1:
            self.probes = self.cells * inside
            ranks = []
            for i, order in enumerate(self.probed(q)):  # a neighbour outside the cells counts as missed
                place = {int(x): n for n, x in enumerate(order)}
                ranks += [place.get(int(x), len(order)) for x in neighbours[i]]
            ranks = np.sort(ranks)
            self.probes = min(self.probes, int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1)


def fit(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 20, sample: int = SAMPLE, coarse: int = COARSE) -> Index | None:
    """Fit on at most ``sample`` vectors, chosen by a hash of their id; probes are set by all rows."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, largest = vectors.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return None
    rows = vectors.select(key, vector).orderBy(F.xxhash64(key), key).limit(sample).collect()
    x = np.array([r[1] for r in rows], np.float64)
    index = Index(x, float(largest), n, coarse)
    some = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
    near = true_neighbours(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")),
                           np.array([rows[i][0] for i in some]), x[some], k, lambda v: index.home(index.place(v)))
    index.aim(x[some], near)
    return index


def true_neighbours(rows: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, home: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """``home`` of the k rows of largest inner product with each of a few vectors, their own ids left out: every
    row is read once, a task returns at most k rows a vector."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, at = np.empty((len(asked), 0)), np.empty((len(asked), 0), np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                v = _matrix(part.column(1), np.float64)
                new = asked @ v.T
                new[part.column(0).to_numpy()[None, :] == ids[:, None]] = -np.inf
                score = np.concatenate((score, new), axis=1)
                at = np.concatenate((at, np.broadcast_to(home(v), new.shape)), axis=1)
                if score.shape[1] > k:
                    keep = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, at = np.take_along_axis(score, keep, axis=1), np.take_along_axis(at, keep, axis=1)
        q, c = np.isfinite(score).nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score[q, c], pa.float64()), pa.array(at[q, c], pa.int64())], names=["q", "score", "at"])

    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "at"))
    found = map_batches(rows, best, "q int, score double, at long").withColumn("n", first).where(F.col("n") <= k)
    by = found.groupBy("q").agg(F.collect_list("at").alias("at"))  # k of each of the few vectors
    lists = {r["q"]: r["at"] for r in by.collect()}
    return [np.array(lists.get(i, []), np.int64) for i in range(len(asked))]


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def scan(q: np.ndarray, original: np.ndarray, own: int, x: np.ndarray, sums: list[np.ndarray], vectors: np.ndarray, ids: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the best k of one part for a query. ``x``: rotated vectors; ``sums``: their
    squared lengths up to each step."""
    d = x.shape[1]
    steps = [*[s for s in STEPS if s < d], d]
    alive = (ids != own).nonzero()[0]
    seen = np.cumsum(q * q)
    first = alive[:4 * k]  # gives the first bound
    whole = ((x[first] - q) ** 2).sum(axis=1)
    bound = np.partition(whole, k - 1)[k - 1] if len(first) > k else np.inf
    past = np.zeros(len(alive), np.float32)
    for a, b in pairwise([0, *steps]):
        past = past + (x[alive, a:b] if len(alive) < len(x) else x[:, a:b]) @ q[a:b]
        near = sums[steps.index(b)][alive] + seen[b - 1] - 2 * past  # squared distance over the first b
        if b == d:
            limit = bound if len(alive) <= k else min(bound, np.partition(near, k - 1)[k - 1])
            slack = 1e-4 * (1 + abs(limit)) if np.isfinite(limit) else 0
            alive = alive[near <= limit + slack]
        else:
            keep = near * (d / b) <= bound * (1 + EPSILON / np.sqrt(b)) ** 2
            alive, past = alive[keep], past[keep]
    exact = (vectors[alive] * original).sum(axis=1)
    best = np.lexsort((ids[alive], -exact))[:k]
    return ids[alive][best], exact[best]


def search(vectors: DataFrame, queries: Column, index: Index | None = None, vector: str = "embedding", key: str = "vec_id",
           k: int = 20, part: int = PART, coarse: int = COARSE) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` found for each row on which ``queries`` holds."""
    out = "query_id long, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector, key)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("ask"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    rows = rows.where(F.size("v") == common["d"])
    index = index or fit(rows, "v", "id", k, coarse=coarse)
    scratch = Scratch(spark, "lists")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), np.float64)
            x = index.place(v)
            home = index.home(x)
            ask = b.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            lists = np.full(len(ask), None, object)
            for i, p in zip(ask.nonzero()[0].tolist(), index.probed(index.query(v[ask])), strict=True):
                lists[i] = p
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home, pa.int32()), pa.array(lists.tolist(), pa.list_(pa.int32()))],
                                             names=["id", "v", "list", "probes"])

    filed = scratch.keep(map_batches(rows, file, "id long, v array<double>, list int, probes array<int>"))
    sizes = filed.groupBy("list").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))  # one row a list
    data = filed.join(F.broadcast(sizes), "list").select(
        "list", F.pmod(F.monotonically_increasing_id(), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "id", "v")
    asked = (filed.where("probes is not null").select("id", "v", F.explode("probes").alias("list")).join(F.broadcast(sizes), "list")
             .select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "v"))
    met = data.union(asked).repartition(partitions(vectors), "list", "part").sortWithinPartitions("list", "part", "kind")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vs = None, [], []
        ready = None
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *((place[1:] != place[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(place)]
            v, i = _matrix(b.column(4), np.float64), b.column(3).to_numpy()
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            for s, e in pairwise(cuts):
                if (place[s, 0], place[s, 1]) != at:
                    at, ids, vs, ready = (place[s, 0], place[s, 1]), [], [], None
                if place[s, 2] == 0:
                    ids.append(i[s:e])
                    vs.append(v[s:e])
                    continue
                if ready is None:
                    if not ids:
                        continue
                    w = np.concatenate(vs)
                    x = index.place(w)
                    squares = np.cumsum(x * x, axis=1)
                    steps = [*[t for t in STEPS if t < x.shape[1]], x.shape[1]]
                    ready = (x, [squares[:, t - 1] for t in steps], w, np.concatenate(ids))
                turned = index.query(v[s:e])
                for n in range(e - s):
                    found.append((int(i[s + n]), *scan(turned[n], v[s + n], int(i[s + n]), *ready, k)))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                     pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(np.concatenate([f[2] for f in found]), pa.float64())],
                    names=["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = map_batches(met, find, out)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
