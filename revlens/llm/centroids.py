"""Centroid clustering (Lloyd's rounds, whole numbers) with Ptolemaic pivots.

In Euclidean space d(x,p) d(c,q) and d(x,q) d(c,p) differ by at most d(x,c) d(p,q) (Ptolemy), so the
distances of a vector and of a centroid to two pivots bound their own distance from below without a
look at the vector. Pivots are fixed once, among the starting centroids; each vector's pivot distances are
computed once and written beside it. A round computes only the centroids' pivot distances; per vector,
the centroid of the lowest bound is measured exactly, and just those whose bound, rounded down, doesn't
exceed it are measured too. Distances, sums and floors are exact whole numbers.

Scale: a round reads the written vectors once, and each task sends one row of sums and a count a
cluster; centroids (``clusters`` rows) are all the driver holds. No key is dealt out, so none is hot.

Defined cases: vectors that are null, of another number of components, or hold null or non-finite
components take no part; a null id is kept, and starts no centroid unless ids run out; equal distances go
to the smaller centroid; an empty cluster's centroid stays; fewer vectors than clusters give fewer
centroids; repeated rows count each; no vectors -> no rows. Components beyond ``MOST`` raise an error,
as their squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import Scratch, map_batches

CLUSTERS, ROUNDS, PIVOTS, SIZE, GRID = 40, 5, 5, 64, 256
MOST = 1 << 26  # of a component; 64 squared differences stay below 2^62
TIGHT = 1e-12  # relative rounding given away by every bound; doubles err by some 1e-15


def whole_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", size: int = SIZE, grid: int = GRID) -> DataFrame:
    """(id, v): vectors of ``size`` finite components as floor(grid * x)."""
    v = F.col(f"`{vector}`")
    fine = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * grid))
    return df.where(v.isNotNull() & fine).select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, n: int = CLUSTERS, seed: str = "2") -> np.ndarray:
    """The ``n`` vectors of smallest SHA-256 of ``<seed>:<id>``, in that order; equal ids by components."""
    name = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(n).collect()
    return np.array([r.v for r in rows], np.int64)


def spread_out(centroids: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` different centroids, each the farthest from those before."""
    chosen = [0]
    far = squared(centroids, centroids[:1])[:, 0]
    while len(chosen) < min(n, len(centroids)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(centroids, centroids[chosen[-1:]])[:, 0])
    return centroids[chosen]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to the few rows of ``b``."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


class Pivots:
    """Fixed pivots and the pairs whose bound is used."""

    def __init__(self, places: np.ndarray):
        self.places = places
        self.pairs = list(combinations(range(len(places)), 2))
        self.apart = np.sqrt(squared(places, places).astype(np.float64))

    def distances(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(rows, self.places).astype(np.float64))

    def below(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of rows and centroids, from their pivot distances, rounded down."""
        out = np.zeros((len(x), len(c)))
        for p, q in self.pairs:
            a, b = x[:, p, None] * c[None, :, q], x[:, q, None] * c[None, :, p]
            bound = (np.abs(a - b) - TIGHT * (a + b)) * ((1 - TIGHT) / self.apart[p, q])
            np.maximum(out, bound, out=out)
        return out


def nearest(v: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: Pivots, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each row, and how many distances were measured. ``near``
    and ``centre``: pivot distances of rows and centroids."""
    n = len(v)
    below = pivots.below(near, centre)
    below = below * below * (1 - TIGHT)
    first = below.argmin(axis=1)
    best = ((v - centroids[first]) ** 2).sum(axis=1)
    open_ = below <= best[:, None].astype(np.float64)
    open_[np.arange(n), first] = False
    found = np.full(below.shape, np.iinfo(np.int64).max)
    found[np.arange(n), first] = best
    for k in range(len(centroids)):
        rows = open_[:, k].nonzero()[0]
        found[rows, k] = ((v[rows] - centroids[k]) ** 2).sum(axis=1)
    at = found.argmin(axis=1)  # the smaller number on ties
    return at, found[np.arange(n), at], n + int(open_.sum())


def _rows(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


STEP = 2048


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            yield b.slice(at, STEP)


class Model:
    """Centroids of one round, as sent to the tasks."""

    def __init__(self, centroids: np.ndarray, pivots: Pivots):
        self.centroids, self.pivots, self.centre = centroids, pivots, pivots.distances(centroids)

    def assign(self, rows: DataFrame) -> DataFrame:
        """(id, cluster, distance) of a table of (id, v, near)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _steps(batches):
                at, far, _ = nearest(_rows(b.column(1), np.int64), _rows(b.column(2), np.float64), self.centroids, self.pivots, self.centre)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

        return map_batches(rows.select("id", "v", "near"), run, "id long, cluster int, distance long")

    def moved(self, rows: DataFrame) -> np.ndarray:
        """The next centroids: floors of the exact means."""
        k, size = self.centroids.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
            for b in _steps(batches):
                v = _rows(b.column(0), np.int64)
                at, _, _ = nearest(v, _rows(b.column(1), np.float64), self.centroids, self.pivots, self.centre)
                np.add.at(sums, at, v)
                n += np.bincount(at, minlength=k)
            used = n.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
                                             names=["cluster", "n", "sums"])

        parts = map_batches(rows.select("v", "near"), run, "cluster int, n long, sums array<long>")
        exact = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(
            F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        out = self.centroids.copy()
        for r in exact.collect():  # clusters x components
            out[r.cluster, r.i] = int(r.x) // r.n
        return out


def cluster(df: DataFrame, vector: str = "embedding", key: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            size: int = SIZE, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector after ``rounds`` rounds, and the final centroids."""
    spark = df.sparkSession
    scratch = Scratch(spark, "centroids")
    vectors = whole_vectors(df, vector, key, size)
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), centroids
    fixed = Pivots(spread_out(centroids, pivots))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            v = _rows(b.column(1), np.int64)
            if len(v) and np.abs(v).max() > MOST:
                raise ValueError(f"a component is beyond {MOST}: its squared distances do not fit 64 bits")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fixed.distances(v).tolist(), pa.list_(pa.float64()))],
                                             names=["id", "v", "near"])

    rows = scratch.keep(map_batches(vectors, measure, "id long, v array<long>, near array<double>"))
    model = Model(centroids, fixed)
    for _ in range(rounds):
        model = Model(model.moved(rows), fixed)
    return model.assign(rows), model.centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` (a written table) with the sums of distances and the digest of each centroid."""
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # one row a cluster
    every = assigned.agg(F.sum("distance")).first()[0] or 0
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    named = assigned.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    facts = own.join(F.broadcast(named), "cluster")
    return assigned.join(F.broadcast(facts), "cluster").withColumn("inertia", F.lit(every).cast("long"))
