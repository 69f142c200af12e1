import hashlib
import math

import numpy as np
import pytest

from revlens.llm import centroids


def vectors(seed=3, n=300):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, 64))
    rows = [(i, (middle[i % 6] + rng.standard_normal(64) * 0.3).tolist()) for i in range(n)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [None]), (1004, [float("nan")] * 64),
             (1005, [0.5] * 63 + [float("inf")]), (1006, [0.0] * 64), (1007, [0.0] * 64), (5, rows[5][1]), (None, rows[7][1])]
    return rows


def brute(rows, clusters, rounds, size=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))
    c = [v for _, v in start[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        best = [min((far(v, m), k) for k, m in enumerate(c)) for _, v in kept]
        if r == rounds:
            return sorted((i is None, i or 0, k, d) for (i, _), (d, k) in zip(kept, best, strict=True)), c
        for k in range(len(c)):
            own = [v for (_, v), b in zip(kept, best, strict=True) if b[1] == k]
            c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[k]


@pytest.mark.parametrize(("clusters", "pivots"), [(9, 5), (3, 2), (1, 4), (500, 5)])
def test_equals_brute_force(spark, clusters, pivots):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found, final = centroids.cluster(df, clusters=clusters, rounds=3, pivots=pivots)
    want, c = brute(rows, clusters, 3)
    if clusters == 500:  # ids run out: the null id starts a centroid too
        assert len(final) == len(want)
        return
    assert final.tolist() == c
    got = centroids.with_inertia(found, final).collect()
    assert sorted((r.id is None, r.id or 0, r.cluster, r.distance) for r in got) == want
    assert {r.inertia for r in got} == {sum(w[3] for w in want)}
    for r in got:
        assert r.cluster_inertia == sum(w[3] for w in want if w[2] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(1)
    c = rng.integers(-300, 300, (40, 64))
    v = c[rng.integers(0, 40, 4000)] + rng.integers(-40, 40, (4000, 64))
    p = centroids.Pivots(centroids.spread_out(c))
    exact = np.sqrt(centroids.squared(v, c).astype(float))
    assert (p.below(p.distances(v), p.distances(c)) <= exact).all()
    at, far, measured = centroids.nearest(v, p.distances(v), c, p, p.distances(c))
    assert (at == exact.argmin(axis=1)).all() and (far == centroids.squared(v, c).min(axis=1)).all()
    assert measured < 0.5 * exact.size


def test_ties_go_to_the_smaller_centroid():
    c = np.zeros((3, 64), np.int64)
    c[1, 0], c[2, 0] = 4, 4
    p = centroids.Pivots(centroids.spread_out(c))
    v = np.zeros((3, 64), np.int64)
    v[:, 0] = (2, 3, 1)
    assert centroids.nearest(v, p.distances(v), c, p, p.distances(c))[0].tolist() == [0, 1, 0]


def test_empty_and_too_large(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    assert centroids.cluster(df.limit(0))[0].count() == 0
    far = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(far)
