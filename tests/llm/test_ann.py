import numpy as np
from pyspark.sql import functions as F

from revlens.llm import ann


def _search(spark, rows, k=20, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int")
    got = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0, k=k, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def _brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:1900] = x[5]  # a hot vector
    x[2000:2500] *= 3
    ids = np.arange(3000)
    got = _search(spark, [(int(i), v.tolist(), 0.0, 0) for i, v in zip(ids, x, strict=True)], part=256)
    want = _brute(ids, x.astype(np.float64), 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        true = {int(i): s for i, s in zip(ids, (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1), strict=True)}
        assert all(abs(true[i] - s) < 1e-9 for i, s in found) and found == sorted(found, key=lambda r: (-r[1], r[0]))
    assert [i for i, _ in got[1000]] == [i for i, _ in want[1000]]  # ties to the smaller id


def test_lists_inside_cells(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(30, 24)) * 2
    x = (middle[rng.integers(30, size=4000)] + rng.normal(size=(4000, 24))).astype(np.float32)
    x[3000:3300] = x[7]
    ids = np.arange(4000)
    rows = [(int(i), v.tolist(), 0.0, 0) for i, v in zip(ids, x, strict=True)]
    index = ann.fit(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int"), coarse=5)
    assert len(index.centres) == 5 and len(index.inner) == 5 and 1 <= index.probes <= index.lists == 25
    placed = index.place(x.astype(np.float64))
    both = index.centres[:, None, :] + index.inner[None, :, :]
    order = index.probed(index.query(x[:50].astype(np.float64)))
    for q, lists in zip(index.query(x[:50].astype(np.float64)), order, strict=True):
        far = ((both - q) ** 2).sum(axis=2).ravel()
        assert (np.diff(far[lists]) > -1e-2).all() and len(set(lists.tolist())) == len(lists)
    assert (np.bincount(index.home(placed), minlength=25) > 0).sum() > 15
    got = _search(spark, rows, coarse=5, part=256)
    want = _brute(ids, x.astype(np.float64), 20)
    assert got.keys() == want.keys()
    # by score, as any of the equal rows may stand at the end
    assert sum(sum(s >= want[q][-1][1] - 1e-9 for _, s in got[q]) for q in want) >= 0.9 * 20 * len(want)


def test_probes_follow_true_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    ids = np.array([3, 9, 400])
    got = ann.true_neighbours(df, ids, x[ids], 6, lambda v: np.round(v[:, 0] * 1e6).astype(np.int64))
    for i, lists in zip(ids, got, strict=True):
        s = x @ x[i]
        s[i] = -np.inf
        assert sorted(lists) == sorted(np.round(x[np.argsort(-s)[:6], 0] * 1e6).astype(np.int64))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1.0, None]), (120, []),
            (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (160, [0.0, 2.0]), (1, [0.5, 0.5])]
    got = _search(spark, [(*r, 0.0, 0) for r in rows], k=3)
    assert got == {0: [(1, 0.5), (1, 0.5), (2, 0.5)], 160: [(1, 1.0), (1, 1.0), (2, 1.0)]}
    assert _search(spark, [(0, [1.0], 0.0, 0)]) == {}
    assert _search(spark, []) == {}


def test_fewer_candidates_than_k(spark):
    rows = [(i, [float(i + 1), 1.0], 0.0, 0) for i in range(5)]
    assert [i for i, _ in _search(spark, rows)[0]] == [4, 3, 2, 1]
