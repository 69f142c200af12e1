import re

import numpy as np
import pytest
import xxhash

from revlens.llm import simhash
from revlens.llm.common import Scratch
from revlens.llm.components import components
from tests.llm.util import AWKWARD, documents


def brute_fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_roots(values, radius):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    root = np.arange(len(values))
    while True:
        low = np.where(near, root[None, :], len(values)).min(axis=1)
        if (low == root).all():
            return root
        root = low


def test_fingerprint():
    for _, t in AWKWARD:
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)
    assert simhash.fingerprint(b"a b c") == brute_fingerprint("a b c")


def _values(rng, n):
    base = rng.integers(0, 2 ** 63, max(1, n // 6), dtype=np.uint64)
    v = base[rng.integers(0, len(base), n)]
    for _ in range(4):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(v)


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 3, 64, 65, 700):
        v = _values(rng, n)
        near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
        assert (simhash.within(v, simhash.planes(v), len(v), radius) == near).all()
        pairs = set(zip(brute_roots(v, radius).tolist(), simhash.forest(v, radius).tolist(), strict=True))
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


@pytest.mark.parametrize("rows_per_part", [4096, 5])
def test_classes(spark, rows_per_part):
    v = _values(np.random.default_rng(9), 400)
    root = brute_roots(v, 4)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = simhash.links(df, rows_per_part=rows_per_part)
    found = {r.u: r.v for r in components(links, Scratch(spark, "test")).collect()}
    mine = [found.get(int(x), int(x)) for x in v.view(np.int64)]
    pairs = set(zip(root.tolist(), mine, strict=True))
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_awkward_rows(spark):
    hashed = Scratch(spark, "test").keep(simhash.fingerprints(documents(spark), keep=["doc_id", "text"]))
    rows = hashed.join(simhash.near_duplicates(hashed), "fp").collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert r.fp & (1 << 64) - 1 == brute_fingerprint(r.text)
    ids = {r.text: r.component_id for r in rows}
    assert ids[AWKWARD[0][1]] == 1 and ids[None] == ids[""] == ids["   \n\t "] == 2
    empty = Scratch(spark, "test").keep(hashed.limit(0))
    assert simhash.near_duplicates(empty).count() == 0
    nameless = Scratch(spark, "test").keep(hashed.where("doc_id is null"))
    assert [r.component_id for r in simhash.near_duplicates(nameless).collect()] == [None]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r.u: r.v for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}
