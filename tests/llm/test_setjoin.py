import random
import re
from fractions import Fraction

import numpy as np
import pytest

from revlens.llm import setjoin
from tests.llm.util import AWKWARD, documents


def brute_set(text, width=3):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    return {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)} or {" ".join(words)}


def brute(texts, percent):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(sets)))
    links = [[j for j, b in enumerate(sets) if a and b and Fraction(100 * len(a & b), len(a | b)) >= percent] for a in sets]
    while True:
        low = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(sets))]
        if low == root:
            return sets, root
        root = low


def family(seed, n=160):
    """Texts with copies, copies edited a little or much, shared passages, and short ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice(("", "x", "y"))
    prose = lambda k: [word() for _ in range(k)]
    bases = [prose(rng.choice((3, 9, 10, 11, 40, 90, 200))) for _ in range(12)]
    passage = prose(40)
    out = []
    for _ in range(n):
        t = list(rng.choice(bases[:4] if rng.random() < 0.5 else bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5, 12))):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.3:
            t += passage[:rng.choice((4, 40))]
        out.append(" ".join(t if rng.random() < 0.8 else [w.upper() for w in t]))
    return out + ["", "  ", "one", "one two", "One\tTWO", "one two three", "x" * 9000, "w " * 3000] + [" ".join(prose(3)) for _ in range(9)]


@pytest.mark.parametrize(("seed", "percent", "part"), [(1, 90, 4096), (2, 90, 7), (3, 80, 9), (4, 60, 11), (5, 100, 4096), (6, 90, 3)])
def test_equals_brute_force(spark, seed, percent, part):
    texts = family(seed)
    sets, want = brute(texts, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = setjoin.similar_sets(df, percent=percent, part=part)
    got = {r.doc_id: r for r in setjoin.components_of(df, found).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    for r in found.links.collect():  # verified, and never all pairs
        assert 100 * r.shared >= percent * (r.total - r.shared)
    assert found.links.count() <= 8 * len(texts)


def test_probe_keeps_every_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(300):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64))
        keep = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1])]
        s = np.unique(np.concatenate((keep, rng.integers(0, 400, rng.integers(0, 3)).astype(np.uint64))))
        sets.append(s if len(s) else base)
    for percent in (90, 70):
        order = setjoin.Order(np.zeros(1 << setjoin.ORDER, np.int64), percent)
        rows = sorted((int(t), p, len(s), i) for i, s in enumerate(sets) for p, t in enumerate(order.prefix(s)[0]))
        token, pos, n, ids = (np.array(c) for c in zip(*rows, strict=True))
        marks = np.stack([setjoin.sketch(sets[i]).view(np.uint64) for i in ids])
        a, b = setjoin.probe(token, np.full(len(ids), -1), ids, n, n, np.zeros(len(ids), int), pos, marks, percent)
        got = {frozenset(p) for p in zip(ids[a].tolist(), ids[b].tolist(), strict=True)}
        want = {frozenset((i, j)) for i in range(300) for j in range(i)
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert want <= got and len(got) < 0.2 * 300 * 300


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = setjoin.components_of(docs, setjoin.similar_sets(docs)).collect()
    assert len(rows) == len(AWKWARD)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert by[(2, 0)] == 2 and by[(3, 0)] == 3 and by[(4, 0)] == 4
    assert by[(6, 11)] == by[(1, 11)] == 1 and by[(None, 6)] is None
    empty = docs.limit(0)
    assert setjoin.components_of(empty, setjoin.similar_sets(empty)).count() == 0
    blank = docs.where("doc_id in (2, 3)")
    assert {r.component_id for r in setjoin.components_of(blank, setjoin.similar_sets(blank)).collect()} == {2, 3}
