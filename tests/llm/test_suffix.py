import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from revlens.llm import suffix
from tests.llm.util import AWKWARD, documents


def brute(texts, window=400):
    """Marks of the bytes in any string of ``window`` bytes that starts in two places."""
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - window + 1):
            seen[t[p:p + window]].append((d, p))
    marks = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for d, p in places if len(places) > 1 else ():
            marks[d][p:p + window] = b"\1" * window
    return marks


def digest(text, mark):
    kept = bytes(c for c, m in zip(text, mark, strict=True) if not m)
    spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
    return sum(mark), spans, hashlib.sha256(kept).hexdigest()


def texts(seed=5):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgé \n") for _ in range(n))
    shared = [noise(rng.choice((380, 395, 420, 600, 900))) for _ in range(8)]
    out = []
    for _ in range(30):
        parts = [rng.choice((noise(rng.randint(0, 200)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 200):])) for _ in range(rng.randint(0, 4))]
        out.append("".join(parts))
    return out + ["", "x" * 399, "x" * 400, "x" * 401, "ab" * 900, out[3], "y" + "x" * 3000, noise(50) + "\0" * 430, "a repeated line of text\n" * 40]


@pytest.mark.parametrize(("hot", "window", "gram"), [(50_000, 400, 64), (3, 400, 64), (50_000, 240, 32), (3, 100, 16)])
def test_equals_brute_force(spark, hot, window, gram):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    kept = {(r.k1, r.k2): r for r in suffix.kept_texts(suffix.repeated_spans(df, window=window, hot=hot, gram=gram), digest=True).collect()}
    data = [t.encode() for t in rows]
    want = [digest(t, m) for t, m in zip(data, brute(data, window), strict=True)]
    for r in df.select("doc_id", *suffix.text_key()).collect():
        k = kept.get((r.k1, r.k2))
        got = (k.n_removed, k.n_spans, k.kept) if k else (0, 0, hashlib.sha256(data[r.doc_id]).hexdigest())
        assert got == want[r.doc_id], r.doc_id


def test_anchors_are_local():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, 3000).astype(np.uint8)
    b = np.concatenate((rng.integers(0, 4, 777).astype(np.uint8), a[500:1400], rng.integers(0, 4, 300).astype(np.uint8)))
    pa, pb = (set(suffix.anchors(x)[0].tolist()) for x in (a, b))
    for p in range(500, 1400 - 400 + 1):  # every shared window holds an anchor at the same place
        mine = {x - p for x in pa if p <= x <= p + 336}
        assert mine & {x - (p - 500 + 777) for x in pb}


def test_msd_order_is_a_sort():
    rng = np.random.default_rng(2)
    digits, group = rng.integers(0, 3, (500, 6)).astype(np.uint64), rng.integers(0, 5, 500)
    order, shared = suffix.msd_order(digits, group)
    rows = [(group[i], *digits[i].tolist()) for i in order]
    assert rows == sorted(rows)
    for k in range(1, 500):
        same = rows[k][0] == rows[k - 1][0]
        want = next((d for d in range(6) if rows[k][d + 1] != rows[k - 1][d + 1]), 6) if same else -1
        assert shared[k] == want


def test_cut_through_characters_and_awkward_rows(spark):
    docs = documents(spark)
    out = {(r.doc_id, r.text) for r in suffix.without_repeats(docs).select("doc_id", "text").collect()}
    assert (8, "") in out and (2, None) in out and (1, AWKWARD[0][1]) in out
    assert suffix.without_repeats(docs).columns == docs.columns
    assert suffix.without_repeats(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "p" + "é" * 300 + "q"), (2, "é" * 250 + "z" * 9)], "doc_id long, text string")
    for r in suffix.without_repeats(odd).collect():
        assert "�" not in r.text
