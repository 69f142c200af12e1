import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from revlens.llm import queries, resample
from revlens.llm.common import Scratch
from tests.llm.util import AWKWARD, documents


def brute_features(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def brute(docs, target, percent=25):
    found = [(i, *brute_features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(brute_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, words, f in found:
        n = sum(f.values())
        weight = sum(c * gain[b] for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_query_equals_brute_force(spark):
    many = [(100 + i, " ".join(f"w{(i * j) % 17} é{j % 5}" for j in range(i % 40))) for i in range(120)]
    rows = AWKWARD + many + [(300, "The Ünïcode naïve text, 3rd of 5. " * 40), (301, "a" * 500 + " b" * 30)]
    target = ["w1 é1 w2 é2 quick brown", "naïve text", None, ""]
    path = Scratch(spark, "resample").path
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = queries.QUERIES["op13_resample"](spark, path)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, target)


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(2)
    gain = rng.integers(-9000, 5000, 1000)
    counts = rng.integers(0, 3, (50, 1000)) * rng.integers(0, 2, (50, 1000))
    counts[3, 7], counts[4] = 123_456, 0
    assert (resample.Gains(gain).sums(counts) == counts @ gain).all()
    for flat in (np.zeros(70, np.int64), np.full(70, -1), np.full(70, 8), np.full(70, -8)):
        assert (resample.Gains(flat).sums(np.ones((2, 70), np.int64)) == flat.sum()).all()


def test_longer_runs_and_other_buckets():
    w = [b"a", b"b", b"c"]
    want = [zlib.crc32(x) % 97 for x in (b"a", b"b", b"c", b"a b", b"b c", b"a b c")]
    assert resample.features(w, 3, 97).tolist() == want
    assert len(resample.features([], 2)) == 0


def test_empty_tables(spark):
    docs = documents(spark).limit(0)
    assert resample.totals(docs).sum() == 0
    flat = resample.Gains(resample.gains(np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)))
    rows = Scratch(spark, "resample").keep(resample.scored(resample.weigh(docs, flat)))
    assert "score" in rows.columns and resample.draw(rows, 25).count() == 0
