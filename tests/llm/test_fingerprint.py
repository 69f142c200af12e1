import hashlib
import random

from revlens.llm import fingerprint as fp
from tests.llm.util import AWKWARD, documents


def test_extensions_and_likeness():
    rng = random.Random(2)
    for _ in range(200):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 40)))
        b = a[:rng.randint(0, 40)] + "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
        x, y = fp.PrefixHash(a), fp.PrefixHash(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
        assert (x.fingerprint() == y.fingerprint()) == (a == b)
        near = fp.likeness(x.fingerprint(), y.fingerprint())
        assert 0 <= near <= 1 and (near == 1) == (a == b)


def _check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    if len({r[0] for r in rows}) == len(rows):
        by = {r.doc_id: r for r in got}
        for k, (i, t) in enumerate(order):
            t, f = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            e = t[:len(t) - half] + f[:half]
            assert by[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert by[i].fingerprint == fp.PrefixHash(t).fingerprint() and by[i].edited_fingerprint == fp.PrefixHash(e).fingerprint()
            assert (by[i].near_edited == 1) == (t == e) and (by[i].near_next == 1) == (t == f)


def test_rows(spark):
    rng = random.Random(1)
    unique = [r for r in AWKWARD[:10]] + [(100 + 13 * i, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 300)))) for i in range(120)]
    for rows in (unique, AWKWARD, [(5, "abc")], [(None, "x"), (None, None), (1, "abc"), (1, "abc"), (1, "zzz")], [(1, "same")] * 40):
        _check(rows, fp.fingerprints(documents(spark, rows)).collect())
    assert fp.fingerprints(documents(spark).limit(0)).count() == 0


def test_ties_have_one_order(spark):
    rows = [(7, f"{i:03d} text") for i in range(60)]
    got = fp.fingerprints(documents(spark, rows)).collect()
    assert len(got) == 60 and len({r.edited_sha256 for r in got}) == 60


def test_scattered_edits_keep_likeness():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    near = lambda a, b: fp.likeness(fp.PrefixHash(a).fingerprint(), fp.PrefixHash(b).fingerprint())
    for _ in range(20):
        text = " ".join(rng.choice(words) for _ in range(1200))
        n = len(text)
        ends = text[:20] + "#" + text[20:n - 20] + "##" + text[n - 19:]
        assert near(text, ends) > 0.9  # one edit near each end
        some = list(text)
        for k in range(8):
            some[n // 16 + k * n // 8] = ("", "XY", "Z")[k % 3]
        some = "".join(some)
        assert near(text, some) > 0.8 and near(text, some) == near(some, text)
        moved = text[n // 2:] + text[:n // 2]
        assert near(text, moved) > 0.9
        assert near(text, " ".join(rng.choice(words) for _ in range(1200))) < 0.05
    assert near("x" * 3000 + "a", "b" + "x" * 2000) <= 2000 / 3001


def test_cuts_bound_the_spans():
    rng = random.Random(6)
    for text in ("", "a", "x" * 3000, "word " * 1000, "".join(rng.choice("ab c") for _ in range(5000))):
        at = fp.PrefixHash(text).cuts().tolist()
        assert at[0] == 0 and at[-1] == len(text) and (not text or all(0 < y - x <= fp.LONGEST for x, y in zip(at, at[1:])))
