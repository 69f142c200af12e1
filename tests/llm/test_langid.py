import numpy as np

from revlens.llm import langid
from tests.llm.util import AWKWARD, documents


def test_kernel_is_shared_ngrams():
    texts = ["abab", "ab ba", "xyz", "12"]
    sets = [set(langid.ngrams(t).tolist()) for t in texts]

    def brute(t):
        t = " " + "".join(c if c.isalpha() else " " for c in t) + " "
        t = " ".join(t.split()).join("  ")
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    assert [len(s) for s in sets] == [len(brute(t)) for t in texts[:3]] + [0]
    model = langid.fit([(texts[0], "a"), (texts[2], "b")])
    k = model.kernel([langid.ngrams(t) for t in texts])
    for i, x in enumerate(texts[:3]):
        for j, y in enumerate((texts[0], texts[2])):
            want = len(brute(x) & brute(y)) / np.sqrt(len(brute(x)) * len(brute(y)))
            assert abs(k[i, j] - want) < 1e-6


def test_awkward_rows(spark):
    docs = documents(spark)
    model = langid.fit([("the dog and the fox", "en"), ("le chien et la plage", "fr")])
    out = langid.identify(docs, model)
    assert out.columns == [c for c in docs.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]
    rows = out.select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1 and (letters or r.score == 0)
    by = {}
    for r in rows:
        assert by.setdefault(r.text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)


def test_no_labels_and_no_rows(spark):
    empty = documents(spark).limit(0)
    model = langid.train(empty.withColumnRenamed("key", "lang"))
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(documents(spark), model).collect()} == {"und"}


def test_single_language():
    langs, scores = langid.fit([("one two", "en")] * 3).predict(["two three", None])
    assert langs == ["en", "und"] and scores[1] == 0


def _made_up(languages, rows):
    """(text, label) rows, each language with letters and words of its own."""
    import random

    rng = random.Random(4)
    out = []
    for k in range(languages):
        words = ["".join(chr(0x4E00 + 9 * k + rng.randint(0, 8)) for _ in range(rng.randint(2, 5))) for _ in range(12)]
        out += [(" ".join(rng.choice(words) for _ in range(12)), f"l{k:03d}") for _ in range(rows)]
    return out


def test_every_label_is_learned(spark):
    rows = _made_up(90, 8)
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(df, landmarks=3)
    assert len(model.languages) == 90
    langs, _ = model.predict([t for t, _ in rows])
    assert np.mean([a == b for a, (_, b) in zip(langs, rows)]) > 0.99


def test_fit_is_bounded_over_all_labels(spark, monkeypatch):
    rows = _made_up(90, 8)
    df = spark.createDataFrame(rows, "text string, lang string")
    seen = []
    whole = langid.labelled_sample
    monkeypatch.setattr(langid, "labelled_sample", lambda *a: seen.append(whole(*a)) or seen[-1])
    model = langid.train(df, texts_in_all=300, marks_in_all=200)
    assert [len(seen[0]), len(model.sizes), len(model.languages)] == [270, 180, 90]
    langs, _ = model.predict([t for t, _ in rows])
    assert np.mean([a == b for a, (_, b) in zip(langs, rows, strict=True)]) > 0.95
    few = langid.train(df, texts_in_all=10, marks_in_all=10)  # one each at least
    assert [len(seen[1]), len(few.sizes), len(few.languages)] == [90, 90, 90]


def test_sample_is_of_distinct_texts(spark):
    rows = _made_up(3, 60)
    copies = [(rows[0][0], "l000")] * 3000 + [("12 34", "l001")] * 500 + rows[60:70] * 9
    df = lambda r, n: spark.createDataFrame(r, "text string, lang string").repartition(n)
    want = langid.labelled_sample(df(rows, 3), "text", "lang", 20)
    assert [sum(x == lang for _, x in want) for lang in ("l000", "l001", "l002")] == [20] * 3
    assert langid.labelled_sample(df(rows + copies, 7), "text", "lang", 20) == want
    assert sorted(langid.labelled_sample(df(rows + copies, 7), "text", "lang", 1000)) == sorted(rows)
