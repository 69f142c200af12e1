import numpy as np

from revlens.llm import quality
from tests.llm.util import AWKWARD, documents


def _brute(model, x):
    """Table entries added one by one."""
    out = []
    for row in x:
        bins = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        total += sum(t[bins[i], bins[j]] for i, j, t in model.pairs)
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


def test_scores_are_sums_of_tables_and_find_a_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single feature helps
    model = quality.fit(x[:2000], y[:2000])
    assert np.allclose(model.score(x[2000:]), _brute(model, x[2000:]))
    assert ((model.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.85
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 0), (9, 0), (7, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels))
    rows = out.select("text", "score", "predicted").collect()
    assert len(rows) == len(AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.text is None or r.text == ""}) == 1
    assert out.columns[-2:] == ["score", "predicted"] and out.columns.count("score") == 1


def test_no_labels_no_rows_one_class(spark):
    docs = documents(spark)
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).count() == 0
    good = quality.train(docs, spark.createDataFrame([(1, 1), (7, 1)], "doc_id long, quality int"))
    assert all(r.predicted == 1 for r in quality.score(docs, good).collect())


def test_repeated_id_leaves_others_in_the_fit(spark, monkeypatch):
    docs = [(0, f"copy {i} of it" if i % 2 else "the same text") for i in range(400)] + [(i, f"a text of some words, {i}") for i in range(1, 30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())))
    for n in (1, 5):
        quality.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels, max_rows=30)
    assert len(seen[0][1]) == 30 and seen[0][1] == [float(i % 2) for i in range(30)]
    assert seen[0] == seen[1]
