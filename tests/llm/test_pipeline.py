"""The pipeline's stages against brute force, and every registered query on a small folder."""

import random
import re

import pytest

import corpus_pipeline
from revlens.llm import langid, quality, queries
from revlens.llm.common import Scratch, id_crc, read
from revlens.llm.words import tokenizer
from tests.llm.test_simhash import brute_fingerprint
from tests.llm.test_suffix import brute
from tests.llm.util import corpus

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark):
    path = Scratch(spark, "corpus").path
    corpus(spark, path)
    return path


def _near(rows):
    fps = [brute_fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))
    while True:
        low = [min(root[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(rows))]
        if low == root:
            return root
        root = low


def test_run_equals_brute_force(spark, folder):
    docs = read(spark, folder, "documents")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    model = langid.train(docs.where(id_crc("doc_id", 4) != 2))
    rows = [r for r in rows if model.predict([r["text"]])[0][0] != "und"]
    assert all(re.search(r"[^\W\d_]", r["text"]) for r in rows)
    left = spark.createDataFrame(rows, docs.schema)
    gam = quality.train(left, read(spark, folder, "labels").where(id_crc("doc_id", 5) != 0))
    rows = [r for r in rows if gam.score(__import__("numpy").array([quality.features(r["text"])]))[0] >= 0.3]
    roots = _near(rows)
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    data = [r["text"].encode() for r in rows]
    for r, t, m in zip(rows, data, brute(data, corpus_pipeline.PASSAGE), strict=True):
        r["text"] = bytes(c for c, x in zip(t, m, strict=True) if not x).decode(errors="ignore")
    encode = tokenizer(queries.vocabulary("byte_bpe_50k.json")).encode
    want = {r["doc_id"]: len(encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows}
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_passages_of_51_words_go(spark, folder):
    """Short planted passages are cut wherever they occur; texts without one stay as they are."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice((2, 3, 4, 5, 6))))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(51) for _ in range(6)]
    rows = [(i, f"{prose(80)} {passages[i % 6]} {prose(60)}" if i % 2 else prose(150)) for i in range(48)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, folder).collect()}
    for i, t in rows:
        assert (passages[i % 6][5:-5] not in got[i]) if i % 2 else got[i] == t


def test_stages_keep_columns_and_bear_odd_tables(spark, folder):
    from pyspark.sql import functions as F

    docs = read(spark, folder, "documents").withColumn("score", F.lit(1.0)).withColumn("fp", F.lit("x")).withColumn("k1", F.lit(1))
    more = docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    for table in (docs.union(more).union(more).union(docs.where("doc_id < 5")), docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = Scratch(spark, "test").keep(stage(spark, now, folder))
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        corpus_pipeline.STAGES[-1][1](spark, now, folder).count()


TABLE = {"op1_ann": "embeddings", "op5_html": "pages", "op12_centroids": "embeddings"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, folder, name):
    out = queries.QUERIES[name](spark, folder)
    n = read(spark, folder, TABLE.get(name, "documents")).count()
    if name == "op1_ann":  # every 20th vector asks for its 20 nearest
        assert out.count() == 3 * 20
    else:
        assert out.count() == n if name not in ("pipeline", "op10_packing") else out.count() > 0
