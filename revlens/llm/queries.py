"""Registered queries of this folder: one ``opN_<name>`` per operator, whole tables, no limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import ann, bpe, centroids, fingerprint, html, langid, packing, quality, resample, setjoin, simhash, suffix, tokens
from revlens.llm.common import Scratch, id_crc, read, utf8
from revlens.llm.oracles import ORACLES  # noqa: F401 - the entry reads it here
from revlens.llm.words import DROPPED, KEPT

END_ID = 2
QueryFn = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file: a parameter of the operators, chosen here for the queries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = Scratch(spark, "kept").keep(suffix.kept_texts(suffix.repeated_spans(docs), digest=True))
    data = utf8()
    rows = docs.select("doc_id", *suffix.text_key(), F.octet_length(data).cast("long").alias("n_bytes"),
                       F.when(F.octet_length(data) < suffix.WINDOW, F.sha2(data, 256)).alias("short"))
    return rows.join(kept, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "short").alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (id_crc("doc_id", 4) == 2).alias("held_out")
    model = langid.train(docs.where(~held))
    return langid.identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = f"{Scratch(spark, 'tokens').path}/ids"
    tokens.write_tokens(docs, out, vocabulary("word_bpe_49k.json"), DROPPED, END_ID)
    return tokens.with_crc(tokens.read_tokens(spark, out))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(id_crc("doc_id", 5) != 0)
    held = (id_crc("doc_id", 5) == 0).alias("held_out")
    model = quality.train(docs, labels)
    return quality.score(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "score", "predicted")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, vocabulary("word_bpe_49k.json"), DROPPED)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = Scratch(spark, "fingerprints").keep(simhash.fingerprints(docs, keep=["doc_id"]))
    classes = simhash.near_duplicates(hashed)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return hashed.join(classes, "fp").select("doc_id", digits, "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, vocabulary("byte_bpe_50k.json"), KEPT, END_ID, with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return setjoin.components_of(docs, setjoin.similar_sets(docs))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    assigned, final = centroids.cluster(vectors)
    rows = centroids.with_inertia(Scratch(spark, "clusters").keep(assigned), final)
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = resample.Gains(resample.gains(resample.totals(docs), resample.totals(read(spark, sf_dir, "benchmark"))))
    rows = Scratch(spark, "scores").keep(resample.scored(resample.weigh(docs, model, keep=["doc_id"])))
    return resample.draw(rows, 25).select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the packages; it uses this module in turn

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, QueryFn] = {
    "pipeline": pipeline,
    "op1_ann": op1_ann,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_html": op5_html,
    "op6_quality": op6_quality,
    "op7_fingerprint": op7_fingerprint,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_jaccard": op11_jaccard,
    "op12_centroids": op12_centroids,
    "op13_resample": op13_resample,
}
