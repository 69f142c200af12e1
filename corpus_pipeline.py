"""Corpus pipeline: language ID, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet
and read again. All but the last return the columns of ``docs``. Rows are told apart by id and text, so
null and repeated ids are safe; an empty table runs through and gives no sequence.

* ``language_id`` drops texts without a language (null, or no letter).
* ``quality`` drops texts the additive model predicts to be poor.
* ``near_dedup`` keeps one row of each SimHash component: that of the smallest id.
* ``repeats`` cuts strings of ``PASSAGE`` bytes that occur elsewhere; ``n_chars`` follows. A text may become empty.
* ``packing`` returns the pieces with their places in sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import langid, packing, quality, simhash, suffix
from revlens.llm.common import Scratch, id_crc, read
from revlens.llm.queries import END_ID, vocabulary
from revlens.llm.words import KEPT


#: A passage of over 50 words fills a window of 240 bytes (4.7 bytes a word and its space); grams to anchor it.
PASSAGE, GRAM = 240, 32


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(id_crc("doc_id", 4) != 2))
    found = langid.identify(docs, model, names=("__lang", "__score"))
    return found.where(F.col("__lang") != langid.UND).drop("__lang", "__score")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(id_crc("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    scored = quality.score(docs, model, names=("__score", "__good"))
    return scored.where(F.col("__good") == 1).drop("__score", "__good")


def _row_key() -> dict[str, Column]:
    """Id and text of a row as columns without nulls."""
    k1, k2 = suffix.text_key()
    return {"__n": F.col("doc_id").isNull(), "__d": F.coalesce("doc_id", F.lit(0)), "__k1": k1, "__k2": k2}


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "near-dedup")
    key = list(_row_key())
    hashed = scratch.keep(simhash.fingerprints(docs.select("text", "doc_id").withColumns(_row_key()), keep=["doc_id", *key]))
    winners = simhash.near_duplicates(hashed.select("doc_id", "fp")).where("keeper").select("fp", "component_id")
    first = F.min(F.struct(*key)).alias("row")  # one row of each component
    stay = (hashed.join(winners, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("fp").agg(first).select("row.*"))
    kept = docs.withColumns(_row_key()).join(stay, key, "left_semi")
    return kept.dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix.without_repeats(docs, window=PASSAGE, gram=GRAM)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), KEPT, END_ID, with_ids=False)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("repeats", repeats),
    ("packing", packed),
]

#: SQL can't express these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
