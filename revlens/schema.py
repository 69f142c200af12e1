"""Explicit schemas of the data model. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Provenance keys and the schema major version written into Parquet.
DATA_VERSION = "1.0"
DESCRIPTION = "Git commit data extracted by revlens"
META_KEYS = ("data_version", "description", "since", "until")

FILE_CHANGE = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("additions", T.LongType()),
        T.StructField("deletions", T.LongType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("old_file_path", T.StringType()),
    ]
)

COMMIT = T.StructType(
    [
        T.StructField("commit_hash", T.StringType()),
        T.StructField("parent_hashes", T.ArrayType(T.StringType())),
        T.StructField("author_name", T.StringType()),
        T.StructField("author_email", T.StringType()),
        T.StructField("commit_date", T.TimestampType()),
        T.StructField("commit_timestamp", T.LongType()),
        T.StructField("commit_message", T.StringType()),
        T.StructField("file_changes", T.ArrayType(FILE_CHANGE)),
    ]
)

COMMIT_COLUMNS = [f.name for f in COMMIT.fields if f.name != "file_changes"]

# Flat change frame: one row per (commit, file change). `file_paths` holds ONE path.
CHANGE = T.StructType(
    [
        T.StructField("commit_hash", T.StringType()),
        T.StructField("parent_hashes", T.ArrayType(T.StringType())),
        T.StructField("author_name", T.StringType()),
        T.StructField("author_email", T.StringType()),
        T.StructField("commit_date", T.TimestampType()),
        T.StructField("commit_timestamp", T.LongType()),
        T.StructField("commit_message", T.StringType()),
        T.StructField("file_paths", T.StringType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("additions", T.LongType()),
        T.StructField("deletions", T.LongType()),
        T.StructField("old_file_path", T.StringType()),
    ]
)

CHANGE_COLUMNS = [f.name for f in CHANGE.fields]

STATS = T.StructType(
    [
        T.StructField("author_email", T.StringType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("added", T.LongType()),
        T.StructField("deleted", T.LongType()),
        T.StructField("commits", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("rank", T.LongType()),
        T.StructField("diff_decile", T.IntegerType()),
        T.StructField("commit_decile", T.IntegerType()),
    ]
)

STATS_COLUMNS = [f.name for f in STATS.fields]


def empty(spark, schema: T.StructType):
    """Typed empty frame (the empty-input answer of every operator)."""
    return spark.createDataFrame([], schema)
