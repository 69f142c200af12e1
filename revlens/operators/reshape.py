"""Nested <-> flat reshaping (EXP-1, AGG-5, whole or in bounded parts) and last-wins de-duplication (AGG-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.ranking import positions_in_group
from revlens.schema import COMMIT_COLUMNS
from revlens.session import persist_rows, persist_table

HEAD_COLUMNS = [c for c in COMMIT_COLUMNS if c != "commit_hash"]
CHANGE_FIELDS = ["file_paths", "additions", "deletions", "change_type", "old_file_path"]
#: Changes a row of ``commit_parts`` holds at most (about 1 MB of paths).
PART_SIZE = 10_000


def explode_changes(commits: DataFrame) -> DataFrame:
    """EXP-1: one row per (commit, file change); a commit without changes -> one row, null path, 0/0."""
    fc = F.explode_outer("file_changes").alias("_fc")
    flat = commits.select(*COMMIT_COLUMNS, fc)
    return flat.select(
        *COMMIT_COLUMNS,
        F.col("_fc.file_path").alias("file_paths"),
        F.col("_fc.change_type").alias("change_type"),
        F.coalesce(F.col("_fc.additions"), F.lit(0)).cast("bigint").alias("additions"),
        F.coalesce(F.col("_fc.deletions"), F.lit(0)).cast("bigint").alias("deletions"),
        F.col("_fc.old_file_path").alias("old_file_path"),
    )


def _nest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: the commit's other columns (the same in all its rows, so any row's) as one struct, and its
    changes sorted by path, then values."""
    fc = F.struct(
        F.col("file_paths").alias("file_path"), "additions", "deletions", "change_type", "old_file_path"
    )
    return changes.groupBy(*keys).agg(
        F.first(F.struct(*HEAD_COLUMNS)).alias("_head"),
        F.sort_array(F.collect_list(F.when(F.col("file_paths").isNotNull(), fc))).alias("file_changes"),
    )


def assemble_commits(changes: DataFrame) -> DataFrame:
    """AGG-5: flat changes -> nested commits, one row a commit (changes sorted by path, then values).

    Grouped by the commit hash; the other commit columns are functionally dependent and carried along, so
    the shuffle key stays narrow. Null-path rows (commits without changes) contribute an empty list. A
    nested row holds all changes of its commit; ``commit_parts`` is the form whose rows are bounded.
    """
    nested = _nest(changes, ["commit_hash"])
    return nested.select("commit_hash", "_head.*", "file_changes").select(*COMMIT_COLUMNS, "file_changes")


def _sliced(nested: DataFrame, size: int) -> DataFrame:
    """Nested rows cut into rows of at most ``size`` changes, numbered by ``part``; without changes: part 0."""
    last = F.greatest(F.floor((F.size("file_changes") - 1) / size), F.lit(0)).cast("int")
    parts = nested.select("*", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return parts.withColumn("file_changes", F.slice("file_changes", F.col("part") * size + 1, size))


def commit_parts(changes: DataFrame, size: int = PART_SIZE, whole_up_to: int = PART_SIZE) -> DataFrame:
    """AGG-5 in bounded rows: nested commits with at most ``size`` changes a row, numbered by ``part`` from 0.

    A commit of up to ``size`` changes is one row, part 0, as in ``assemble_commits``. A larger one is cut in
    the order path, values, whatever the partitions are, so a second run gives the same parts: one of up to
    ``whole_up_to`` changes (or ``size``, if that is more) out of its nested row, one beyond that by places from
    a range sort of (hash, change) alone: no task, list or window holds such a commit, and its other columns
    are carried once. Null hashes are one commit, as in ``assemble_commits``; no rows -> no parts.
    """
    if size < 1:
        raise ValueError("a part holds at least one change")
    changes = persist_rows(changes.select("commit_hash", *HEAD_COLUMNS, *CHANGE_FIELDS), "changes")  # read by each step below
    counted = changes.groupBy("commit_hash").agg(F.count("file_paths").alias("_n"))
    beyond = persist_table(counted.where(F.col("_n") > max(size, whole_up_to)).select(F.col("commit_hash").alias("_hash")), "large-hashes")
    is_large = F.col("commit_hash").eqNullSafe(F.col("_hash"))
    heads = changes.join(beyond, is_large, "left_semi").groupBy(F.col("commit_hash").alias("_hash")).agg(F.first(F.struct(*HEAD_COLUMNS)).alias("_head"))
    large = persist_table(heads, "large-commits")
    whole = _sliced(_nest(changes.join(beyond, is_large, "left_anti"), ["commit_hash"]), size)
    rows = changes.where(F.col("file_paths").isNotNull()).join(large, is_large, "left_semi").select("commit_hash", *CHANGE_FIELDS)
    placed = positions_in_group(rows, ["commit_hash"], CHANGE_FIELDS, "_at").withColumn("part", F.floor((F.col("_at") - 1) / size).cast("int"))
    fc = F.struct(F.col("file_paths").alias("file_path"), *CHANGE_FIELDS[1:])
    cut = placed.groupBy("commit_hash", "part").agg(F.sort_array(F.collect_list(fc)).alias("file_changes"))
    cut = cut.join(large, is_large).drop("_hash")
    both = whole.unionByName(cut)
    return both.select("commit_hash", "_head.*", "part", "file_changes").select(*COMMIT_COLUMNS, "part", "file_changes")


def last_wins(rows: DataFrame, keys=("commit_hash", "file_path"), order_col: str = "pos",
              value_cols=("additions", "deletions", "change_type")) -> DataFrame:
    """AGG-6: for duplicate keys the LAST row (largest ``order_col``) wins, per value column.

    ``max_by`` combines map-side. With a numeric ``order_col`` and numeric values it is a hash aggregate;
    text values make it a sort aggregate, of rows already reduced to one a key and task.
    """
    aggs = [F.max_by(c, F.col(order_col)).alias(c) for c in value_cols]
    return rows.groupBy(*keys).agg(*aggs)
