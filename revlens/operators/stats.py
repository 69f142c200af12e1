"""Author statistics: totals, ranks, deciles, scoreboard and the analytic aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.scalar import month_bucket
from revlens.operators.ranking import decile_of, multi_value_ranks, with_rank
from revlens.schema import STATS, STATS_COLUMNS, empty
from revlens.session import materialize


def author_totals(changes: DataFrame) -> DataFrame:
    """AGG-1: per (author_email, author_name): added, deleted, distinct commits.

    Two levels instead of a distinct aggregate: (author, commit) first, then author. Both levels
    combine map-side, so a hot author never ships its raw rows. Null author keys are dropped
    (the reference's group-by drops them too).
    """
    keyed = changes.where(F.col("author_email").isNotNull() & F.col("author_name").isNotNull())
    per_commit = keyed.groupBy("author_email", "author_name", "commit_hash").agg(
        F.sum("additions").alias("_a"), F.sum("deletions").alias("_d")
    )
    return per_commit.groupBy("author_email", "author_name").agg(
        F.coalesce(F.sum("_a"), F.lit(0)).cast("bigint").alias("added"),
        F.coalesce(F.sum("_d"), F.lit(0)).cast("bigint").alias("deleted"),
        F.count("commit_hash").cast("bigint").alias("commits"),
    )


def ranked_stats(totals: DataFrame) -> DataFrame:
    """PRJ-12 + WIN-1..3 over AGG-1 output: total, rank, diff_decile, commit_decile; one row per author
    (email, name). One pass ranks both columns; their ranks come back by one plain join each."""
    base = totals.withColumn("total", (F.col("added") + F.col("deleted")).cast("bigint"))
    ranks = materialize(multi_value_ranks(base, ["total", "commits"]))  # a row per distinct value, read twice
    by_total = ranks.where(F.col("_kind") == 0).select(F.col("_v").alias("total"), F.col("_rank").alias("rank"), "_n")
    by_commits = ranks.where(F.col("_kind") == 1).select(F.col("_v").alias("commits"), F.col("_rank").alias("_crank"), F.col("_n").alias("_cn"))
    scored = (
        base.join(by_total, "total", "left").join(by_commits, "commits", "left")
        .withColumn("diff_decile", decile_of(F.col("rank"), F.col("_n")))
        .withColumn("commit_decile", decile_of(F.col("_crank"), F.col("_cn")))
    )
    return scored.select(*STATS_COLUMNS)


def author_scoreboard(changes: DataFrame, ordered: bool = True, materialize_totals: bool = True) -> DataFrame:
    """WIN-4 (flagship): STATS rows, ordered by total desc (ties broken by email, name).

    The per-author totals (one row per author, small next to the change rows) feed the join target and
    the ranks. They are checkpointed once so the scan, join and aggregation of the change rows run once.
    """
    totals = author_totals(changes)
    if materialize_totals:
        totals = materialize(totals)
    stats = ranked_stats(totals)
    return get_ranking(stats) if ordered else stats


def get_ranking(stats: DataFrame) -> DataFrame:
    """SRT-1: order by total desc; tie-break added for determinism."""
    return stats.orderBy(F.col("total").desc(), "author_email", "author_name")


def empty_stats(spark) -> DataFrame:
    return empty(spark, STATS)


def author_count(stats: DataFrame) -> DataFrame:
    """AGG-2: number of authors as a one-row frame."""
    return stats.agg(F.count(F.lit(1)).cast("bigint").alias("n_authors"))


def decile_distribution(stats: DataFrame, kind: str = "diff") -> DataFrame:
    """AGG-3 / AGG-4: per decile min, max and number of authors; empty deciles omitted."""
    dcol, vcol = ("diff_decile", "total") if kind == "diff" else ("commit_decile", "commits")
    return (
        stats.where(F.col(dcol).isNotNull())
        .groupBy(F.col(dcol).alias("decile"))
        .agg(
            F.min(vcol).cast("bigint").alias("min_value"),
            F.max(vcol).cast("bigint").alias("max_value"),
            F.count(F.lit(1)).cast("bigint").alias("authors"),
        )
        .orderBy("decile")
    )


def patch_totals(file_stats: DataFrame, keys=("commit_hash",)) -> DataFrame:
    """AGG-7: total additions / deletions over all files of a patch."""
    return file_stats.groupBy(*keys).agg(
        F.coalesce(F.sum("additions"), F.lit(0)).cast("bigint").alias("additions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).cast("bigint").alias("deletions"),
    )


def dataset_profile(changes: DataFrame, approximate: bool = False) -> DataFrame:
    """AGG-8: distinct authors, distinct commits, summed additions/deletions, rows.

    Exact distincts in two levels: sums per (author, commit), which combine map-side, then each key is
    counted once over those far fewer rows; change rows are never multiplied by an Expand."""
    if approximate:
        return changes.agg(
            F.approx_count_distinct("author_email").cast("bigint").alias("authors"),
            F.approx_count_distinct("commit_hash").cast("bigint").alias("commits"),
            F.coalesce(F.sum("additions"), F.lit(0)).cast("bigint").alias("additions"),
            F.coalesce(F.sum("deletions"), F.lit(0)).cast("bigint").alias("deletions"),
            F.count(F.lit(1)).cast("bigint").alias("rows"))
    pairs = changes.groupBy("author_email", "commit_hash").agg(
        F.sum("additions").alias("a"), F.sum("deletions").alias("d"), F.count(F.lit(1)).alias("n"))
    # one level more: per key of either kind, as (kind, key) rows
    keys = F.array(F.struct(F.lit("author").alias("kind"), F.col("author_email").alias("key"), "a", "d", "n"),
                   F.struct(F.lit("commit").alias("kind"), F.col("commit_hash").alias("key"), F.lit(0).cast("bigint").alias("a"),
                            F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("n")))
    per_key = pairs.select(F.inline(keys)).groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("d").alias("d"), F.sum("n").alias("n"))
    known = lambda kind: F.count_if((F.col("kind") == kind) & F.col("key").isNotNull()).cast("bigint")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_key.agg(known("author").alias("authors"), known("commit").alias("commits"), total("a").alias("additions"),
                       total("d").alias("deletions"), total("n").alias("rows"))


def commits_per_month(changes: DataFrame) -> DataFrame:
    """AGG-9: month -> distinct commits. Distinct (month, commit) first, then count: no distinct agg."""
    month = month_bucket("commit_date").alias("month")
    return (
        changes.select(month, "commit_hash")
        .where(F.col("commit_hash").isNotNull())
        .distinct()
        .groupBy("month")
        .agg(F.count(F.lit(1)).cast("bigint").alias("commits"))
        .orderBy("month")
    )


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """SRT-4: ORDER BY ... LIMIT k (planned as TakeOrderedAndProject: per-partition top-k)."""
    return df.orderBy(*order).limit(k)


def top_authors_by_additions(changes: DataFrame, k: int = 5) -> DataFrame:
    """AGG-10: sum(additions) per author name, top k (ties broken by name)."""
    agg = changes.groupBy("author_name").agg(F.sum("additions").cast("bigint").alias("total_additions"))
    return top_k(agg, k, F.col("total_additions").desc(), "author_name")


def top_files_by_deletions(changes: DataFrame, k: int = 3) -> DataFrame:
    """AGG-11: sum(deletions) per file, top k (ties broken by path)."""
    agg = (
        changes.where(F.col("file_paths").isNotNull())
        .groupBy("file_paths")
        .agg(F.sum("deletions").cast("bigint").alias("total_deletions"))
    )
    return top_k(agg, k, F.col("total_deletions").desc(), "file_paths")


def diff_rank(stats: DataFrame, value_col: str = "total") -> DataFrame:
    """WIN-1 on any frame: min-rank by ``value_col`` descending."""
    return with_rank(stats, value_col, "rank")
