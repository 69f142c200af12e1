"""Report frames over STATS rows (PRJ-13..20, AGG-2..4 with labels).

The reference prints these as text tables; here they are DataFrames a notebook ``show()``s
or a job writes. Numbers are kept alongside the display text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import scalar as X
from revlens.operators.filters import author_stats_match
from revlens.operators.stats import decile_distribution, get_ranking

# The ten metrics of the single-author view, in display order.
PIVOT_METRICS = [
    "Author", "Rank", "Lines Added", "Lines Deleted", "Total Diff", "Commits",
    "Diff Decile", "Commit Decile", "Percentile", "Avg Diff/Commit",
]


def scoreboard_report(stats: DataFrame, label_width: int | None = 45) -> DataFrame:
    """PRJ-18: the 8-column ranking view (ordered by total desc)."""
    return get_ranking(stats).select(
        F.col("rank"),
        X.author_label("author_name", "author_email", label_width).alias("author"),
        X.dash_if_zero("added").alias("lines_added"),
        X.dash_if_zero("deleted").alias("lines_deleted"),
        F.col("total").alias("total_diff"),
        F.col("commits"),
        F.col("diff_decile").alias("diff_d"),
        F.col("commit_decile").alias("comm_d"),
    )


def _with_match_count(matches: DataFrame) -> DataFrame:
    # AGG-2 attached to each row as a scalar subquery (one aggregate job, no join).
    return matches.withColumn("n_matches", matches.select(F.count(F.lit(1))).scalar())


def author_report(stats: DataFrame, query: str | None) -> DataFrame:
    """PRJ-19: the 10-column view of the authors matching ``query`` (rank among the matches'
    scoreboard, percentile and average per commit)."""
    m = _with_match_count(author_stats_match(stats, query, ignore_empty_parts=True))
    pct = X.percentile(F.col("rank"), F.col("n_matches"))
    avg = X.avg_diff_per_commit(F.col("total"), F.col("commits"))
    return m.select(
        X.author_label("author_name", "author_email", None).alias("author"),
        F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" of "), F.col("n_matches").cast("string")).alias("rank_label"),
        X.dash_if_zero("added").alias("lines_added"),
        X.dash_if_zero("deleted").alias("lines_deleted"),
        F.col("total").alias("total_diff"),
        F.col("commits"),
        F.col("diff_decile").alias("diff_d"),
        F.col("commit_decile").alias("comm_d"),
        F.concat(F.lit("Top "), X.fmt_fixed(pct, 1), F.lit("%")).alias("percentile"),
        F.concat(X.fmt_fixed(avg, 0), F.lit(" lines")).alias("avg_diff_per_commit"),
    )


def author_pivot(stats: DataFrame, query: str | None = None) -> DataFrame:
    """PRJ-20: each matching author as (author, ordinal, metric, value) rows, 10 per author;
    ``query=None`` pivots every author (the force-pivot view)."""
    rep = author_report(stats, query)
    values = [
        ("Author", F.col("author")),
        ("Rank", F.col("rank_label")),
        ("Lines Added", F.col("lines_added")),
        ("Lines Deleted", F.col("lines_deleted")),
        ("Total Diff", F.col("total_diff").cast("string")),
        ("Commits", F.col("commits").cast("string")),
        ("Diff Decile", F.col("diff_d").cast("string")),
        ("Commit Decile", F.col("comm_d").cast("string")),
        ("Percentile", F.col("percentile")),
        ("Avg Diff/Commit", F.col("avg_diff_per_commit")),
    ]
    wide = rep.select(F.col("author").alias("author_key"), *[v.alias(f"m{i}") for i, (_, v) in enumerate(values)])
    long = wide.unpivot("author_key", [f"m{i}" for i in range(len(values))], "slot", "value")
    ordinal = F.substring("slot", 2, 3).cast("int")
    names = F.array(*[F.lit(n) for n in PIVOT_METRICS])
    return long.select(
        "author_key",
        (ordinal + 1).alias("ordinal"),
        F.element_at(names, ordinal + 1).alias("metric"),
        "value",
    )


def decile_distribution_report(stats: DataFrame, kind: str = "diff") -> DataFrame:
    """AGG-3/4 with the PRJ-17 range label."""
    d = decile_distribution(stats, kind)
    return d.select("decile", X.range_label("min_value", "max_value").alias("range"), "authors",
                    "min_value", "max_value").orderBy("decile")


def summary(stats: DataFrame) -> DataFrame:
    """AGG-2: number of authors."""
    return stats.agg(F.count(F.lit(1)).cast("bigint").alias("total_unique_authors"))
