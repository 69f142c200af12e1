"""Scoreboard, aggregates, windows, sorts (AGG-*, WIN-*, SRT-*, PRJ-12..21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import reshape as RS
from revlens.operators import stats as S
from revlens.operators.ranking import with_decile, with_rank
from revlens.plans.catalog import SCOREBOARD_FROM_SRC, ntz, parents_text, register, td, with_mapping

_SB_SRC = ", src AS (SELECT author_email, author_name, commit_hash, additions, deletions FROM changes)"

SCOREBOARD_SQL = with_mapping(_SB_SRC + SCOREBOARD_FROM_SRC + "SELECT * FROM stats")


@register("author_scoreboard", SCOREBOARD_SQL)
def q_author_scoreboard(spark, sf):
    return S.author_scoreboard(td.changes(spark, sf))


# ---- AGG-2..11 ------------------------------------------------------------------------

_SB = ", src AS (SELECT author_email, author_name, commit_hash, additions, deletions FROM changes)" + SCOREBOARD_FROM_SRC


@register("author_count", with_mapping(_SB + "SELECT CAST(count(*) AS BIGINT) AS n_authors FROM stats"))
def q_author_count(spark, sf):
    return S.author_count(S.author_scoreboard(td.changes(spark, sf), ordered=False))


@register("author_totals", with_mapping(
    "SELECT author_email, author_name, CAST(sum(additions) AS BIGINT) AS added,"
    " CAST(sum(deletions) AS BIGINT) AS deleted, CAST(count(DISTINCT commit_hash) AS BIGINT) AS commits"
    " FROM changes GROUP BY author_email, author_name"))
def q_author_totals(spark, sf):
    return S.author_totals(td.changes(spark, sf))


@register("assemble_commits", with_mapping(
    "SELECT commit_hash, parents, author_name, author_email, commit_date, commit_timestamp, commit_message,"
    " CAST(count(file_paths) AS BIGINT) AS n_changes,"
    " coalesce(string_agg(file_paths, '|' ORDER BY file_paths), '') AS paths,"
    " CAST(sum(additions) AS BIGINT) AS additions"
    " FROM changes GROUP BY ALL"))
def q_assemble_commits(spark, sf):
    nested = RS.assemble_commits(td.changes(spark, sf))
    return nested.select(
        "commit_hash", parents_text(), "author_name", "author_email", ntz("commit_date"), "commit_timestamp",
        "commit_message",
        F.size("file_changes").cast("bigint").alias("n_changes"),
        F.array_join(F.transform("file_changes", lambda x: x["file_path"]), "|").alias("paths"),
        F.coalesce(F.aggregate("file_changes", F.lit(0).cast("bigint"), lambda acc, x: acc + x["additions"]),
                   F.lit(0).cast("bigint")).alias("additions"),
    )


_LW_ORDER = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@register("last_wins", f"""
WITH r AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS commit_hash, 'line-' || CAST(l_linenumber AS VARCHAR) AS file_path,
         CAST(l_quantity AS BIGINT) AS additions, CAST(floor(l_extendedprice) AS BIGINT) AS deletions,
         l_returnflag AS change_type,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY {', '.join(c + ' DESC' for c in _LW_ORDER.split(', '))}) AS rn
  FROM lineitem)
SELECT commit_hash, file_path, additions, deletions, change_type FROM r WHERE rn = 1
""")
def q_last_wins(spark, sf):
    li = td.table(spark, sf, "lineitem")
    pos = F.struct(*[F.col(c.strip()) for c in _LW_ORDER.split(",")])
    rows = li.select(
        F.col("l_orderkey").cast("string").alias("commit_hash"),
        F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("file_path"),
        pos.alias("pos"),
        F.col("l_quantity").cast("bigint").alias("additions"),
        F.floor("l_extendedprice").cast("bigint").alias("deletions"),
        F.col("l_returnflag").alias("change_type"),
    )
    return RS.last_wins(rows)


@register("patch_totals", with_mapping(
    "SELECT commit_hash, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions"
    " FROM changes GROUP BY commit_hash"))
def q_patch_totals(spark, sf):
    return S.patch_totals(td.changes(spark, sf))


@register("dataset_profile", with_mapping(
    "SELECT CAST(count(DISTINCT author_email) AS BIGINT) AS authors, CAST(count(DISTINCT commit_hash) AS BIGINT) AS commits,"
    " CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,"
    " CAST(count(*) AS BIGINT) AS rows FROM changes"))
def q_dataset_profile(spark, sf):
    return S.dataset_profile(td.changes(spark, sf))


@register("commits_per_month", with_mapping(
    "SELECT strftime(commit_date, '%Y-%m') AS month, CAST(count(DISTINCT commit_hash) AS BIGINT) AS commits"
    " FROM changes GROUP BY 1"))
def q_commits_per_month(spark, sf):
    return S.commits_per_month(td.changes(spark, sf))


@register("top_authors_by_additions", with_mapping(
    "SELECT author_name, CAST(sum(additions) AS BIGINT) AS total_additions FROM changes GROUP BY author_name"
    " ORDER BY total_additions DESC, author_name LIMIT 5"))
def q_top_authors_by_additions(spark, sf):
    return S.top_authors_by_additions(td.changes(spark, sf), 5)


@register("top_files_by_deletions", with_mapping(
    "SELECT file_paths, CAST(sum(deletions) AS BIGINT) AS total_deletions FROM changes WHERE file_paths IS NOT NULL"
    " GROUP BY file_paths ORDER BY total_deletions DESC, file_paths LIMIT 3"))
def q_top_files_by_deletions(spark, sf):
    return S.top_files_by_deletions(td.changes(spark, sf), 3)


# ---- WIN-1..3 on the events change set (ties on commit counts) -------------------------

_EV_TOTALS = (", t AS (SELECT author_email, CAST(sum(additions) + sum(deletions) AS BIGINT) AS total,"
              " CAST(count(DISTINCT commit_hash) AS BIGINT) AS commits FROM event_changes GROUP BY author_email)")


def _ev_totals(spark, sf):
    ev = td.event_changes(spark, sf)
    t = S.author_totals(ev)
    return t.select("author_email", (F.col("added") + F.col("deleted")).cast("bigint").alias("total"), "commits")


@register("diff_rank", with_mapping(
    _EV_TOTALS + " SELECT author_email, total, CAST(rank() OVER (ORDER BY total DESC) AS BIGINT) AS rank FROM t"))
def q_diff_rank(spark, sf):
    return with_rank(_ev_totals(spark, sf), "total", "rank").select("author_email", "total", "rank")


@register("diff_decile", with_mapping(
    _EV_TOTALS + ", r AS (SELECT *, rank() OVER (ORDER BY total DESC) AS rk, count(*) OVER () AS n FROM t)"
    " SELECT author_email, total, CAST(CASE WHEN rk = 1 THEN 1 ELSE least(10, (rk * 10 + n - 1) // n) END AS INTEGER)"
    " AS diff_decile FROM r"))
def q_diff_decile(spark, sf):
    return with_decile(_ev_totals(spark, sf), "total", "diff_decile").select("author_email", "total", "diff_decile")


@register("commit_decile", with_mapping(
    _EV_TOTALS + ", r AS (SELECT *, rank() OVER (ORDER BY commits DESC) AS rk, count(*) OVER () AS n FROM t)"
    " SELECT author_email, commits, CAST(CASE WHEN rk = 1 THEN 1 ELSE least(10, (rk * 10 + n - 1) // n) END AS INTEGER)"
    " AS commit_decile FROM r"))
def q_commit_decile(spark, sf):
    return with_decile(_ev_totals(spark, sf), "commits", "commit_decile").select("author_email", "commits", "commit_decile")


_EV_SB = (", src AS (SELECT author_email, author_name, commit_hash, additions, deletions FROM event_changes)"
          + SCOREBOARD_FROM_SRC)


@register("event_scoreboard", with_mapping(_EV_SB + "SELECT * FROM stats"))
def q_event_scoreboard(spark, sf):
    return S.author_scoreboard(td.event_changes(spark, sf))


# ---- JN-2/3: decile attach, keyed by (email, name) (D12) -------------------------------

@register("attach_deciles", with_mapping(
    ", src AS (SELECT shared_email AS author_email, author_name, commit_hash, additions, deletions FROM changes)"
    + SCOREBOARD_FROM_SRC + "SELECT * FROM stats"))
def q_attach_deciles(spark, sf):
    return S.author_scoreboard(td.changes(spark, sf, email_mode="shared"), ordered=False)


# ---- SRT-1..4 (row sets; the order itself is tested in pytest) ------------------------

@register("get_ranking", SCOREBOARD_SQL)
def q_get_ranking(spark, sf):
    return S.get_ranking(S.author_scoreboard(td.changes(spark, sf), ordered=False))


@register("newest_first", with_mapping("SELECT commit_hash, commit_timestamp FROM commits"))
def q_newest_first(spark, sf):
    heads = td.commit_heads(spark, sf)
    return heads.orderBy(F.col("commit_timestamp").desc(), "commit_hash").select("commit_hash", "commit_timestamp")


@register("canonical_order", with_mapping(
    "SELECT commit_timestamp, parents, commit_hash, coalesce(string_agg(file_paths, '|' ORDER BY file_paths), '') AS paths"
    " FROM changes GROUP BY commit_timestamp, parents, commit_hash"))
def q_canonical_order(spark, sf):
    nested = td.commits(spark, sf)
    out = nested.select(
        "commit_timestamp", parents_text(), "commit_hash",
        F.array_join(F.array_sort(F.transform("file_changes", lambda x: x["file_path"])), "|").alias("paths"),
    )
    # SRT-3: commits by (timestamp, joined parents), hash as the final tie-break
    return out.orderBy("commit_timestamp", "parents", "commit_hash")


@register("top_k", with_mapping(
    "SELECT commit_hash, commit_timestamp FROM commits ORDER BY commit_timestamp DESC, commit_hash LIMIT 10"))
def q_top_k(spark, sf):
    heads = td.commit_heads(spark, sf)
    return S.top_k(heads.select("commit_hash", "commit_timestamp"), 10,
                   F.col("commit_timestamp").desc(), "commit_hash")
