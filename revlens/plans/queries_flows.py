"""End-to-end flows: the get_changes facade (SRC-10, SRC-9) and the streaming scoreboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators.reshape import commit_parts
from revlens.plans.catalog import CHANGE_SELECT, change_out, register, td, with_mapping
from revlens.plans.facade import get_changes
from revlens.plans.queries_core import SCOREBOARD_SQL
from revlens.session import persist_table, shared_path
from revlens.sources import logtext as LT
from revlens.streaming import logstream as ST


@register("get_changes", with_mapping(
    CHANGE_SELECT + " WHERE commit_date >= TIMESTAMP '1996-01-01 00:00:00'"
    " AND commit_date <= TIMESTAMP '1999-12-31 23:59:59.999999'"
    " AND (regexp_matches(author_name, '(?i)customer#0000001') OR regexp_matches(author_email, '(?i)customer#0000001'))"
    " AND regexp_matches(commit_message, '(?m)^order [0-9]*7$')"
    " AND (starts_with(file_paths, 'economy/') OR starts_with(file_paths, 'promo/'))"
    " AND NOT starts_with(file_paths, 'promo/1')"))
def q_get_changes(spark, sf):
    return change_out(get_changes(
        spark, td.commits(spark, sf), since="1996-01-01", until="1999-12-31", author="customer#0000001",
        grep="^order [0-9]*7$", include_paths=["economy/", "promo/"], exclude_paths=["promo/1"]))


@register("entries_to_changes", with_mapping(CHANGE_SELECT + " WHERE n_parents > 1"))
def q_entries_to_changes(spark, sf):
    """SRC-9: nested entries -> flat frame through the facade (merges only, no path filter)."""
    return change_out(get_changes(spark, td.commits(spark, sf), merges_only=True))


def _board_of(spark, src, max_files):
    out, ckpt = shared_path(spark, "stream-out"), shared_path(spark, "stream-ckpt")
    totals = ST.running_author_totals(ST.read_log_stream(spark, src, max_files_per_trigger=max_files))
    ST.start_scoreboard(totals, out, ckpt).awaitTermination()
    return ST.latest_board(spark, out)


def _files(spark, path: str) -> int:
    return len(spark.read.text(path).inputFiles())


@register("stream_scoreboard", SCOREBOARD_SQL)
def q_stream_scoreboard(spark, sf):
    """A dump in as many files as Spark writes, ingested as a stream half of them per trigger, scoreboard
    published per micro-batch; the result is the final published scoreboard."""
    src = shared_path(spark, "stream-in")
    LT.write_log(td.commits(spark, sf), src)
    return _board_of(spark, src, -(-_files(spark, src) // 2))


@register("stream_newest_first", SCOREBOARD_SQL)
def q_stream_newest_first(spark, sf):
    """A history of decades, newest dump first, a dump's worth of files a trigger, then one dump sent again:
    every commit counts once. Commit years are spread by the order key (1970 to 2019)."""
    commits = td.commits(spark, sf)
    year = F.pmod(F.col("commit_hash").cast("long"), F.lit(50))
    old = commits.withColumn("commit_date", F.timestamp_seconds(year * 31_557_600 + 86_400)).withColumn("commit_timestamp", year * 31_557_600 + 86_400)
    old = persist_table(old, "stream-commits")  # assembled once, read for each dump
    src = shared_path(spark, "stream-old")
    spans = ((25, 50), (10, 25), (0, 10), (25, 30))  # the last one is sent again
    for n, (a, b) in enumerate(spans):
        LT.write_log(old.where(year.between(a, b - 1)), f"{src}/dump-{n}")
    return _board_of(spark, f"{src}/*", _files(spark, f"{src}/dump-0"))


@register("stream_parts", SCOREBOARD_SQL)
def q_stream_parts(spark, sf):
    """A dump whose commits are cut in parts of two changes, streamed over several triggers: the parts of a commit
    may come in different triggers, their changes all count and the commit once."""
    src = shared_path(spark, "stream-parts")
    LT.write_log(commit_parts(td.changes(spark, sf), 2), src, compression="gzip")
    return _board_of(spark, src, -(-_files(spark, src) // 3))


@register("stream_changes", SCOREBOARD_SQL)
def q_stream_changes(spark, sf):
    """Totals streamed by changes only, several triggers; the board is ranked when it is read."""
    src, out, ckpt = (shared_path(spark, n) for n in ("stream-in", "stream-changes", "stream-ckpt"))
    LT.write_log(td.commits(spark, sf), src)
    totals = ST.running_author_totals(ST.read_log_stream(spark, src, max_files_per_trigger=-(-_files(spark, src) // 4)))
    ST.start_running_totals(totals, out, ckpt).awaitTermination()
    return ST.board_now(spark, out)
