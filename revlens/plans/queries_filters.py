"""Filter queries (FLT-*) over the mapped change history."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from revlens.operators import filters as FL
from revlens.operators.reshape import explode_changes
from revlens.operators.stats import author_scoreboard
from revlens.plans.catalog import CHANGE_SELECT, SCOREBOARD_FROM_SRC, change_out, ntz, register, td, with_mapping


def _flat(spark, sf):
    return td.changes(spark, sf)


# ---- time -----------------------------------------------------------------------------

@register("since", with_mapping(CHANGE_SELECT + " WHERE commit_date >= TIMESTAMP '1998-01-01 00:00:00'"))
def q_since(spark, sf):
    return change_out(FL.since(_flat(spark, sf), "1998-01-01"))


@register("until", with_mapping(CHANGE_SELECT + " WHERE commit_date <= TIMESTAMP '1996-06-30 23:59:59.999999'"))
def q_until(spark, sf):
    return change_out(FL.until(_flat(spark, sf), "1996-06-30"))


@register("day_edges", with_mapping(
    CHANGE_SELECT + " WHERE commit_date >= TIMESTAMP '1997-03-01 00:00:00'"
    " AND commit_date <= TIMESTAMP '1997-03-31 23:59:59.999999'"))
def q_day_edges(spark, sf):
    return change_out(FL.date_range(_flat(spark, sf), "1997-03-01", "1997-03-31"))


@register("relative_window", with_mapping(
    CHANGE_SELECT + " WHERE commit_date >= TIMESTAMP '1998-02-28 12:00:00' AND commit_date <= TIMESTAMP '1998-08-24 12:00:00'"))
def q_relative_window(spark, sf):
    """SRC-10 / FLT-3 with periods counted back from a fixed clock."""
    now = datetime(1998, 8, 31, 12, tzinfo=timezone.utc)
    return change_out(FL.date_range(_flat(spark, sf), "6 months ago", "a week ago", now=now))


@register("check_window", with_mapping(
    "SELECT commit_hash, commit_date, commit_date + INTERVAL (ok % 3) DAY AS window_end, (ok % 7) <> 0 AS in_order FROM commits"))
def q_check_window(spark, sf):
    """FLT-5: windows that begin at a commit and end up to two days later, checked while they are read (one
    that starts after its end fails the job), then turned round for one commit in seven and tested."""
    heads = td.commit_heads(spark, sf).withColumn("window_end", F.col("commit_date") + F.make_dt_interval((F.col("_ok") % 3).cast("int")))
    good = FL.check_windows(heads, "commit_date", "window_end")
    turned = F.col("_ok") % 7 == 0
    start = F.when(turned, F.col("window_end") + F.make_dt_interval(F.lit(1))).otherwise(F.col("commit_date"))
    end = F.when(turned, F.col("commit_date")).otherwise(F.col("window_end"))
    return good.withColumns({"_s": start, "_e": end}).select(
        "commit_hash", ntz("commit_date"), ntz("window_end"), FL.window_in_order("_s", "_e").alias("in_order"))


@register("period_window", with_mapping(
    CHANGE_SELECT + " WHERE commit_date >= TIMESTAMP '1998-05-31 00:00:00'"
    " AND commit_date <= TIMESTAMP '1998-08-31 23:59:59.999999'"))
def q_period_window(spark, sf):
    # end 1998-08-31 minus '3 months' -> 1998-05-31 (calendar months, clamped at month end)
    return change_out(FL.period_window(_flat(spark, sf), end="1998-08-31", period="3 months"))


@register("stop_at_since", with_mapping(
    "SELECT commit_hash, commit_timestamp FROM commits WHERE commit_date >= TIMESTAMP '2001-01-01 00:00:00'"))
def q_stop_at_since(spark, sf):
    heads = td.commit_heads(spark, sf)
    return FL.stop_at_since(heads, "2001-01-01").select("commit_hash", "commit_timestamp")


# ---- author ---------------------------------------------------------------------------

@register("author_literal_ci", with_mapping(
    CHANGE_SELECT + " WHERE contains(lower(author_name), 'customer#00000012')"
    " OR contains(lower(author_email), 'customer#00000012')"))
def q_author_literal_ci(spark, sf):
    return change_out(FL.author_literal_ci(_flat(spark, sf), "CUSTOMER#00000012"))


@register("author_literal_cs", with_mapping(
    CHANGE_SELECT + " WHERE contains(author_name, 'Customer#00000013')"
    " OR contains(author_email, 'Customer#00000013')"))
def q_author_literal_cs(spark, sf):
    return change_out(FL.author_literal_cs(_flat(spark, sf), "Customer#00000013"))


@register("author_any_regex", with_mapping(
    CHANGE_SELECT + " WHERE regexp_matches(author_name || ' <' || author_email || '>', 'Customer#00000014[0-4] <')"
    " OR regexp_matches(author_name || ' <' || author_email || '>', '<building[.]customer[.]0000002')"))
def q_author_any_regex(spark, sf):
    return change_out(FL.author_any_regex(_flat(spark, sf), "Customer#00000014[0-4] < | <building[.]customer[.]0000002|"))


@register("author_mask", with_mapping(
    CHANGE_SELECT + " WHERE regexp_matches(author_name, '(?i)CUSTOMER#0000001[01]')"
    " OR regexp_matches(author_email, '(?i)CUSTOMER#0000001[01]')"
    " OR regexp_matches(author_name, '(?i)^house') OR regexp_matches(author_email, '(?i)^house')"))
def q_author_mask(spark, sf):
    return change_out(FL.author_mask(_flat(spark, sf), "CUSTOMER#0000001[01] | ^house"))


@register("author_stats_match", with_mapping(
    ", src AS (SELECT author_email, author_name, commit_hash, additions, deletions FROM changes)"
    + SCOREBOARD_FROM_SRC
    + "SELECT * FROM stats WHERE contains(lower(author_name), 'customer#00000002')"
    " OR contains(lower(author_email), 'customer#00000002')"
    " OR contains(lower(author_name), 'automobile.customer.0000001')"
    " OR contains(lower(author_email), 'automobile.customer.0000001')"))
def q_author_stats_match(spark, sf):
    stats = author_scoreboard(_flat(spark, sf), ordered=False)
    return FL.author_stats_match(stats, "Customer#00000002 | AUTOMOBILE.customer.0000001", ignore_empty_parts=True)


@register("current_user", with_mapping(
    CHANGE_SELECT + " WHERE regexp_matches(author_name, '(?i)Customer#000000077')"
    " OR regexp_matches(author_email, '(?i)Customer#000000077')"
    " OR regexp_matches(author_name, '(?i)furniture[.]customer[.]000000078@example[.]com')"
    " OR regexp_matches(author_email, '(?i)furniture[.]customer[.]000000078@example[.]com')"))
def q_current_user(spark, sf):
    query = FL.current_user(("Customer#000000077", "furniture[.]customer[.]000000078@example[.]com"), None)
    return change_out(FL.author_mask(_flat(spark, sf), query))


# ---- message --------------------------------------------------------------------------

@register("grep_regex", with_mapping(CHANGE_SELECT + " WHERE regexp_matches(commit_message, '(?m)^order 1[0-9]{2}$')"))
def q_grep_regex(spark, sf):
    return change_out(FL.grep_regex(_flat(spark, sf), "^order 1[0-9]{2}$"))


@register("grep_literal", with_mapping(CHANGE_SELECT + " WHERE contains(commit_message, 'URGENT F')"))
def q_grep_literal(spark, sf):
    return change_out(FL.grep_literal(_flat(spark, sf), "URGENT F"))


@register("grep_subject", with_mapping(
    CHANGE_SELECT + " WHERE contains(lower(replace(split_part(commit_message, chr(10), 1), '--', ' ')), '2-high o')"))
def q_grep_subject(spark, sf):
    return change_out(FL.grep_subject(_flat(spark, sf), "2-HIGH O"))


# ---- merges / paths / where -----------------------------------------------------------

@register("merges_only", with_mapping(CHANGE_SELECT + " WHERE n_parents > 1"))
def q_merges_only(spark, sf):
    return change_out(FL.merges_only(_flat(spark, sf)))


@register("include_paths", with_mapping(
    CHANGE_SELECT + " WHERE starts_with(file_paths, 'economy/') OR starts_with(file_paths, 'small/1')"))
def q_include_paths(spark, sf):
    return change_out(FL.paths(_flat(spark, sf), include=["economy/", "small/1"]))


@register("exclude_paths", with_mapping(
    CHANGE_SELECT + " WHERE file_paths IS NOT NULL AND NOT starts_with(file_paths, 'economy/')"
    " AND NOT starts_with(file_paths, 'large/')"))
def q_exclude_paths(spark, sf):
    return change_out(FL.paths(_flat(spark, sf), exclude=["economy/", "large/"]))


@register("include_exclude_paths", with_mapping(
    CHANGE_SELECT + " WHERE (starts_with(file_paths, 'promo/') OR starts_with(file_paths, 'standard/'))"
    " AND NOT starts_with(file_paths, 'promo/2')"))
def q_include_exclude_paths(spark, sf):
    return change_out(FL.paths(_flat(spark, sf), include=["promo/", "standard/"], exclude=["promo/2"]))


@register("drop_emptied_commits", with_mapping(
    ", kept AS (SELECT commit_hash, count(*) AS n_changes FROM changes"
    " WHERE starts_with(file_paths, 'medium/') AND NOT starts_with(file_paths, 'medium/1') GROUP BY commit_hash)"
    " SELECT commit_hash, CAST(n_changes AS BIGINT) AS n_changes FROM kept"))
def q_drop_emptied_commits(spark, sf):
    nested = FL.paths_nested(td.commits(spark, sf), include=["medium/"], exclude=["medium/1"])
    return nested.select("commit_hash", F.size("file_changes").cast("bigint").alias("n_changes"))


@register("where", with_mapping(CHANGE_SELECT + " WHERE additions > 40 AND change_type = 'D'"))
def q_where(spark, sf):
    return change_out(FL.where(_flat(spark, sf), "additions > 40 AND change_type = 'D'"))


@register("explode_changes", with_mapping(CHANGE_SELECT))
def q_explode_changes(spark, sf):
    return change_out(explode_changes(td.commits(spark, sf)))


@register("within_period", with_mapping(
    ", last AS (SELECT author_email, max(commit_date) AS end_date FROM changes GROUP BY author_email)"
    " SELECT c.commit_hash, c.author_email, c.file_paths, c.additions FROM changes c JOIN last USING (author_email)"
    " WHERE c.commit_date >= CAST(CAST(last.end_date AS DATE) - INTERVAL 3 MONTH AS TIMESTAMP)"
    " AND c.commit_date < CAST(CAST(last.end_date AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)"))
def q_within_period(spark, sf):
    """FLT-4 with a per-row end: each author's changes in the 3 months up to their latest commit
    (the end date is a grouped max joined back, not a window)."""
    ch = _flat(spark, sf)
    last = ch.groupBy("author_email").agg(F.max("commit_date").alias("end_date"))
    kept = FL.within_period(ch.join(last, "author_email"), "end_date", "3 months")
    return kept.select("commit_hash", "author_email", "file_paths", "additions")
