"""Scalar projections (PRJ-*) and report frames over the mapped history."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import scalar as X
from revlens.operators import filters as FL
from revlens.operators import reports as R
from revlens.operators.stats import author_scoreboard
from revlens.plans.catalog import SCOREBOARD_FROM_SRC, ntz, register, td, with_mapping

# ---- PRJ-1..11, 21 --------------------------------------------------------------------


@register("split_author", with_mapping(
    "SELECT commit_hash, author_name AS name, author_email AS email FROM commits"))
def q_split_author(spark, sf):
    heads = td.commit_heads(spark, sf)
    ident = F.concat(F.lit(" \t"), F.col("author_name"), F.lit("  <"), F.col("author_email"), F.lit(">"))
    name, email = X.split_author(ident)
    return heads.select("commit_hash", name.alias("name"), email.alias("email"))


@register("epoch_to_utc", with_mapping("SELECT commit_hash, commit_date AS ts FROM commits"))
def q_epoch_to_utc(spark, sf):
    heads = td.commit_heads(spark, sf)
    return heads.select("commit_hash", X.epoch_to_utc("commit_timestamp").alias("ts")).select("commit_hash", ntz("ts"))


@register("message_subject", with_mapping(
    "SELECT commit_hash, replace(split_part(commit_message, chr(10), 1), '--', ' ') AS subject FROM commits"))
def q_message_subject(spark, sf):
    heads = td.commit_heads(spark, sf)
    return heads.select("commit_hash", X.message_subject("commit_message").alias("subject"))


_KIND_SQL = ("CASE WHEN additions > 45 THEN 'copy' WHEN change_type = 'A' THEN 'add' "
             "WHEN change_type = 'D' THEN 'delete' WHEN change_type = 'M' THEN 'modify' END")


def _kind():
    return (F.when(F.col("additions") > 45, "copy").when(F.col("change_type") == "A", "add")
            .when(F.col("change_type") == "D", "delete").when(F.col("change_type") == "M", "modify"))


@register("change_type_code", with_mapping(
    f", k AS (SELECT commit_hash, file_paths, {_KIND_SQL} AS kind FROM changes WHERE file_paths IS NOT NULL)"
    " SELECT commit_hash, file_paths, kind, CASE kind WHEN 'add' THEN 'A' WHEN 'delete' THEN 'D'"
    " WHEN 'modify' THEN 'M' ELSE 'U' END AS code FROM k"))
def q_change_type_code(spark, sf):
    ch = td.changes(spark, sf).where(F.col("file_paths").isNotNull())
    k = ch.select("commit_hash", "file_paths", _kind().alias("kind"))
    return k.select("commit_hash", "file_paths", "kind", X.change_type_code("kind").alias("code"))


@register("root_change_flip", with_mapping(
    "SELECT commit_hash, file_paths, change_type,"
    " CASE WHEN n_parents = 0 AND change_type = 'D' THEN deletions ELSE additions END AS additions,"
    " CASE WHEN n_parents = 0 AND change_type = 'D' THEN CAST(0 AS BIGINT) ELSE deletions END AS deletions"
    " FROM changes"))
def q_root_change_flip(spark, sf):
    ch = td.changes(spark, sf)
    a, d = X.root_change_flip("parent_hashes", "change_type", "additions", "deletions")
    return ch.select("commit_hash", "file_paths", "change_type", a.alias("additions"), d.alias("deletions"))


_CP_CTE = (", cp AS (SELECT commit_hash, CASE WHEN change_type = 'M' AND additions > 45 THEN 'R' ELSE change_type END AS t,"
           " file_paths FROM changes WHERE file_paths IS NOT NULL),"
           " cp2 AS (SELECT commit_hash, t, CASE WHEN t = 'D' THEN NULL ELSE file_paths END AS new_path,"
           " CASE WHEN t = 'D' OR t = 'M' THEN file_paths WHEN t = 'R' THEN 'old/' || file_paths END AS old_path FROM cp)")


@register("change_path", with_mapping(
    _CP_CTE + " SELECT commit_hash, t AS change_type,"
    " CASE WHEN t = 'D' THEN coalesce(old_path, new_path) ELSE coalesce(new_path, old_path) END AS path,"
    " CASE WHEN t = 'R' THEN old_path END AS old_file_path FROM cp2"))
def q_change_path(spark, sf):
    ch = td.changes(spark, sf).where(F.col("file_paths").isNotNull())
    t = F.when((F.col("change_type") == "M") & (F.col("additions") > 45), "R").otherwise(F.col("change_type"))
    cp = ch.select("commit_hash", t.alias("t"), "file_paths")
    cp2 = cp.select(
        "commit_hash", "t",
        F.when(F.col("t") == "D", F.lit(None)).otherwise(F.col("file_paths")).alias("new_path"),
        F.when(F.col("t").isin("D", "M"), F.col("file_paths"))
        .when(F.col("t") == "R", F.concat(F.lit("old/"), F.col("file_paths"))).alias("old_path"),
    )
    path, old = X.change_path("t", "new_path", "old_path")
    return cp2.select("commit_hash", F.col("t").alias("change_type"), path.alias("path"), old.alias("old_file_path"))


@register("hash_text", with_mapping(
    "SELECT commit_hash, lower(hex(commit_hash)) AS hexed, lower(hex(lower(hex(commit_hash)))) AS doubled,"
    " commit_hash AS repaired FROM commits"))
def q_hash_text(spark, sf):
    heads = td.commit_heads(spark, sf)
    hexed = X.hash_text("commit_hash")
    doubled = X.hash_text(hexed)
    # repair undoes one level of hex on doubled ids: decode(unhex(x)) == hexed, then again -> hash
    once = F.decode(F.unhex(doubled), "UTF-8")
    return heads.select("commit_hash", hexed.alias("hexed"), doubled.alias("doubled"),
                        F.decode(F.unhex(once), "UTF-8").alias("repaired"))


@register("parse_parents", with_mapping(
    "SELECT commit_hash, CAST(n_parents AS INTEGER) AS n_parents, parents FROM commits"))
def q_parse_parents(spark, sf):
    heads = td.commit_heads(spark, sf)
    text = F.concat(F.lit("  "), F.array_join("parent_hashes", " \t "), F.lit(" "))
    arr = X.parse_parents(text)
    return heads.select("commit_hash", F.size(arr).alias("n_parents"), F.array_join(arr, " ").alias("parents"))


@register("parse_message", with_mapping("SELECT commit_hash, commit_message AS message FROM commits"))
def q_parse_message(spark, sf):
    heads = td.commit_heads(spark, sf)
    raw = F.concat(F.lit(X.MSG_START), F.lit(" \n"), F.col("commit_message"), F.lit("\n\n"), F.lit(X.MSG_END), F.lit("tail"))
    return heads.select("commit_hash", X.parse_message(raw).alias("message"))


@register("parse_iso_date", with_mapping(
    "SELECT commit_hash, commit_date AS parsed_z, commit_date AS parsed_offset, CAST(NULL AS TIMESTAMP) AS parsed_bad"
    " FROM commits"))
def q_parse_iso_date(spark, sf):
    heads = td.commit_heads(spark, sf)
    z = F.date_format("commit_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    off = F.date_format(F.col("commit_date") + F.expr("INTERVAL 5 HOURS 30 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'+05:30'")
    bad = F.concat(F.lit("not-a-date "), F.col("commit_hash"))
    out = heads.select(
        "commit_hash",
        X.parse_iso_date(z).alias("parsed_z"),
        X.parse_iso_date(off).alias("parsed_offset"),
        X.parse_iso_date(bad).alias("parsed_bad"),
    )
    return out.select("commit_hash", ntz("parsed_z"), ntz("parsed_offset"), ntz("parsed_bad"))


_TERM = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@register("count_text_lines", f"""
SELECT doc_id,
       CAST(CASE WHEN text = '' THEN 0
            ELSE len(string_split_regex(text, '{_TERM}'))
                 - CASE WHEN regexp_matches(text, '({_TERM})$') THEN 1 ELSE 0 END END AS BIGINT) AS n_lines
FROM documents
""")
def q_count_text_lines(spark, sf):
    docs = td.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", X.count_text_lines("text").alias("n_lines"))


@register("month_bucket", with_mapping("SELECT commit_hash, strftime(commit_date, '%Y-%m') AS month FROM commits"))
def q_month_bucket(spark, sf):
    heads = td.commit_heads(spark, sf)
    return heads.select("commit_hash", X.month_bucket("commit_date").alias("month"))


# ---- reports (PRJ-12..20) -------------------------------------------------------------

_SB = ", src AS (SELECT author_email, author_name, commit_hash, additions, deletions FROM changes)" + SCOREBOARD_FROM_SRC


@register("total_diff", with_mapping(_SB + "SELECT author_email, author_name, added + deleted AS total FROM stats"))
def q_total_diff(spark, sf):
    st = author_scoreboard(td.changes(spark, sf), ordered=False)
    return st.select("author_email", "author_name", X.total_diff("added", "deleted").alias("total"))


@register("scoreboard_report", with_mapping(_SB + """
SELECT rank,
       CASE WHEN length(author_name || ' <' || author_email || '>') > 45
            THEN substr(author_name || ' <' || author_email || '>', 1, 42) || '...'
            ELSE author_name || ' <' || author_email || '>' END AS author,
       CASE WHEN added > 0 THEN CAST(added AS VARCHAR) ELSE '-' END AS lines_added,
       CASE WHEN deleted > 0 THEN CAST(deleted AS VARCHAR) ELSE '-' END AS lines_deleted,
       total AS total_diff, commits, diff_decile AS diff_d, commit_decile AS comm_d
FROM stats"""))
def q_scoreboard_report(spark, sf):
    return R.scoreboard_report(author_scoreboard(td.changes(spark, sf), ordered=False))


_AUTHOR_Q = "Customer#00000010 | building.customer.00000011"
_AUTHOR_MASK_SQL = (
    "(regexp_matches(author_name, '(?i)Customer#00000010') OR regexp_matches(author_email, '(?i)Customer#00000010')"
    " OR regexp_matches(author_name, '(?i)building.customer.00000011')"
    " OR regexp_matches(author_email, '(?i)building.customer.00000011'))")
_MATCH_SQL = (
    "(contains(lower(author_name), 'customer#00000010') OR contains(lower(author_email), 'customer#00000010')"
    " OR contains(lower(author_name), 'building.customer.00000011')"
    " OR contains(lower(author_email), 'building.customer.00000011'))")
_AR_CTE = (", src AS (SELECT author_email, author_name, commit_hash, additions, deletions FROM changes WHERE "
           + _AUTHOR_MASK_SQL + ")" + SCOREBOARD_FROM_SRC
           + ", m AS (SELECT *, count(*) OVER () AS n_matches FROM stats WHERE " + _MATCH_SQL + ")")
_AR_SELECT = """
SELECT author_name || ' <' || author_email || '>' AS author,
       '#' || CAST(rank AS VARCHAR) || ' of ' || CAST(n_matches AS VARCHAR) AS rank_label,
       CASE WHEN added > 0 THEN CAST(added AS VARCHAR) ELSE '-' END AS lines_added,
       CASE WHEN deleted > 0 THEN CAST(deleted AS VARCHAR) ELSE '-' END AS lines_deleted,
       total AS total_diff, commits, diff_decile AS diff_d, commit_decile AS comm_d,
       'Top ' || printf('%.1f', round_even((rank - 1) / n_matches * 100.0, 1)) || '%' AS percentile,
       printf('%.0f', round_even(CASE WHEN commits > 0 THEN total / commits ELSE 0.0 END, 0)) || ' lines'
         AS avg_diff_per_commit
FROM m"""


def _author_specific_stats(spark, sf, query=_AUTHOR_Q):
    # D16: change rows are masked by the author query first; ranks are among the matches.
    masked = FL.author_mask(td.changes(spark, sf), query)
    return author_scoreboard(masked, ordered=False)


@register("author_report", with_mapping(_AR_CTE + _AR_SELECT))
def q_author_report(spark, sf):
    return R.author_report(_author_specific_stats(spark, sf), _AUTHOR_Q)


@register("percentile", with_mapping(
    _AR_CTE + " SELECT author_email, CAST((rank - 1) / n_matches * 100.0 AS DOUBLE) AS percentile FROM m"))
def q_percentile(spark, sf):
    st = _author_specific_stats(spark, sf)
    m = R._with_match_count(FL.author_stats_match(st, _AUTHOR_Q, ignore_empty_parts=True))
    return m.select("author_email", X.percentile(F.col("rank"), F.col("n_matches")).alias("percentile"))


@register("avg_diff_per_commit", with_mapping(
    _SB + " SELECT author_email, author_name,"
    " CAST(CASE WHEN commits > 0 THEN total / commits ELSE 0.0 END AS DOUBLE) AS avg_diff FROM stats"))
def q_avg_diff_per_commit(spark, sf):
    st = author_scoreboard(td.changes(spark, sf), ordered=False)
    return st.select("author_email", "author_name", X.avg_diff_per_commit("total", "commits").alias("avg_diff"))


@register("author_label", with_mapping(
    "SELECT commit_hash, CASE WHEN length(author_name || ' <' || author_email || '>') > 45"
    " THEN substr(author_name || ' <' || author_email || '>', 1, 42) || '...'"
    " ELSE author_name || ' <' || author_email || '>' END AS label FROM commits"))
def q_author_label(spark, sf):
    heads = td.commit_heads(spark, sf)
    return heads.select("commit_hash", X.author_label("author_name", "author_email").alias("label"))


@register("dash_if_zero", with_mapping(
    "SELECT commit_hash, file_paths, CASE WHEN additions > 0 THEN CAST(additions AS VARCHAR) ELSE '-' END AS added,"
    " CASE WHEN deletions - 3 > 0 THEN CAST(deletions - 3 AS VARCHAR) ELSE '-' END AS deleted FROM changes"))
def q_dash_if_zero(spark, sf):
    ch = td.changes(spark, sf)
    return ch.select("commit_hash", "file_paths", X.dash_if_zero("additions").alias("added"),
                     X.dash_if_zero(F.col("deletions") - 3).alias("deleted"))


_DIST_SQL = """
SELECT CAST({d} AS INTEGER) AS decile,
       CASE WHEN min({v}) = max({v}) THEN format('{{:,}}', min({v}))
            ELSE format('{{:,}}', min({v})) || '-' || format('{{:,}}', max({v})) END AS range,
       CAST(count(*) AS BIGINT) AS authors,
       CAST(min({v}) AS BIGINT) AS min_value, CAST(max({v}) AS BIGINT) AS max_value
FROM stats GROUP BY {d}"""


@register("diff_decile_distribution", with_mapping(_SB + _DIST_SQL.format(d="diff_decile", v="total")))
def q_diff_decile_distribution(spark, sf):
    return R.decile_distribution_report(author_scoreboard(td.changes(spark, sf), ordered=False), "diff")


@register("commit_decile_distribution", with_mapping(_SB + _DIST_SQL.format(d="commit_decile", v="commits")))
def q_commit_decile_distribution(spark, sf):
    return R.decile_distribution_report(author_scoreboard(td.changes(spark, sf), ordered=False), "commit")


@register("range_label", with_mapping(
    ", r AS (SELECT o_custkey, min(CAST(floor(o_totalprice) AS BIGINT)) AS lo, max(CAST(floor(o_totalprice) AS BIGINT)) AS hi"
    " FROM orders GROUP BY o_custkey)"
    " SELECT o_custkey, CASE WHEN lo = hi THEN format('{:,}', lo) ELSE format('{:,}', lo) || '-' || format('{:,}', hi)"
    " END AS label FROM r"))
def q_range_label(spark, sf):
    o = td.table(spark, sf, "orders")
    price = F.floor("o_totalprice").cast("bigint")
    r = o.groupBy("o_custkey").agg(F.min(price).alias("lo"), F.max(price).alias("hi"))
    return r.select("o_custkey", X.range_label("lo", "hi").alias("label"))


_PIVOT_Q = "Customer#000000100|"


@register("author_pivot", with_mapping(
    # the trailing '|' is an empty part: the change-row mask then keeps every row
    ", src AS (SELECT author_email, author_name, commit_hash, additions, deletions FROM changes)"
    + SCOREBOARD_FROM_SRC
    + ", m AS (SELECT *, count(*) OVER () AS n_matches FROM stats WHERE contains(lower(author_name), 'customer#000000100')"
    " OR contains(lower(author_email), 'customer#000000100'))"
    + ", rep AS (" + _AR_SELECT + ")"
    + """, wide AS (
  SELECT author AS author_key, author AS m1, rank_label AS m2, lines_added AS m3, lines_deleted AS m4,
         CAST(total_diff AS VARCHAR) AS m5, CAST(commits AS VARCHAR) AS m6, CAST(diff_d AS VARCHAR) AS m7,
         CAST(comm_d AS VARCHAR) AS m8, percentile AS m9, avg_diff_per_commit AS m10 FROM rep)
SELECT author_key, CAST(ordinal AS INTEGER) AS ordinal, metric, value FROM (
  SELECT author_key, 1 AS ordinal, 'Author' AS metric, m1 AS value FROM wide UNION ALL
  SELECT author_key, 2, 'Rank', m2 FROM wide UNION ALL
  SELECT author_key, 3, 'Lines Added', m3 FROM wide UNION ALL
  SELECT author_key, 4, 'Lines Deleted', m4 FROM wide UNION ALL
  SELECT author_key, 5, 'Total Diff', m5 FROM wide UNION ALL
  SELECT author_key, 6, 'Commits', m6 FROM wide UNION ALL
  SELECT author_key, 7, 'Diff Decile', m7 FROM wide UNION ALL
  SELECT author_key, 8, 'Commit Decile', m8 FROM wide UNION ALL
  SELECT author_key, 9, 'Percentile', m9 FROM wide UNION ALL
  SELECT author_key, 10, 'Avg Diff/Commit', m10 FROM wide)"""))
def q_author_pivot(spark, sf):
    return R.author_pivot(_author_specific_stats(spark, sf, _PIVOT_Q), _PIVOT_Q)
