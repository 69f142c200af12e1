"""Text and Parquet sources/sinks (SRC-1..9, SNK-1..6, FLT-19/20, JN-1, SET-1, AGG-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators.diff import merge_stats, touched_paths
from revlens.operators.reshape import assemble_commits, commit_parts, explode_changes
from revlens.plans.catalog import CHANGE_SELECT, change_out, register, td, with_mapping
from revlens.session import shared_path
from revlens.sources import logtext as LT
from revlens.sources import parquet as PQ


@register("log_roundtrip", with_mapping(CHANGE_SELECT))
def q_log_roundtrip(spark, sf):
    """SNK-6 then SRC-1..3 from storage: render, write, scan, parse, explode."""
    path = shared_path(spark, "log")
    LT.write_log(td.commits(spark, sf), path)
    return change_out(explode_changes(LT.read_log(spark, path)))


def _corrupted_records(spark, sf):
    """Rendered records; '5-LOW' commits lose their end marker, 'P' commits get a bad epoch."""
    heads = td.commits(spark, sf)
    rec = LT.commits_to_log(heads).select(
        F.substring_index("value", LT.FIELD_MARK, 1).alias("h"), "value")
    low = F.col("value").contains("---MSG_START---5-LOW")
    pending = F.col("value").rlike(r"---MSG_START---[^\n]* P\n")
    value = (
        F.when(low, F.replace(F.col("value"), F.lit(LT.MSG_END), F.lit("---MSG-END---")))
        .when(pending, F.regexp_replace("value", r"\t([0-9]+)@@@FIELD@@@", "\tx$1@@@FIELD@@@"))
        .otherwise(F.col("value"))
    )
    return rec.select(value.alias("value"))


_BAD_SQL = "(commit_message LIKE '5-LOW%' OR commit_message LIKE '% P' || chr(10) || '%')"


@register("drop_malformed", with_mapping(f"SELECT commit_hash FROM commits WHERE NOT {_BAD_SQL}"))
def q_drop_malformed(spark, sf):
    return LT.log_parse(_corrupted_records(spark, sf)).select("commit_hash")


@register("log_rejects", with_mapping(f"SELECT commit_hash FROM commits WHERE {_BAD_SQL}"))
def q_log_rejects(spark, sf):
    rej = LT.log_parse(_corrupted_records(spark, sf), keep_rejects=True)
    return rej.select(F.substring_index("value", LT.FIELD_MARK, 1).alias("commit_hash"))


@register("file_stat_parse", with_mapping(CHANGE_SELECT))
def q_file_stat_parse(spark, sf):
    """SRC-3 + FLT-20: file blocks padded with diff headers, hex lines, bad widths and numbers."""
    commits = td.commits(spark, sf)
    noise = F.concat(
        F.lit("\n\n  diff --git a/x b/x\nindex 1111111..2222222 100644\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n"),
        F.sha1(F.substring_index("value", LT.FIELD_MARK, 1)), F.lit("\n10\t5\nabc\tdef\tf\n\tf\nM\n7\t8\t9\tpath\textra\n"),
    )
    rec = LT.commits_to_log(commits)
    rec = rec.select(F.concat("value", noise).alias("value"))
    return change_out(explode_changes(LT.log_parse(rec)))


def _numstat_added():
    return (F.when(F.col("change_type") == "D", F.concat(F.lit("x"), F.col("additions").cast("string")))
            .when(F.col("additions") > 45, F.lit("-"))
            .otherwise(F.col("additions").cast("string")))


@register("numstat_parse", with_mapping(
    "SELECT commit_hash, file_path || chr(9) || 'tail' AS file_path,"
    " CASE WHEN additions > 45 THEN 0 ELSE additions END AS additions, deletions, '' AS change_type"
    " FROM files_pos WHERE change_type <> 'D'"))
def q_numstat_parse(spark, sf):
    rows = td.file_rows_pos(spark, sf)
    lines = rows.select("commit_hash", "pos", F.concat_ws("\t", _numstat_added(), F.col("deletions").cast("string"),
                                                          F.col("file_path"), F.lit("tail ")).alias("value"))
    return LT.numstat_parse(lines).drop("pos")


def _name_status_lines(spark, sf, keep=None):
    rows = td.file_rows_pos(spark, sf)
    if keep is not None:
        rows = rows.where(keep)
    ren = (F.col("change_type") == "M") & (F.col("additions") > 45)
    value = F.when(ren, F.concat(F.lit("R100\told/"), F.col("file_path"), F.lit("\t"), F.col("file_path"))) \
        .otherwise(F.concat(F.col("change_type"), F.lit("\t"), F.col("file_path")))
    return rows.select("commit_hash", "pos", value.alias("value"))


_NS_SQL = ("SELECT commit_hash, CASE WHEN change_type = 'M' AND additions > 45 THEN 'R100' ELSE change_type END"
           " AS change_type, file_path,"
           " CASE WHEN change_type = 'M' AND additions > 45 THEN 'old/' || file_path END AS old_file_path,"
           " CAST(0 AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions FROM files_pos")


@register("name_status_parse", with_mapping(_NS_SQL))
def q_name_status_parse(spark, sf):
    return LT.name_status_parse(_name_status_lines(spark, sf)).drop("pos")


def _two_stat_tables(spark, sf):
    rows = td.file_rows_pos(spark, sf)
    numstat = LT.numstat_parse(rows.where(F.col("deletions") != 3).select(
        "commit_hash", "pos",
        F.concat_ws("\t", F.col("additions").cast("string"), F.col("deletions").cast("string"),
                    F.col("file_path")).alias("value")))
    ns = LT.name_status_parse(_name_status_lines(spark, sf, F.col("deletions") != 5))
    return numstat, ns


_JN1_SQL = """
, ns0 AS (SELECT commit_hash, pos, file_path, additions, deletions FROM files_pos WHERE deletions <> 3),
ns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash, file_path ORDER BY pos DESC) AS rn
                     FROM ns0) WHERE rn = 1),
st0 AS (SELECT commit_hash, pos, file_path,
               CASE WHEN change_type = 'M' AND additions > 45 THEN 'R100' ELSE change_type END AS change_type
        FROM files_pos WHERE deletions <> 5),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash, file_path ORDER BY pos DESC) AS rn
                     FROM st0) WHERE rn = 1)
"""


@register("merge_stats", with_mapping(_JN1_SQL + """
SELECT coalesce(ns.commit_hash, st.commit_hash) AS commit_hash, coalesce(ns.file_path, st.file_path) AS file_path,
       coalesce(ns.additions, 0) AS additions, coalesce(ns.deletions, 0) AS deletions,
       coalesce(st.change_type, 'U') AS change_type
FROM ns FULL OUTER JOIN st ON ns.commit_hash = st.commit_hash AND ns.file_path = st.file_path"""))
def q_merge_stats(spark, sf):
    numstat, ns = _two_stat_tables(spark, sf)
    return merge_stats(numstat, ns)


@register("touched_paths", with_mapping(_JN1_SQL + """
SELECT commit_hash, file_path FROM ns0 UNION SELECT commit_hash, file_path FROM st0"""))
def q_touched_paths(spark, sf):
    numstat, ns = _two_stat_tables(spark, sf)
    return touched_paths(numstat, ns)


@register("patch_line_stats", with_mapping("""
, r AS (SELECT commit_hash, file_path, additions, deletions,
               row_number() OVER (PARTITION BY commit_hash, file_path ORDER BY additions DESC, deletions DESC) AS rn
        FROM files_pos WHERE change_type <> 'D')
SELECT commit_hash, file_path, additions, deletions FROM r WHERE rn = 1"""))
def q_patch_line_stats(spark, sf):
    rows = td.file_rows_pos(spark, sf)
    p = F.col("file_path")
    kept = ~F.coalesce(F.col("change_type") == "D", F.lit(False))

    def section(x):
        plus = F.when(x["kept"], F.concat(F.lit("+++ b/"), p)).otherwise(F.lit("+++ /dev/null"))
        return F.concat(
            F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\nindex 1111111..2222222 100644\n--- a/"), p, F.lit("\n"),
            plus, F.lit("\n@@ -1 +1 @@\n"),
            F.repeat(F.lit("+added line\n"), x["additions"].cast("int")),
            F.repeat(F.lit("-removed line\n"), x["deletions"].cast("int")),
        )

    # a text holds the sections of one path of a commit: bounded by that path's own lines, however large the commit;
    # it is rendered where it is read, so only numbers are shuffled
    per_path = rows.groupBy("commit_hash", "file_path").agg(
        F.sort_array(F.collect_list(F.struct("additions", "deletions", kept.alias("kept")))).alias("secs"))
    patches = per_path.select("commit_hash", F.array_join(F.transform("secs", section), "").alias("patch"))
    return LT.patch_line_stats(patches)


@register("patch_scan", with_mapping("""
, r AS (SELECT commit_hash, CASE WHEN additions % 7 = 3 THEN 'dír ' || file_path ELSE file_path END AS file_path, additions, deletions, pos
        FROM files_pos WHERE change_type <> 'D'),
n AS (SELECT *, row_number() OVER (PARTITION BY commit_hash, file_path ORDER BY pos DESC) AS rn FROM r)
SELECT commit_hash, file_path, additions, deletions FROM n WHERE rn = 1"""))
def q_patch_scan(spark, sf):
    """SRC-6 from storage: the history as ``log -p`` dumps of several files, with quoted paths, deleted
    (/dev/null) and binary sections and commits without one, read back by sections."""
    from revlens.sources.patchtext import patch_scan

    path = shared_path(spark, "patches")
    rows = td.file_rows_pos(spark, sf)
    odd, p = F.col("additions") % 7 == 3, F.col("file_path")
    quote = lambda side: F.when(odd, F.concat(F.lit(f'"{side}/d\\303\\255r '), p, F.lit('"'))).otherwise(F.concat(F.lit(f"{side}/"), p))
    plus = F.when(F.col("change_type") == "D", F.lit("/dev/null")).otherwise(quote("b"))

    def section(x):
        return F.concat(
            F.lit("diff --git "), x["a"], F.lit(" "), x["b"], F.lit("\nindex 1111111..2222222 100644\n--- "), x["a"], F.lit("\n+++ "),
            x["plus"], F.lit("\n@@ -1 +1 @@\n commit 0123456789 is no header\n"),
            F.repeat(F.lit("+added line\n"), x["additions"].cast("int")), F.repeat(F.lit("-removed line\n"), x["deletions"].cast("int")),
            F.lit("diff --git a/logo.png b/logo.png\nindex 1111111..2222222 100644\nBinary files a/logo.png and b/logo.png differ\n"))

    # texts are rendered where they are written: the shuffle moves names and numbers
    sections = rows.groupBy("commit_hash").agg(F.sort_array(F.collect_list(F.struct(
        "pos", quote("a").alias("a"), quote("b").alias("b"), plus.alias("plus"), "additions", "deletions"))).alias("secs"))
    header = F.concat(F.lit("commit "), F.sha1("commit_hash"), F.lit("\nAuthor: a <a@b>\n\n    "), F.col("commit_hash"), F.lit("\n\n"))
    dumps = td.commit_heads(spark, sf).select("commit_hash").join(sections, "commit_hash", "left").select(
        F.concat(header, F.coalesce(F.array_join(F.transform("secs", section), ""), F.lit(""))).alias("value"))
    dumps.write.option("compression", "gzip").text(path)  # a file a shuffle partition, each read as one split
    names = td.commit_heads(spark, sf).select("commit_hash", F.sha1("commit_hash").alias("sha"))
    found = patch_scan(spark, path).withColumnRenamed("commit_hash", "sha")
    return found.join(names, "sha").select("commit_hash", "file_path", "additions", "deletions")


@register("patch_totals_from_text", with_mapping("""
, r AS (SELECT commit_hash, file_path, additions, deletions,
               row_number() OVER (PARTITION BY commit_hash, file_path ORDER BY additions DESC, deletions DESC) AS rn
        FROM files_pos WHERE change_type <> 'D')
SELECT commit_hash, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions
FROM r WHERE rn = 1 GROUP BY commit_hash"""))
def q_patch_totals_from_text(spark, sf):
    from revlens.operators.stats import patch_totals

    return patch_totals(q_patch_line_stats(spark, sf))


@register("commits_to_json", with_mapping("SELECT commit_hash, parents, commit_date, CAST(n_changes AS BIGINT) AS n_changes"
                                          " FROM commits JOIN (SELECT ok, count(file_path) AS n_changes FROM commits"
                                          " LEFT JOIN files USING (ok) GROUP BY ok) USING (ok)"))
def q_commits_to_json(spark, sf):
    """SNK-5 then read back with an explicit schema."""
    path = shared_path(spark, "json")
    LT.write_json(td.commits(spark, sf), path)
    back = LT.read_json(spark, path)
    return back.select("commit_hash", F.array_join("parent_hashes", " ").alias("parents"),
                       F.col("commit_date").cast("timestamp_ntz").alias("commit_date"),
                       F.size("file_changes").cast("bigint").alias("n_changes"))


@register("json_array_roundtrip", with_mapping("SELECT commit_hash, parents, commit_date, CAST(n_changes AS BIGINT) AS n_changes"
                                               " FROM commits JOIN (SELECT ok, count(file_path) AS n_changes FROM commits"
                                               " LEFT JOIN files USING (ok) GROUP BY ok) USING (ok)"))
def q_json_array_roundtrip(spark, sf):
    """SNK-5 as one JSON array over many files, written and read in parallel."""
    path = shared_path(spark, "jsonarray")
    LT.write_json_array(td.commits(spark, sf), path, compression="gzip")
    back = LT.read_json_array(spark, path)
    return back.select("commit_hash", F.array_join("parent_hashes", " ").alias("parents"),
                       F.col("commit_date").cast("timestamp_ntz").alias("commit_date"),
                       F.size("file_changes").cast("bigint").alias("n_changes"))


# ---- commits in bounded parts ---------------------------------------------------------
# Every third order's files form one bulk commit (a third of all rows); a part holds 500 changes.

_PART = 500


def _bulk_changes(spark, sf):
    bulk = F.col("commit_hash").cast("long") % 3 == 0
    one = {"commit_hash": F.lit("bulk"), "parent_hashes": F.array(F.lit("0")), "author_name": F.lit("importer"),
           "author_email": F.lit("importer@example.com"), "commit_date": F.timestamp_seconds(F.lit(946_684_800)),
           "commit_timestamp": F.lit(946_684_800).cast("bigint"), "commit_message": F.lit("bulk import\nof a third")}
    return td.changes(spark, sf).withColumns({c: F.when(bulk, x).otherwise(F.col(c)) for c, x in one.items()})


_PARTS_SQL = with_mapping(f"""
, bulk AS (SELECT CASE WHEN ok % 3 = 0 THEN 'bulk' ELSE commit_hash END AS commit_hash,
                  CASE WHEN ok % 3 = 0 THEN 'importer' ELSE author_name END AS author_name,
                  CASE WHEN ok % 3 = 0 THEN 946684800 ELSE commit_timestamp END AS commit_timestamp,
                  file_paths, additions, deletions FROM changes),
placed AS (SELECT *, CASE WHEN file_paths IS NULL THEN 0 ELSE (row_number() OVER (
                     PARTITION BY commit_hash ORDER BY file_paths, additions, deletions) - 1) // {_PART} END AS part
           FROM bulk WHERE commit_hash <> 'bulk' OR file_paths IS NOT NULL)
SELECT commit_hash, author_name, CAST(commit_timestamp AS BIGINT) AS commit_timestamp, CAST(part AS INTEGER) AS part,
       count(file_paths) AS n_changes, min(file_paths) AS first_path, max(file_paths) AS last_path,
       CAST(sum(deletions) AS BIGINT) AS deletions
FROM placed GROUP BY commit_hash, author_name, commit_timestamp, part""")


def _part_facts(parts):
    paths = F.col("file_changes.file_path")
    return parts.select("commit_hash", "author_name", "commit_timestamp", "part", F.size("file_changes").cast("bigint").alias("n_changes"),
                        F.array_min(paths).alias("first_path"), F.array_max(paths).alias("last_path"),
                        F.aggregate("file_changes.deletions", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("deletions"))


@register("commit_parts", _PARTS_SQL)
def q_commit_parts(spark, sf):
    """AGG-5 in bounded rows: parts of at most 500 changes, also of a commit with a third of all rows."""
    return _part_facts(commit_parts(_bulk_changes(spark, sf), _PART))


@register("log_parts_roundtrip", _PARTS_SQL)
def q_log_parts_roundtrip(spark, sf):
    """SNK-6 of parts, then SRC-1..3: consecutive records of a commit, read back with their numbers."""
    path = shared_path(spark, "logparts")
    LT.write_log(commit_parts(_bulk_changes(spark, sf), _PART), path)
    return _part_facts(LT.read_log(spark, path, parts=True))


@register("json_parts_roundtrip", _PARTS_SQL)
def q_json_parts_roundtrip(spark, sf):
    """SNK-5 of parts as one JSON array over many files, read back in parallel."""
    path = shared_path(spark, "jsonparts")
    LT.write_json_array(commit_parts(_bulk_changes(spark, sf), _PART), path, compression="gzip")
    return _part_facts(LT.read_json_array(spark, path, parts=True))


# ---- Parquet with provenance ----------------------------------------------------------

_PQ_SELECT = ("SELECT commit_hash, parents, author_name, author_email, commit_date, commit_timestamp, commit_message,"
              " file_paths, change_type, additions, deletions, coalesce(old_file_path, '') AS old_file_path FROM changes")


@register("parquet_roundtrip", with_mapping(_PQ_SELECT))
def q_parquet_roundtrip(spark, sf):
    """SNK-1 + SNK-3 then SRC-7 (version gate passes)."""
    path = shared_path(spark, "pq")
    PQ.write_changes(td.changes(spark, sf), path, since="1995-01-01", until="2001-12-31")
    df, _ = PQ.read_changes(spark, path)
    return change_out(df)


@register("normalize_for_sink", with_mapping(
    "SELECT commit_hash, coalesce(file_paths, 'None') AS file_paths, coalesce(change_type, 'None') AS change_type,"
    " coalesce(old_file_path, '') AS old_file_path FROM changes"))
def q_normalize_for_sink(spark, sf):
    """SNK-3 with the reference's 'None' text, checked by SNK-4 before the write."""
    path = shared_path(spark, "pqnone")
    PQ.write_changes(td.changes(spark, sf), path, none_text=True)
    df, _ = PQ.read_changes(spark, path)
    return df.select("commit_hash", "file_paths", "change_type", "old_file_path")


@register("write_empty", with_mapping(_PQ_SELECT + " WHERE author_name = 'nobody'"))
def q_write_empty(spark, sf):
    """SNK-2: no match still writes a typed (zero-row) data set that loads."""
    path = shared_path(spark, "pqempty")
    PQ.write_changes(td.changes(spark, sf).where(F.col("author_name") == "nobody"), path)
    df, _ = PQ.read_changes(spark, path)
    return change_out(df)


@register("period_from_metadata", with_mapping(
    _PQ_SELECT + " WHERE commit_date >= TIMESTAMP '1999-02-01 00:00:00'"
    " AND commit_date <= TIMESTAMP '1999-04-30 23:59:59.999999'"))
def q_period_from_metadata(spark, sf):
    """SRC-8: the stored window is applied to the loaded change set."""
    from revlens.operators.filters import date_range

    path = shared_path(spark, "pqwin")
    PQ.write_changes(td.changes(spark, sf), path, since="1999-02-01", until="1999-04-30")
    df, meta = PQ.read_changes(spark, path)
    w = PQ.period_from_metadata(meta)
    return change_out(date_range(df, w.since, w.until))


@register("version_gate_forced", with_mapping(_PQ_SELECT))
def q_version_gate_forced(spark, sf):
    """SRC-7: a data set written with another major version loads only with force=True."""
    import warnings

    path = shared_path(spark, "pqv2")
    PQ.write_changes(td.changes(spark, sf), path, version="2.0")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df, _ = PQ.read_changes(spark, path, force=True)
    return change_out(df)


_FACTS = "SELECT '{}' AS data_version, '{}' AS since, '{}' AS until, count(*) AS n_rows FROM changes WHERE {}"


@register("version_audit", with_mapping(_FACTS.format("1.0", "1992-01-01", "1996-12-31", "commit_date < TIMESTAMP '1997-01-01'") + " UNION ALL "
                                        + _FACTS.format("2.0", "1997-01-01", "", "commit_date >= TIMESTAMP '1997-01-01'")))
def q_version_audit(spark, sf):
    """SRC-7 over all files: a set written as 1.0 and appended to as 2.0, audited from its footers."""
    path = shared_path(spark, "pqaudit")
    changes = td.changes(spark, sf)
    PQ.write_changes(changes.where("commit_date < '1997-01-01'"), path, since="1992-01-01", until="1996-12-31")
    PQ.write_changes(changes.where("commit_date >= '1997-01-01'"), path, since="1997-01-01", version="2.0", mode="append")
    found = PQ.audit_versions(spark.read.parquet(path))
    return found.select("data_version", "since", "until", "n_rows")


@register("version_gate_mixed", with_mapping("SELECT 'change set has data_version 1.0, 2.0, this library reads 1.0' AS refused, count(*) AS n_rows FROM changes"))
def q_version_gate_mixed(spark, sf):
    """SRC-7 on mixed files: refused without ``force`` (file counts left out), whole with it."""
    import re
    import warnings

    path = shared_path(spark, "pqmixed")
    changes = td.changes(spark, sf)
    PQ.write_changes(changes.where("change_type <> 'D'"), path)
    PQ.write_changes(changes.where("coalesce(change_type, 'D') = 'D'"), path, version="2.0", mode="append")
    try:
        PQ.read_changes(spark, path)
        refused = "not refused"
    except PQ.VersionMismatch as e:
        refused = re.sub(r" in \d+ files?", "", str(e)).partition(";")[0]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df, _ = PQ.read_changes(spark, path, force=True)
    return df.agg(F.lit(refused).alias("refused"), F.count("*").alias("n_rows"))


@register("log_scan", with_mapping("SELECT commit_hash FROM commits"))
def q_log_scan(spark, sf):
    """SRC-1 alone: records of a dump written in several files, one row per commit."""
    path = shared_path(spark, "scan")
    # as many files as there are shuffle partitions; by the hash, as the rows lie already, Spark would leave the step out
    LT.write_log(assemble_commits(td.changes(spark, sf)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), path)
    return LT.log_scan(spark, path).select(F.substring_index("value", LT.FIELD_MARK, 1).alias("commit_hash"))


@register("partitioned_window", with_mapping(
    _PQ_SELECT + " WHERE commit_date >= TIMESTAMP '1997-11-15 00:00:00'"
    " AND commit_date <= TIMESTAMP '1998-02-10 23:59:59.999999'"))
def q_partitioned_window(spark, sf):
    """SNK-1 month-partitioned, then SRC-10 on it: the window becomes a partition filter."""
    from revlens.plans.facade import get_changes

    path = shared_path(spark, "pqmonth")
    PQ.write_changes(td.changes(spark, sf), path, partition_by_month=True)
    return change_out(get_changes(spark, path, fmt="parquet", since="1997-11-15", until="1998-02-10"))


@register("partitioned_window_offset", with_mapping(
    _PQ_SELECT + " WHERE commit_date >= TIMESTAMP '1997-10-31 19:00:00' AND commit_date <= TIMESTAMP '1998-01-31 20:00:00'"))
def q_partitioned_window_offset(spark, sf):
    """Month pruning with bounds given in other offsets than UTC: no month of the window is lost."""
    from revlens.plans.facade import get_changes

    path = shared_path(spark, "pqoffset")
    PQ.write_changes(td.changes(spark, sf), path, partition_by_month=True)
    return change_out(get_changes(spark, path, fmt="parquet", since="1997-11-01T00:00:00+05:00", until="1998-01-31T12:00:00-08:00"))


@register("name_status_dict", with_mapping(
    "SELECT commit_hash, CASE WHEN change_type = 'M' AND additions > 45 THEN 'R100' ELSE change_type END AS change_type,"
    " file_path, CAST(NULL AS VARCHAR) AS old_file_path, CAST(0 AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions"
    " FROM files_pos"))
def q_name_status_dict(spark, sf):
    """SRC-5, dict variant: type as written, last part as the path, no old path."""
    return LT.name_status_parse(_name_status_lines(spark, sf), dict_variant=True).drop("pos")
