"""History text: marker-delimited logs, numstat / name-status lines, unified diffs (SRC-1..6,
FLT-19/20) and the inverse renderers (SNK-5/6).

Records are split by the text reader itself (``lineSep``), so a dump is read in parallel splits
and every commit is one row; all parsing is column expressions and higher-order functions
(``split``/``filter``/``transform``) evaluated inside whole-stage codegen. No Python UDF.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.scalar import MSG_END, MSG_START, parse_message, parse_parents, strip_ws
from revlens.schema import COMMIT_COLUMNS, FILE_CHANGE
from revlens.session import persist_rows, shuffles_released

# The record and field markers of the history dump format.
COMMIT_MARK = "@@@COMMIT@@@"
FIELD_MARK = "@@@FIELD@@@"

#: First line after the message in the parts of a commit but the first (``commit_parts``): a line without a tab,
#: which every parser of the format skips.
PART_MARK = "@@@PART@@@"

# Prefixes of diff header lines that are not file changes.
NOISE_PREFIXES = ("diff --git", "old mode", "new mode", "index", "--- a/", "+++ b/", "@@ - ")

# The line breaks of Python's str.splitlines() but the line feed.
_OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

_FILE_CHANGE_DDL = "array<struct<file_path:string,additions:bigint,deletions:bigint,change_type:string,old_file_path:string>>"


def keep_parsed(df: DataFrame, parsed: Column, keep: Column, carry=()) -> DataFrame:
    """Rows whose ``parsed`` struct satisfies ``keep`` (over its fields), flattened next to ``carry``.

    A plain ``select(...).where(...)`` lets Catalyst push the filter below the projection by
    inlining the parse expressions, so every split/regex runs again inside the filter. No filter goes
    below the generator that flattens the struct, so each row is parsed exactly once, in generated code.
    """
    return df.select(*carry, F.inline(F.array(parsed))).where(keep)


# ---- SRC-1 ----------------------------------------------------------------------------

def log_scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC-1: one row per commit record (``value``); blank chunks dropped.

    The record separator is the commit marker, so Hadoop's line reader splits large dumps
    at record boundaries across tasks.
    """
    reader = spark.read.option("lineSep", COMMIT_MARK)
    df = reader.text(paths if isinstance(paths, list) else [paths])
    return df.where(F.col("value").rlike(r"\S"))  # stops at the first non-blank character


# ---- SRC-3 / FLT-20 -------------------------------------------------------------------

def is_noise_line(line: Column) -> Column:
    """FLT-20: blank lines, diff headers and bare 40-hex lines are skipped."""
    pred = line == ""
    for p in NOISE_PREFIXES:
        pred = pred | line.startswith(p)
    return pred | ((F.length(line) == 40) & line.rlike("^[0-9a-fA-F]{40}$"))


# Python int() text: optional whitespace and sign around decimal digits.
_INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def to_int(part: Column) -> Column:
    """Text -> bigint, null when not an integer. The regex guard keeps failing rows off the
    exception path of a failed cast (dirty input stays as fast as clean input)."""
    return F.when(part.rlike(_INT_TEXT), F.trim(part).try_cast("bigint"))


def _count(part: Column) -> Column:
    return F.when(part == "-", F.lit(0).cast("bigint")).otherwise(to_int(part))


def file_stat_parse(block: Column) -> Column:
    """SRC-3: the lines after the message -> array<FILE_CHANGE>.

    Lines are stripped first (so ``10\\t5\\tM\\t`` has 3 parts, D18); 4 parts = add/del/type/path,
    3 parts = add/del/path with type ''; other widths and non-numeric counts are dropped;
    ``-`` (binary) counts as 0.
    """
    tabbed = F.filter(F.split(F.coalesce(block, F.lit("")), "\n"), lambda ln: F.contains(ln, F.lit("\t")))  # no other has 3 parts
    lines = F.transform(tabbed, lambda ln: strip_ws(ln))
    kept = F.filter(lines, lambda ln: ~is_noise_line(ln))
    parts = F.filter(F.transform(kept, lambda ln: F.split(ln, "\t")), lambda p: F.size(p).isin(3, 4))

    def to_struct(p: Column) -> Column:
        four = F.size(p) == 4
        return F.struct(
            F.when(four, F.get(p, 3)).otherwise(F.get(p, 2)).alias("file_path"),
            _count(F.get(p, 0)).alias("additions"),
            _count(F.get(p, 1)).alias("deletions"),
            F.when(four, F.get(p, 2)).otherwise(F.lit("")).alias("change_type"),
            F.lit(None).cast("string").alias("old_file_path"),
        )

    parsed = F.transform(parts, to_struct)
    return F.filter(parsed, lambda s: s["additions"].isNotNull() & s["deletions"].isNotNull())


# ---- SRC-2 / FLT-19 -------------------------------------------------------------------

def _stage(records: DataFrame, value_col: str) -> DataFrame:
    """Split each record once into its pieces (kept as columns: each is used several times)."""
    v = F.col(value_col)
    end_at = F.instr(v, MSG_END)
    staged = records.select(
        v.alias("_raw"),
        end_at.alias("_end"),
        F.split(F.substring_index(v, MSG_END, 1), FIELD_MARK).alias("_fields"),
        strip_ws(F.substr(v, end_at + F.lit(len(MSG_END)))).alias("_tail"),
    )
    return staged.select(
        "*", F.split(F.coalesce(F.get(F.col("_fields"), 4), F.lit("")), "\t").alias("_date_parts"))


def _parse_record(empty_message_fallback: bool) -> dict[str, Column]:
    fields, date_parts = F.col("_fields"), F.col("_date_parts")
    hash_part = F.replace(F.get(fields, 0), F.lit(COMMIT_MARK), F.lit(""))
    date_text = F.replace(F.get(date_parts, 0), F.lit("Z"), F.lit("+00:00"))
    raw_msg = F.concat(F.coalesce(F.get(fields, 5), F.lit("")), F.lit(MSG_END))
    commit_date = F.when(F.size(date_parts) == 2, F.try_to_timestamp(date_text))
    epoch = F.when(F.size(date_parts) == 2, to_int(F.get(date_parts, 1)))
    number = F.regexp_extract(F.substring_index("_tail", "\n", 1), f"^{PART_MARK}([0-9]{{1,9}})$", 1)
    valid = (F.col("_end") > 0) & (F.size(fields) >= 6) & commit_date.isNotNull() & epoch.isNotNull()
    return {
        "commit_hash": hash_part,
        "parent_hashes": parse_parents(F.get(fields, 1)),
        "author_name": F.get(fields, 2),
        "author_email": F.get(fields, 3),
        "commit_date": commit_date,
        "commit_timestamp": epoch,
        "commit_message": parse_message(raw_msg, empty_message_fallback),
        "file_changes": file_stat_parse(F.col("_tail")),
        "part": F.coalesce(F.when(F.col("_tail").startswith(PART_MARK), number.try_cast("int")), F.lit(0)),
        "_valid": F.coalesce(valid, F.lit(False)),
    }


def log_parse(records: DataFrame, value_col: str = "value", empty_message_fallback: bool = False,
              keep_rejects: bool = False, parts: bool = False) -> DataFrame:
    """SRC-2 (+SRC-3, FLT-19): commit records -> nested COMMIT rows. A commit written in parts is as many rows,
    which explode to the same flat changes; ``parts`` adds their number (column ``part``, 0 for the first).

    A record without the end-of-message marker, with fewer than 6 fields, or with a bad
    date / epoch is dropped; ``keep_rejects=True`` returns those raw records instead.
    """
    staged = _stage(records, value_col)
    cols = _parse_record(empty_message_fallback)
    if keep_rejects:
        rej = F.struct(F.col("_raw").alias("value"), cols["_valid"].alias("_valid"))
        return keep_parsed(staged, rej, ~F.col("_valid")).select("value")
    parsed = F.struct(*[c.alias(n) for n, c in cols.items()])
    out = keep_parsed(staged, parsed, F.col("_valid"))
    return out.select(*COMMIT_COLUMNS, *(["part"] if parts else []), F.col("file_changes").cast(_FILE_CHANGE_DDL))


def read_log(spark: SparkSession, paths, **opts) -> DataFrame:
    """SRC-1..3: a history dump on storage -> nested commits."""
    return log_parse(log_scan(spark, paths), **opts)


def log_rejects(spark: SparkSession, paths) -> DataFrame:
    """FLT-19: the malformed records of a dump."""
    return log_parse(log_scan(spark, paths), keep_rejects=True)


# ---- SRC-4 / SRC-5 --------------------------------------------------------------------

def numstat_parse(lines: DataFrame, value_col: str = "value", cli_variant: bool = False) -> DataFrame:
    """SRC-4: ``add\\tdel\\tpath`` lines -> (file_path, additions, deletions, change_type='').

    Fewer than 3 parts, a bad number or a blank path -> dropped; extra tabs belong to the path
    (split limit 3). ``cli_variant``: bare 40-hex header lines are skipped and a 4-part line
    takes its 4th column as the path.
    """
    v = F.col(value_col)
    df = lines.where(~v.rlike("^[0-9a-fA-F]{40}$")) if cli_variant else lines
    carry = [c for c in df.columns if c != value_col]
    df = df.select(*carry, (F.split(v, "\t") if cli_variant else F.split(v, "\t", 3)).alias("_parts"))
    parts = F.col("_parts")
    if cli_variant:
        path = F.when(F.size(parts) == 4, F.get(parts, 3)).when(F.size(parts) == 3, F.get(parts, 2))
        keep_width = F.size(parts).isin(3, 4)
    else:
        path = F.get(parts, 2)
        keep_width = F.size(parts) >= 3
    parsed = F.struct(
        strip_ws(path).alias("file_path"),
        _count(F.get(parts, 0)).alias("additions"),
        _count(F.get(parts, 1)).alias("deletions"),
        F.lit("").alias("change_type"),
        keep_width.alias("_ok"),
    )
    out = keep_parsed(df, parsed, F.col("_ok") & F.col("additions").isNotNull() & F.col("deletions").isNotNull()
                      & (F.col("file_path") != ""), carry)
    return out.drop("_ok")


def name_status_parse(lines: DataFrame, value_col: str = "value", dict_variant: bool = False) -> DataFrame:
    """SRC-5: ``M\\tp``, ``R100\\told\\tnew``, ``C090\\tsrc\\tdst`` -> (change_type, file_path, old_file_path).

    Blank type or path -> dropped; for R/C lines with 3+ parts the old path is kept.
    ``dict_variant``: only 2- or 3-part lines, the type kept as written, the last part as the
    (stripped) path and no old path.
    """
    if dict_variant:
        carry = [c for c in lines.columns if c != value_col]
        staged = lines.select(*carry, F.col(value_col).alias("_v"), F.split(F.col(value_col), "\t").alias("_parts"))
        parts = F.col("_parts")
        parsed = F.struct(
            F.get(parts, 0).alias("change_type"),
            strip_ws(F.element_at(parts, -1)).alias("file_path"),
            F.lit(None).cast("string").alias("old_file_path"),
            F.lit(0).cast("bigint").alias("additions"),
            F.lit(0).cast("bigint").alias("deletions"),
            (F.size(parts).isin(2, 3) & (strip_ws(F.col("_v")) != "")).alias("_ok"),
        )
        return keep_parsed(staged, parsed, F.col("_ok"), carry).drop("_ok")
    carry = [c for c in lines.columns if c != value_col]
    lines = lines.select(*carry, F.split(F.col(value_col), "\t").alias("_parts"))
    parts = F.col("_parts")
    ctype = F.get(parts, 0)
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), "\t")
    rename = (ctype.startswith("R") | ctype.startswith("C")) & (F.size(parts) >= 3)
    parsed = F.struct(
        strip_ws(ctype).alias("change_type"),
        strip_ws(F.when(rename, F.get(parts, 2)).otherwise(rest)).alias("file_path"),
        F.when(rename, strip_ws(F.get(parts, 1))).alias("old_file_path"),
        F.lit(0).cast("bigint").alias("additions"),
        F.lit(0).cast("bigint").alias("deletions"),
        ((F.size(parts) >= 2) & (strip_ws(rest) != "")).alias("_ok"),
    )
    out = keep_parsed(lines, parsed, F.col("_ok") & (F.col("change_type") != ""), carry)
    return out.drop("_ok")


# ---- SRC-6 ----------------------------------------------------------------------------

def section_lines(sections: DataFrame, text: Column, carry) -> DataFrame:
    """``carry``, the lines of a diff section that begin with ``+`` (``plus``) and its ``additions`` and ``deletions``.

    Every line break is turned into a line feed (one of two characters into two of them: one more empty line,
    which counts nowhere), and only texts that hold another one are rewritten. Splitting at one character is
    many times faster than a regular expression or a search."""
    others = reduce(or_, [F.size(F.split(text, c)) > 1 for c in _OTHER_BREAKS])
    whole = F.when(others, F.regexp_replace(text, f"[{_OTHER_BREAKS}]", "\n")).otherwise(text)
    lines = sections.select(*carry, F.split(whole, "\n").alias("lines"))
    plus, minus = (F.filter("lines", lambda x: x.startswith(c)) for c in "+-")
    kinds = lines.select(*carry, plus.alias("plus"), minus.alias("minus"))
    count = lambda c, mark: F.size(F.filter(c, lambda x: ~x.startswith(mark))).cast("bigint")
    return kinds.select(*carry, "plus", count("plus", "+++").alias("additions"), count("minus", "---").alias("deletions"))


def patch_line_stats(patches: DataFrame, patch_col: str = "patch", keys=("commit_hash",)) -> DataFrame:
    """SRC-6: unified diff text -> per file (file_path, additions, deletions).

    Sections start at ``diff --git``; the path comes from the section's ``+++ b/`` line;
    ``+``/``-`` lines count except ``+++``/``---``. A section without a ``+++ b/`` line is not
    reported; a path seen twice keeps its last section.
    """
    patch = F.col(patch_col)
    several = F.contains(patch, F.lit("\ndiff --git")) | F.contains(patch, F.lit("\rdiff --git"))
    sections = F.when(several, F.split(patch, "[\r\n](?=diff --git)")).when(patch.isNotNull(), F.array(patch))
    exploded = patches.select(*keys, F.posexplode(sections).alias("_pos", "_sec"))
    lined = section_lines(exploded, F.col("_sec"), [*keys, "_pos"])
    head = F.try_element_at(F.filter("plus", lambda x: x.startswith("+++ b/")), F.lit(-1))
    stats = F.struct(strip_ws(F.substr(head, F.lit(7))).alias("file_path"), "additions", "deletions")
    per_section = keep_parsed(lined, stats, F.col("file_path").isNotNull(), [*keys, "_pos"])
    return per_section.groupBy(*keys, "file_path").agg(
        F.max_by("additions", "_pos").alias("additions"),
        F.max_by("deletions", "_pos").alias("deletions"),
    )


# ---- SNK-5 / SNK-6 --------------------------------------------------------------------

def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def file_change_line(fc: Column) -> Column:
    """``add\\tdel\\ttype\\tpath`` (3 parts when the type is empty)."""
    counts = F.concat(fc["additions"].cast("string"), F.lit("\t"), fc["deletions"].cast("string"), F.lit("\t"))
    return F.when(F.coalesce(fc["change_type"], F.lit("")) == "", F.concat(counts, fc["file_path"])) \
        .otherwise(F.concat(counts, fc["change_type"], F.lit("\t"), fc["file_path"]))


def commits_to_log(commits: DataFrame) -> DataFrame:
    """SNK-6: nested commits, or their parts -> one marker-delimited record per row (column ``value``),
    without the leading commit marker (the writer's ``lineSep`` adds it)."""
    header = F.concat(
        F.col("commit_hash"), F.lit(FIELD_MARK),
        F.array_join("parent_hashes", " "), F.lit(FIELD_MARK),
        F.col("author_name"), F.lit(FIELD_MARK),
        F.col("author_email"), F.lit(FIELD_MARK),
        _iso(F.col("commit_date")), F.lit("\t"), F.col("commit_timestamp").cast("string"), F.lit(FIELD_MARK),
        F.lit(MSG_START), F.col("commit_message"), F.lit(MSG_END),
    )
    body = F.array_join(F.transform("file_changes", file_change_line), "\n")
    if "part" in commits.columns:
        body = F.when(F.col("part") > 0, F.concat(F.lit(PART_MARK), F.col("part").cast("string"), F.lit("\n"), body)).otherwise(body)
    return commits.select(F.concat(header, F.lit("\n"), body, F.lit("\n")).alias("value"))


def _newest_first(commits: DataFrame) -> list:
    return [F.desc("commit_timestamp"), "commit_hash", *(["part"] if "part" in commits.columns else [])]


def _in_file_order(commits: DataFrame) -> DataFrame:
    """Parts of a commit follow one another in a file, and from one file to the next; whole commits stay as they are."""
    return persist_rows(commits, "parts").orderBy(*_newest_first(commits)) if "part" in commits.columns else commits


def _write_text(rows: DataFrame, path: str, mode: str, compression: str | None, **options) -> None:
    with shuffles_released(rows.sparkSession):
        writer = rows.write.mode(mode).options(**options)
        (writer.option("compression", compression) if compression else writer).text(path)


def write_log(commits: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """SNK-6 to storage: records separated by the commit marker, read back by ``read_log``. The parts of a commit
    (``commit_parts``) become consecutive records, each with the commit's header. ``compression`` (gzip, say) is
    that of the text writer; readers know it by the files' names."""
    _write_text(commits_to_log(_in_file_order(commits)), path, mode, compression, lineSep=COMMIT_MARK)


def commits_to_json(commits: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """SNK-5: one JSON object per commit, or per part of one, dates as ISO text (column ``value``), next to the
    columns ``carry``."""
    as_text = commits.select(
        *[c for c in COMMIT_COLUMNS if c != "commit_date"],
        _iso(F.col("commit_date")).alias("commit_date"),
        "file_changes", *(["part"] if "part" in commits.columns else []), *(carry or []),
    )
    return as_text.select(F.to_json(F.struct(*[c for c in as_text.columns if c not in (carry or [])])).alias("value"), *(carry or []))


def write_json(commits: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-5 to storage as JSON Lines; the parts of a commit are consecutive lines."""
    commits_to_json(_in_file_order(commits)).write.mode(mode).text(path)


def write_json_array(commits: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """SNK-5 to storage as one JSON array over all files in name order, newest commit first, one object a line:
    the array's brackets and commas begin the lines, so files are written by many tasks and ``cat`` of them is
    the array (``zcat`` with ``compression`` gzip). One sort, written as it comes: the files are its partitions,
    and the row that ends the array is sorted behind all commits."""
    commits = persist_rows(commits, "commits")
    order = _newest_first(commits)
    rows = commits.select(F.lit(False).alias("_end"), F.struct(*commits.columns).alias("commit"))
    end = commits.sparkSession.range(1, numPartitions=1).select(F.lit(True).alias("_end"), F.lit(None).cast(rows.schema["commit"].dataType).alias("commit"))
    by = [c if isinstance(c, str) else "commit_timestamp" for c in order]
    sort = [F.desc(f"commit.{c}") if c == "commit_timestamp" else F.col(f"commit.{c}") for c in by]
    # the first row of a range sort is row 0 of its partition 0, which is never empty
    placed = rows.unionByName(end).orderBy("_end", *sort).withColumn("_at", F.monotonically_increasing_id())
    text = commits_to_json(placed.select("commit.*", "_end", "_at"), ["_end", "_at"])
    begins = F.when(F.col("_at") == 0, "[").otherwise(F.when(F.col("_end"), "").otherwise(","))
    _write_text(text.select(F.concat(begins, F.when(F.col("_end"), "]").otherwise(F.col("value"))).alias("value")), path, mode, compression)


def _json_schema(parts: bool = False):
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("commit_hash", T.StringType()),
            T.StructField("parent_hashes", T.ArrayType(T.StringType())),
            T.StructField("author_name", T.StringType()),
            T.StructField("author_email", T.StringType()),
            T.StructField("commit_timestamp", T.LongType()),
            T.StructField("commit_message", T.StringType()),
            T.StructField("commit_date", T.StringType()),
            T.StructField("file_changes", T.ArrayType(FILE_CHANGE)),
        ]
    )
    return schema.add("part", T.IntegerType()) if parts else schema


def _commits_of(parsed: DataFrame) -> DataFrame:
    part = [F.coalesce("part", F.lit(0)).alias("part")] if "part" in parsed.columns else []
    return parsed.select(*[F.try_to_timestamp("commit_date").alias(c) if c == "commit_date" else F.col(c)
                           for c in COMMIT_COLUMNS], *part, "file_changes")


def read_json(spark: SparkSession, path: str, array: bool = False, parts: bool = False) -> DataFrame:
    """Read SNK-5 output back with an explicit schema: JSON Lines (split over tasks), or with ``array`` files
    that hold one JSON array of commits each (read whole; a file a task). ``parts`` adds the parts' numbers."""
    return _commits_of(spark.read.schema(_json_schema(parts)).json(path, multiLine=array))


def read_json_array(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Commits of a JSON array with one object a line (as ``write_json_array`` writes it, or with commas at the
    line ends), split over tasks like any text. A line that is no whole object raises: such an array
    (indented, say) is read by ``read_json(array=True)``."""
    space = " \t\n\x0b\f\r,"
    line = F.rtrim(F.ltrim(F.col("value"), F.lit(f"{space}[")), F.lit(f"{space}]"))
    nothing = F.col("value").rlike(r"^[\s,\[]*[\s,\]]*$")  # told by the first other character, not by trimming twice
    lines = spark.read.text(path).where(~nothing).select(line.alias("line"))
    whole = F.col("line").startswith("{") & F.col("line").endswith("}")
    problem = F.raise_error(F.concat(F.lit("not one object a line: "), F.substr("line", F.lit(1), F.lit(80)))).cast("string")
    parsed = lines.select(F.from_json(F.when(whole, F.col("line")).otherwise(problem), _json_schema(parts), {"mode": "FAILFAST"}).alias("c"))
    return _commits_of(parsed.select("c.*"))
