"""Diff dumps read from storage (SRC-6): ``git log -p`` style files, a row a file section.

The section marker is the text reader's ``lineSep``, so a dump of any size is read in splits and a section is
one row; only its counts leave the scan. A section doesn't say which commit it belongs to: the header
stands before the commit's first section, at the end of the row before. It is carried forward twice: inside
each split by position, and from split to split by a table with one row per split.

Defined cases: sections before any header have a null commit; commits without a section give no row;
sections without a ``+++ b/`` line (deleted or binary files, pure renames) are not reported; a path seen twice
in a commit keeps its last section; empty files give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.functions.scalar import strip_ws
from revlens.session import persist_table
from revlens.sources.logtext import keep_parsed, section_lines

# How a section and a commit header begin, and the escapes of quoted paths.
SECTION = "diff --git "
HEADER = r"\n(?=commit [0-9a-f]{7,64}(?:[ \n]|$))"
ESCAPES = {"a": "\x07", "b": "\x08", "t": "\t", "n": "\n", "v": "\x0b", "f": "\x0c", "r": "\r"}


def unquoted(path: Column) -> Column:
    """A path written in quotes with backslash escapes (octal ones are UTF-8 bytes) as it is named."""
    def byte_text(token: Column) -> Column:  # one character per byte
        octal = F.char(F.conv(F.substr(token, F.lit(2)), 8, 10).cast("int"))
        named = F.substr(token, F.lit(2))
        for k, v in ESCAPES.items():
            named = F.when(token == f"\\{k}", F.lit(v)).otherwise(named)
        plain = F.decode(F.encode(token, "UTF-8"), "ISO-8859-1")
        return F.when(token.rlike(r"^\\[0-7]{3}$"), octal).when(token.startswith("\\"), named).otherwise(plain)

    tokens = F.regexp_extract_all(path, F.lit(r"(\\[0-7]{3}|\\.|[^\\]+)"), F.lit(1))
    return F.decode(F.encode(F.array_join(F.transform(tokens, byte_text), ""), "ISO-8859-1"), "UTF-8")


def section_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a record: (file, start of its split, pos in the file's order, path, additions, deletions and
    ``opens``, the commit whose header ends the record); path null where a section reports none."""
    raw = spark.read.option("lineSep", f"\n{SECTION}").text(paths if isinstance(paths, list) else [paths])
    # a record takes more bytes than one, so start of split + number of the record rises through a file
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place.alias("pos"),
                     F.concat(F.lit("\n"), F.when(F.startswith("value", F.lit(SECTION)), F.substr("value", F.lit(len(SECTION) + 1))).otherwise(F.col("value"))).alias("body"))
    # what stands before the first header is the section, in lines after the one of its names; few records hold a header
    parts = F.when(F.contains("body", F.lit("\ncommit ")), F.split("body", HEADER)).otherwise(F.array("body"))
    raw = raw.select("file", "start", "pos", F.explode(F.array(parts)).alias("parts"))
    opens = F.when(F.size("parts") > 1, F.regexp_extract(F.element_at("parts", -1), "^commit ([0-9a-f]+)", 1))
    staged = section_lines(raw.select("file", "start", "pos", opens.alias("opens"), F.get("parts", 0).alias("section")),
                           F.col("section"), ["file", "start", "pos", "opens"])
    head = F.try_element_at(F.filter("plus", lambda x: x.startswith("+++ b/") | x.startswith('+++ "b/')), F.lit(-1))
    quoted = F.regexp_extract(head, r'^\+\+\+ "b/(.*)"\s*$', 1)
    parsed = F.struct(
        F.when(head.startswith("+++ b/"), strip_ws(F.substr(head, F.lit(7)))).when(head.isNotNull(), unquoted(quoted)).alias("path"),
        "additions", "deletions", "opens")
    return keep_parsed(staged, parsed, F.col("path").isNotNull() | F.col("opens").isNotNull(), ["file", "start", "pos"])


def with_commits(rows: DataFrame) -> DataFrame:
    """``section_rows`` with ``commit_hash``: the header that was opened last before each row."""
    split = Window.partitionBy("file", "start").orderBy("pos")  # at most one split's sections, without their text
    inside = rows.withColumn("own", F.last("opens", True).over(split.rowsBetween(Window.unboundedPreceding, -1)))
    every = rows.groupBy("file", "start").agg(F.max_by("opens", F.when(F.col("opens").isNotNull(), F.col("pos"))).alias("opens"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    carry = every.select("file", "start", F.last("opens", True).over(before).alias("carry"))
    return inside.join(carry, ["file", "start"]).withColumn("commit_hash", F.coalesce("own", "carry")).drop("own", "carry", "start")


def patch_scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC-6 from files: (commit_hash, file_path, additions, deletions), a row a commit and path."""
    rows = persist_table(section_rows(spark, paths), "sections")  # read twice below; the dumps are read once
    found = with_commits(rows).where("path IS NOT NULL")
    return found.groupBy("file", "commit_hash", F.col("path").alias("file_path")).agg(
        F.max_by("additions", "pos").alias("additions"), F.max_by("deletions", "pos").alias("deletions")).drop("file")
