"""Versioned Parquet change sets (SNK-1..4, SRC-7, SRC-8).

Provenance (``data_version``, ``description``, ``since``, ``until``) travels as column metadata
in the Spark schema stored in the Parquet footer, so it round-trips with the data and is read
from every file's footer by tasks (``footers``), since files of one set may differ. Files written by other
tools keep the same keys as footer key/values. Plain readers find ours in the footer's
``org.apache.spark.sql.parquet.row.metadata`` (the schema as JSON).
"""

from __future__ import annotations

import logging
import warnings
from datetime import timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.period import Window as Period
from revlens.functions.period import day_edges, resolve_window
from revlens.functions.scalar import month_bucket
from revlens.schema import CHANGE, CHANGE_COLUMNS, DATA_VERSION, DESCRIPTION, META_KEYS
from revlens.sources.footers import provenance_of_files

log = logging.getLogger(__name__)

# The string columns normalised before writing.
SINK_STRING_COLUMNS = ("commit_hash", "author_name", "author_email", "commit_message",
                       "file_paths", "change_type", "old_file_path")


class VersionMismatch(ValueError):
    pass


def normalize_for_sink(df: DataFrame, none_text: bool = False) -> DataFrame:
    """SNK-3: ``old_file_path`` null -> ''; with ``none_text`` other null strings -> 'None'
    (the reference's str() cast). Default keeps nulls (D14)."""
    out = df.withColumn("old_file_path", F.coalesce(F.col("old_file_path"), F.lit("")))
    if none_text:
        for c in SINK_STRING_COLUMNS:
            if c in out.columns and c != "old_file_path":
                out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("None")))
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """One-pass null count of every column (a single aggregate job)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def refuse_nulls(df: DataFrame) -> DataFrame:
    """SNK-4 inside the write: the same rows, failing at the first null; nothing is computed twice."""
    fail = lambda c: F.raise_error(F.lit(f"a null in column {c}"))
    return df.select(*[F.coalesce(F.col(c), fail(c).cast(df.schema[c].dataType)).alias(c) if c != MONTH_COL else F.col(c) for c in df.columns])


def assert_no_nulls(df: DataFrame) -> None:
    """SNK-4: fail when any column still holds a null."""
    row = null_counts(df).first()
    bad = {k: v for k, v in row.asDict().items() if v}
    if bad:
        raise ValueError(f"nulls by column: {bad}")


def provenance(since: str | None, until: str | None, description: str = DESCRIPTION,
               version: str = DATA_VERSION) -> dict[str, str]:
    return {"data_version": version, "description": description,
            "since": since or "", "until": until or ""}


def with_provenance(df: DataFrame, meta: dict[str, str]) -> DataFrame:
    """Attach the provenance keys as metadata of the first column."""
    first = df.columns[0]
    return df.select(F.col(first).alias(first, metadata={"revlens": meta}), *df.columns[1:])


MONTH_COL = "commit_month"


def write_changes(df: DataFrame, path: str, since: str | None = None, until: str | None = None,
                  none_text: bool = False, check_nulls: bool | None = None,
                  partition_by: list[str] | None = None, partition_by_month: bool = False,
                  mode: str = "errorifexists",
                  description: str = DESCRIPTION, version: str = DATA_VERSION) -> None:
    """SNK-1 (+SNK-2..4): write a CHANGE frame as versioned Parquet.

    An empty frame is written with its full schema (SNK-2: Spark cannot write a zero-column
    file, and a typed empty set is more useful). ``partition_by_month`` adds ``commit_month``
    ('yyyy-MM' in UTC) as the directory partition: later reads with a date window list only the
    folders of that window (partition pruning). Rows are range-partitioned on (month, hash):
    each task writes a contiguous run of months (few files per task) and a hot month is split
    over several tasks.
    """
    out = normalize_for_sink(df, none_text)
    if partition_by_month:
        out = out.withColumn(MONTH_COL, month_bucket("commit_date"))
        partition_by = [*(partition_by or []), MONTH_COL]
        out = out.repartitionByRange(F.col(MONTH_COL), F.xxhash64("commit_hash"))
    if check_nulls if check_nulls is not None else none_text:
        out = refuse_nulls(out)
    out = with_provenance(out, provenance(since, until, description, version))
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def audit_versions(df: DataFrame) -> DataFrame:
    """SRC-7: provenance of every file that ``df`` (just read) scans: (data_version, description, since, until,
    n_files, n_rows), a row per distinct provenance. Tasks read the footers; no data is read."""
    return provenance_of_files(df.sparkSession, df.inputFiles())


def _one_provenance(found: list) -> dict[str, str]:
    """Provenance of the whole set: the widest window of its files; several versions are joined."""
    if not found:
        return {}
    value = lambda k: [r[k] or "" for r in found]
    distinct = lambda k: sorted(set(value(k)) - {""})
    out = {k: ", ".join(distinct(k)) for k in ("data_version", "description")}
    for k, widest in (("since", min), ("until", max)):  # a file without a bound leaves the set without one
        out[k] = widest(value(k)) if "" not in value(k) else ""
    given = {k for k in META_KEYS if any(r[k] is not None for r in found)}
    return {k: out[k] for k in META_KEYS if k in given}


def dataset_metadata(df: DataFrame) -> dict[str, str]:
    return _one_provenance(audit_versions(df).collect())


def version_gate(meta: dict[str, str], expected: str = DATA_VERSION, force: bool = False) -> bool:
    """SRC-7: True when the data's version is the ``expected`` one. Another or no version raises, unless
    ``force`` lowers it to a warning."""
    found = meta.get("data_version") or None
    return found == expected or _refused(f"change set has data_version {found or '(none)'}, this library reads {expected}", force)


def versions_gate(found: list, expected: str = DATA_VERSION, force: bool = False) -> bool:
    """``version_gate`` over all files (rows of ``audit_versions``): every one must have the ``expected``
    version. The message counts the files of each version."""
    files: dict[str, int] = {}
    for r in found:
        version = r["data_version"] or "(none)"
        files[version] = files.get(version, 0) + r["n_files"]
    if set(files) == {expected}:
        return True
    said = ", ".join(f"{v} in {n} file{'s' * (n != 1)}" for v, n in sorted(files.items())) or "(none)"
    return _refused(f"change set has data_version {said}, this library reads {expected}", force)


def _refused(problem: str, force: bool) -> bool:
    if force:
        warnings.warn(f"{problem}; read all the same", stacklevel=3)
        return True
    raise VersionMismatch(f"{problem}; pass force=True to read it all the same")


def period_from_metadata(meta: dict[str, str], start=None, end=None, period: str | None = None,
                         today=None) -> Period:
    """SRC-8: the stored since/until become the analysis window (caller's values as defaults)."""
    since = meta.get("since") or start
    until = meta.get("until") or end
    return resolve_window(since, until, period, today)


def read_changes(spark: SparkSession, path: str, expected_version: str = DATA_VERSION,
                 force: bool = False, keep_partitions: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """SRC-7: load a saved change set behind the version gate; returns (frame, provenance).

    The gate looks at every file: one file of another or of no version refuses the set. ``keep_partitions`` keeps the ``commit_month``
    directory column so a caller can prune."""
    df = spark.read.parquet(path)
    found = audit_versions(df).collect()  # one row a distinct provenance
    versions_gate(found, expected_version, force)
    meta = _one_provenance(found)
    cols = [c for c in CHANGE_COLUMNS if c in df.columns]
    if keep_partitions and MONTH_COL in df.columns:
        cols.append(MONTH_COL)
    return df.select(*cols), meta


def prune_months(df: DataFrame, since: str | None, until: str | None, now=None) -> DataFrame:
    """Partition filter on ``commit_month`` implied by a date window (no-op without the column). Months
    and bounds are both those of UTC, whatever offset a bound was given in."""
    if MONTH_COL not in df.columns:
        return df
    low, high = (t and t.astimezone(timezone.utc).strftime("%Y-%m") for t in day_edges(since, until, now))
    df = df if low is None else df.where(F.col(MONTH_COL) >= low)
    return df if high is None else df.where(F.col(MONTH_COL) <= high)


def empty_changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHANGE)
