from datetime import datetime, timezone

from revlens.schema import CHANGE, COMMIT


def utc(y, m, d, hh=0, mm=0, ss=0):
    return datetime(y, m, d, hh, mm, ss, tzinfo=timezone.utc)


def change_rows(spark, rows):
    """rows: dicts with any CHANGE fields; missing -> defaults."""
    full = []
    for i, r in enumerate(rows):
        full.append((
            r.get("commit_hash", f"c{i}"), r.get("parent_hashes", []), r.get("author_name", "a"),
            r.get("author_email", "a@x"), r.get("commit_date", utc(2023, 1, 1)), r.get("commit_timestamp", 0),
            r.get("commit_message", "m"), r.get("file_paths", "f"), r.get("change_type", "M"),
            r.get("additions", 0), r.get("deletions", 0), r.get("old_file_path"),
        ))
    return spark.createDataFrame(full, CHANGE)


def commit_rows(spark, rows):
    full = []
    for i, r in enumerate(rows):
        full.append((
            r.get("commit_hash", f"c{i}"), r.get("parent_hashes", []), r.get("author_name", "a"),
            r.get("author_email", "a@x"), r.get("commit_date", utc(2023, 1, 1)), r.get("commit_timestamp", 0),
            r.get("commit_message", "m"), [tuple(fc) for fc in r.get("file_changes", [])],
        ))
    return spark.createDataFrame(full, COMMIT)
