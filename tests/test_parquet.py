"""Versioned Parquet: provenance round trip, version gate, empty sets, footer metadata."""

import os

import pytest

from helpers import change_rows
from revlens.sources import parquet as PQ


def test_round_trip_keeps_provenance(spark, scratch):
    path = scratch("pq")
    PQ.write_changes(change_rows(spark, [{"additions": 3}]), path, since="2024-01-01", until="2024-03-31")
    df, meta = PQ.read_changes(spark, path)
    assert meta == {"data_version": "1.0", "description": "Git commit data extracted by revlens",
                    "since": "2024-01-01", "until": "2024-03-31"}
    (r,) = df.collect()
    assert r.additions == 3 and r.old_file_path == ""
    w = PQ.period_from_metadata(meta)
    assert (w.since, w.until) == ("2024-01-01", "2024-03-31")


@pytest.mark.parametrize("version,force,ok", [("1.0", False, True), ("2.0", False, False), ("2.0", True, True),
                                              (None, False, False), (None, True, True)])
def test_version_gate(version, force, ok):
    meta = {} if version is None else {"data_version": version}
    if ok:
        assert PQ.version_gate(meta, force=force)
    else:
        with pytest.raises(PQ.VersionMismatch):
            PQ.version_gate(meta, force=force)


def test_gate_on_written_mismatch(spark, scratch):
    path = scratch("pq2")
    PQ.write_changes(change_rows(spark, [{}]), path, version="2.0")
    with pytest.raises(PQ.VersionMismatch):
        PQ.read_changes(spark, path)
    df, _ = PQ.read_changes(spark, path, force=True)
    assert df.count() == 1


def test_mixed_files_are_refused_with_their_counts(spark, scratch):
    path = scratch("pq with space")
    PQ.write_changes(change_rows(spark, [{}]), path, since="2024-01-01", until="2024-03-31")
    PQ.write_changes(change_rows(spark, [{}, {}]).coalesce(1), path, version="2.0", since="2024-02-01", mode="append")
    local = path[len("file:"):] if path.startswith("file:") else path
    import pyarrow as pa
    import pyarrow.parquet as pq
    pq.write_table(pa.table({"commit_hash": ["foreign"]}), os.path.join(local, "foreign.parquet"))
    with pytest.raises(PQ.VersionMismatch, match=r"\(none\) in 1 file, 1.0 in \d+ files?, 2.0 in 1 file, this"):
        PQ.read_changes(spark, path)
    with pytest.warns(UserWarning, match="read all the same"):
        df, meta = PQ.read_changes(spark, path, force=True)
    assert df.count() == 4 and meta["data_version"] == "1.0, 2.0" and (meta["since"], meta["until"]) == ("", "")
    found = {r.data_version: (r.n_rows, r.since) for r in PQ.audit_versions(spark.read.parquet(path)).collect()}
    assert found == {"1.0": (1, "2024-01-01"), "2.0": (2, "2024-02-01"), None: (1, None)}


def test_widest_window_of_appended_files(spark, scratch):
    path = scratch("pqwide")
    PQ.write_changes(change_rows(spark, [{}]), path, since="2024-01-01", until="2024-03-31")
    PQ.write_changes(change_rows(spark, [{}]), path, since="2023-06-01", until="2023-12-31", mode="append")
    _, meta = PQ.read_changes(spark, path)
    assert (meta["since"], meta["until"], meta["data_version"]) == ("2023-06-01", "2024-03-31", "1.0")


def test_footers_through_spark_equal_those_read_by_tasks(spark, scratch):
    from revlens.sources import footers

    path = scratch("pqjvm")
    PQ.write_changes(change_rows(spark, [{}, {}]).coalesce(1), path, since="2024-01-01", version="3.1")
    (uri,) = spark.read.parquet(path).inputFiles()
    by_tasks = footers.provenance_of_files(spark, [uri], tasks_only=True).first()
    assert footers._through_spark(spark, uri) == (*(by_tasks[k] for k in PQ.META_KEYS), 2)
    other = "viewfs://nowhere/x.parquet"
    with pytest.raises(OSError, match="1 files"):
        footers.provenance_of_files(spark, [uri, other], tasks_only=True)


def test_empty_write_keeps_schema(spark, scratch):
    path = scratch("pqe")
    PQ.write_changes(change_rows(spark, []), path)
    df, meta = PQ.read_changes(spark, path)
    assert df.count() == 0 and "commit_hash" in df.columns and meta["data_version"] == "1.0"


def test_none_text_and_null_check(spark, scratch):
    rows = change_rows(spark, [{"file_paths": None, "change_type": None}])
    path = scratch("pqn")
    PQ.write_changes(rows, path, none_text=True)
    (r,) = PQ.read_changes(spark, path)[0].collect()
    assert (r.file_paths, r.change_type, r.old_file_path) == ("None", "None", "")
    with pytest.raises(ValueError):
        PQ.assert_no_nulls(rows)


def test_footer_metadata_from_pyarrow_file(spark, scratch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = scratch("pa")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    t = pa.table({"commit_hash": ["h"], "additions": [1]})
    t = t.replace_schema_metadata({b"data_version": b"1.0", b"since": b"2023-01-01"})
    pq.write_table(t, os.path.join(local, "data.parquet"))
    df, meta = PQ.read_changes(spark, local)
    assert meta["data_version"] == "1.0" and meta["since"] == "2023-01-01"


def test_refuse_nulls_fails_inside_the_write(spark, scratch):
    rows = change_rows(spark, [{"file_paths": None, "change_type": "M"}])
    with pytest.raises(Exception, match="file_paths"):
        PQ.write_changes(rows, scratch("pqnull"), check_nulls=True)


def test_checkpoint_folder_needs_a_shared_folder_on_a_cluster():
    from revlens import session

    assert session._local_folder("local[4]").startswith("/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "connect"):
        with pytest.raises(RuntimeError):
            session._local_folder(master)
