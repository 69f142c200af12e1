"""Facade flows and the streaming ingestion."""

import pytest

from helpers import change_rows, commit_rows, utc
from revlens.plans.facade import extract, get_changes, scoreboard
from revlens.sources import logtext as LT
from revlens.sources import parquet as PQ
from revlens.streaming import logstream as ST


def _changes(spark):
    return change_rows(spark, [
        {"commit_hash": "1", "author_name": "Ann", "author_email": "ann@x", "additions": 50,
         "commit_date": utc(2025, 8, 1), "file_paths": "src/a.py"},
        {"commit_hash": "2", "author_name": "Bo", "author_email": "bo@y", "additions": 20,
         "commit_date": utc(2025, 9, 1), "file_paths": "src/b.py"},
        {"commit_hash": "3", "author_name": "Ann", "author_email": "ann@x", "additions": 5,
         "commit_date": utc(2025, 1, 1), "file_paths": "doc/c.md"},
    ])


def test_scoreboard_window_and_author_scope(spark):
    board = scoreboard(_changes(spark), end="2025-09-29")  # default 3 months -> from 2025-06-29
    assert (board.since, board.until) == ("2025-06-29", "2025-09-29")
    ranking = [(r.rank, r.author, r.total_diff) for r in board.ranking.collect()]
    assert ranking == [(1, "Ann <ann@x>", 50), (2, "Bo <bo@y>", 20)]
    assert board.summary.first().total_unique_authors == 2
    mine = scoreboard(_changes(spark), end="2025-09-29", author="bo").author_view.collect()
    assert [(r.rank_label, r.percentile) for r in mine] == [("#1 of 1", "Top 0.0%")]
    everyone = scoreboard(_changes(spark), end="2025-09-29", author="bo", rank_scope="all").author_view.collect()
    assert [r.rank_label for r in everyone] == ["#2 of 1"]


def test_scoreboard_me_conflict(spark):
    with pytest.raises(ValueError):
        scoreboard(_changes(spark), author="ann", me=("Ann", "ann@x"))


def test_stored_window_is_default(spark):
    board = scoreboard(_changes(spark), stored={"since": "2025-01-01", "until": "2025-01-31"})
    assert [r.author for r in board.ranking.collect()] == ["Ann <ann@x>"]


def test_extract_then_load(spark, scratch):
    out = scratch("extract")
    extract(spark, _changes(spark), out, since="2025-07-01", until="2025-12-31", include_paths=["src/"])
    df, meta = PQ.read_changes(spark, out)
    assert sorted(r.commit_hash for r in df.collect()) == ["1", "2"]
    assert meta["since"] == "2025-07-01"


def test_get_changes_from_log_text(spark, scratch):
    commits = commit_rows(spark, [
        {"commit_hash": "m", "parent_hashes": ["a", "b"], "commit_date": utc(2024, 5, 1), "commit_timestamp": 1714521600,
         "commit_message": "merge", "file_changes": [("x/1", 1, 0, "M", None)]},
        {"commit_hash": "s", "parent_hashes": ["a"], "commit_date": utc(2024, 5, 2), "commit_timestamp": 1714608000,
         "commit_message": "single", "file_changes": [("x/2", 1, 0, "M", None)]},
    ])
    path = scratch("facade-log")
    LT.write_log(commits, path)
    assert [r.commit_hash for r in get_changes(spark, path, merges_only=True).collect()] == ["m"]
    assert [r.commit_hash for r in get_changes(spark, path, grep="^sing").collect()] == ["s"]


def test_streaming_scoreboard_counts_resent_commits_once(spark, scratch):
    commits = commit_rows(spark, [
        {"commit_hash": f"h{i}", "author_name": f"n{i % 3}", "author_email": f"e{i % 3}", "commit_date": utc(2024, 1, 1 + i),
         "commit_timestamp": 1704067200 + 86400 * i, "file_changes": [("f", i, 1, "M", None)]} for i in range(9)])
    src = scratch("st-in")
    LT.write_log(commits, src + "/a")
    LT.write_log(commits.where("commit_hash in ('h1', 'h2')"), src + "/b")  # a re-sent dump
    out, ckpt = scratch("st-out"), scratch("st-ckpt")
    stream = ST.read_log_stream(spark, src + "/*", max_files_per_trigger=1)
    q = ST.start_scoreboard(ST.running_author_totals(stream), out, ckpt)
    q.awaitTermination()
    got = {r.author_name: (r.added, r.deleted, r.commits) for r in ST.latest_board(spark, out).collect()}
    assert got == {"n0": (9, 3, 3), "n1": (12, 3, 3), "n2": (15, 3, 3)}


def test_get_changes_from_json_dump(spark, scratch):
    commits = commit_rows(spark, [
        {"commit_hash": "j1", "commit_date": utc(2024, 3, 1), "file_changes": [("src/x", 3, 1, "M", None)]},
        {"commit_hash": "j2", "commit_date": utc(2024, 4, 1), "file_changes": [("doc/y", 1, 0, "A", None)]},
    ])
    path = scratch("facade-json")
    LT.write_json(commits, path)
    got = [(r.commit_hash, r.file_paths) for r in get_changes(spark, path, fmt="json", include_paths=["src/"]).collect()]
    assert got == [("j1", "src/x")]


def test_streaming_keeps_commits_of_any_age(spark, scratch):
    rows = [{"commit_hash": f"h{y}", "author_name": "n", "author_email": "e", "commit_date": utc(y, 1, 1), "commit_timestamp": 1,
             "file_changes": [("f", 1, 0, "M", None)]} for y in (2023, 2022, 2005, 1985)]
    src = scratch("st-old")
    for k, row in enumerate(rows):  # newest first, a file each
        LT.write_log(commit_rows(spark, [row]).coalesce(1), f"{src}/{k}")
    out = scratch("st-old-out")
    stream = ST.read_log_stream(spark, src + "/*", max_files_per_trigger=1)
    ST.start_scoreboard(ST.running_author_totals(stream), out, scratch("st-old-ck")).awaitTermination()
    assert [(r.commits, r.added) for r in ST.latest_board(spark, out).collect()] == [(4, 4)]


def test_relative_bounds_and_offsets(spark, scratch):
    rows = _changes(spark)
    now = utc(2025, 9, 10)
    assert [r.commit_hash for r in get_changes(spark, rows, since="3 weeks ago", now=now).collect()] == ["2"]
    assert sorted(r.commit_hash for r in get_changes(spark, rows, until="10 days ago", now=now).collect()) == ["1", "3"]
    with pytest.raises(ValueError):
        get_changes(spark, rows, since="2025-09-2999 nonsense")


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_month_pruning_loses_nothing_in_any_zone(spark, scratch, zone):
    from datetime import datetime, timedelta, timezone

    data = change_rows(spark, [{"commit_hash": str(k), "commit_date": utc(2023, 2, 1) + timedelta(hours=h)}
                               for k, h in enumerate((-10, -4, 0, 3, 9, 700))])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        path = scratch("months")
        PQ.write_changes(data, path, partition_by_month=True)
        for since in ("2023-02-01", "2023-02-01T00:00:00+05:00", "2023-02-01T00:00:00-08:00", datetime(2023, 2, 1, tzinfo=timezone.utc)):
            want = sorted(r.commit_hash for r in get_changes(spark, data, since=since).collect())
            assert sorted(r.commit_hash for r in get_changes(spark, path, fmt="parquet", since=since).collect()) == want
        assert {r.commit_month for r in spark.read.parquet(path).collect()} == {"2023-01", "2023-02", "2023-03"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_json_array_files(spark, scratch):
    import json
    import os

    path = scratch("json-array").removeprefix("file:")
    os.makedirs(path)
    commit = {"commit_hash": "j", "parent_hashes": ["p"], "author_name": "n", "author_email": "e", "commit_timestamp": 5, "commit_message": "m",
              "commit_date": "2024-03-01T00:00:00+00:00",
              "file_changes": [{"file_path": "a", "additions": 1, "deletions": 2, "change_type": "M", "old_file_path": None}]}
    with open(f"{path}/all.json", "w") as f:
        json.dump([commit, {**commit, "commit_hash": "k", "file_changes": []}], f, indent=1)
    got = {r.commit_hash: len(r.file_changes) for r in LT.read_json(spark, path, array=True).collect()}
    assert got == {"j": 1, "k": 0}


def test_stream_of_changes_writes_what_changed(spark, scratch):
    from helpers import commit_rows
    from revlens.sources.logtext import write_log
    from revlens.streaming import logstream as ST

    src, out, ckpt = scratch("in"), scratch("out"), scratch("ckpt")
    one = lambda h, who, n: {"commit_hash": h, "author_name": who, "author_email": f"{who}@x", "file_changes": [("f", n, 0, "M", None)]}

    def batch(n, rows):
        write_log(commit_rows(spark, rows).coalesce(1), f"{src}/{n}")
        ST.start_running_totals(ST.running_author_totals(ST.read_log_stream(spark, f"{src}/*")), out, ckpt).awaitTermination()

    batch(0, [one(f"a{i}", f"w{i}", i) for i in range(200)])
    batch(1, [one("b0", "w3", 1000), one("a5", "w5", 5)])  # one new commit, one sent again
    base, changes = ST._layers(spark, out)
    assert spark.read.parquet(*base).count() == 200 and not changes
    batch(2, [one("b1", "w3", 1), one("b2", "new", 7)])
    batch(3, [one("b3", "w4", 1)])
    counts = [spark.read.parquet(c).count() for c in ST._complete(spark, f"{out}/change/*")]
    assert counts == [200, 1, 2, 1]
    assert len(ST._complete(spark, f"{out}/base/*")) == 1  # merged once: after that the changes are fewer than its rows
    got = {r.author_name: (r.added, r.commits, r.rank) for r in ST.board_now(spark, out).collect()}
    assert len(got) == 201 and got["w3"] == (1004, 3, 1) and got["w5"][:2] == (5, 1) and got["new"][:2] == (7, 1) and got["w4"][:2] == (5, 2)
    # a folder without the success marker is not read
    spark.createDataFrame([("w3@x", "w3", 9, 9, 9)], "author_email string, author_name string, added long, deleted long, commits long").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/change/000000000099")
    assert {r.author_name: r.added for r in ST.totals_now(spark, out).collect()}["w3"] == 1004
