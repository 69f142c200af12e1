"""Filters and the analysis window."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import change_rows, commit_rows, utc
from revlens.functions.period import Period, day_edges, parse_period, resolve_window
from revlens.operators import filters as FL


@pytest.mark.parametrize("text,expected", [
    ("12 days", Period(days=12)), ("a day", Period(days=1)), ("4 weeks ago", Period(days=28)), ("18 months", Period(months=18)),
    ("An Year", Period(months=12)), ("  10   years  ago ", Period(months=120)),
])
def test_period_grammar(text, expected):
    assert parse_period(text) == expected


@pytest.mark.parametrize("bad", ["soon", "5", "days", "five days", "-3 days", "2 fortnights", "1 day later", "1 day ago ago", "", None])
def test_period_grammar_rejects(bad):
    with pytest.raises(ValueError):
        parse_period(bad)


@pytest.mark.parametrize("bad", ["2025-09-2999 nonsense", "2025-09-29 extra", "2025-13-01", "yesterday", "3 parsecs ago"])
def test_whole_text_must_be_a_bound(bad):
    with pytest.raises(ValueError):
        day_edges(bad, None)


def test_relative_bounds_count_back_from_the_clock():
    now = utc(2024, 3, 31, 15)
    assert day_edges("a month ago", "2 days ago", now) == (utc(2024, 2, 29, 15), utc(2024, 3, 29, 15))


def test_windows_out_of_order_fail_the_job(spark):
    df = spark.createDataFrame([(utc(2024, 1, 2), utc(2024, 1, 1))], "a timestamp, b timestamp")
    assert [r.ok for r in df.select(FL.window_in_order("a", "b").alias("ok")).collect()] == [False]
    with pytest.raises(Exception, match="starts after its end"):
        FL.check_windows(df, "a", "b").collect()
    assert FL.check_windows(df, "b", "a").count() == 1


def test_default_window_three_months():
    w = resolve_window(end="2025-09-29")
    assert (w.start, w.end) == (date(2025, 6, 29), date(2025, 9, 29))
    assert resolve_window(end="2025-09-29", period="6 months").start == date(2025, 3, 29)
    assert resolve_window(end="2025-05-31", period="3 months").start == date(2025, 2, 28)


def test_window_start_after_end_is_error():
    with pytest.raises(ValueError):
        resolve_window(start="2025-02-01", end="2025-01-01")


def test_day_edges():
    lo, hi = day_edges("2023-01-02", "2023-01-03")
    assert lo == utc(2023, 1, 2)
    assert (hi.hour, hi.minute, hi.second, hi.microsecond) == (23, 59, 59, 999999)
    lo2, _ = day_edges("2023-01-02T05:00:00+00:00", None)
    assert lo2.hour == 5


def _history(spark):
    return change_rows(spark, [
        {"commit_hash": "a", "commit_date": utc(2023, 1, 1, 10), "author_name": "Test User", "author_email": "test@x.org",
         "commit_message": "Initial commit", "file_paths": "file1.txt"},
        {"commit_hash": "b", "commit_date": utc(2023, 1, 2, 23, 59, 59), "author_name": "Test User",
         "author_email": "test@x.org", "commit_message": "Second commit\nbody", "file_paths": "file2.txt",
         "parent_hashes": ["a"]},
        {"commit_hash": "c", "commit_date": utc(2023, 1, 3), "author_name": "Other Person", "author_email": "o@y.com",
         "commit_message": "Merge -- branch", "file_paths": "dir/file1.txt", "parent_hashes": ["b", "x"]},
    ])


def hashes(df):
    return sorted(r.commit_hash for r in df.collect())


def test_since_until_inclusive_day_edges(spark):
    h = _history(spark)
    assert hashes(FL.since(h, "2023-01-02")) == ["b", "c"]
    assert hashes(FL.until(h, "2023-01-02")) == ["a", "b"]
    assert hashes(FL.date_range(h, "2023-01-02", "2023-01-02")) == ["b"]


def test_author_rules(spark):
    h = _history(spark)
    assert hashes(FL.author_literal_ci(h, "test user")) == ["a", "b"]
    assert hashes(FL.author_literal_cs(h, "test user")) == []
    assert hashes(FL.author_any_regex(h, "^Other|nobody")) == ["c"]
    assert hashes(FL.author_mask(h, "TEST|")) == ["a", "b", "c"]  # empty part matches all
    assert hashes(FL.author_mask(h, "y\\.com")) == ["c"]


def test_current_user(spark):
    assert FL.current_user(("Me", "me@x"), None) == "Me|me@x"
    with pytest.raises(ValueError):
        FL.current_user(("Me", "me@x"), "someone")


def test_grep_modes(spark):
    h = _history(spark)
    assert hashes(FL.grep_regex(h, "^body$")) == ["b"]
    assert hashes(FL.grep_literal(h, "Second commit")) == ["b"]
    assert hashes(FL.grep_subject(h, "MERGE   BRANCH")) == ["c"]  # "--" became a space


def test_merges_only(spark):
    assert hashes(FL.merges_only(_history(spark))) == ["c"]


def test_paths_flat(spark):
    h = _history(spark)
    assert hashes(FL.paths(h, include=["file1.txt"])) == ["a"]
    assert hashes(FL.paths(h, exclude=["file2.txt"])) == ["a", "c"]
    assert hashes(FL.paths(h, include=["file", "dir/"], exclude=["file2"])) == ["a", "c"]


def test_paths_nested_drop_emptied(spark):
    commits = commit_rows(spark, [
        {"commit_hash": "root", "file_changes": []},
        {"commit_hash": "one", "file_changes": [("file1.txt", 1, 0, "A", None)]},
        {"commit_hash": "two", "file_changes": [("file2.txt", 1, 0, "A", None), ("file1.txt", 2, 0, "M", None)]},
    ])
    assert hashes(FL.paths_nested(commits, exclude=["file2.txt"])) == ["one", "two"]
    assert hashes(FL.paths_nested(commits)) == ["one", "root", "two"]
    kept = FL.paths_nested(commits, include=["file2"]).collect()
    assert [len(r.file_changes) for r in kept] == [1]


def test_where_passthrough(spark):
    assert hashes(FL.where(_history(spark), "commit_hash <> 'a'")) == ["b", "c"]


def test_within_period_per_row_end(spark):
    df = change_rows(spark, [
        {"commit_hash": "in", "commit_date": utc(2025, 3, 1)},
        {"commit_hash": "edge", "commit_date": utc(2025, 2, 28)},
        {"commit_hash": "old", "commit_date": utc(2025, 2, 27, 23, 59, 59)},
        {"commit_hash": "late", "commit_date": utc(2025, 6, 1)},
    ]).withColumn("end", F.lit("2025-05-31"))
    # 2025-05-31 minus 3 months clamps to 2025-02-28; the end day is inclusive
    assert hashes(FL.within_period(df, "end", "3 months")) == ["edge", "in"]


def test_until_now_bounds_open_end(spark):
    df = change_rows(spark, [{"commit_hash": "past", "commit_date": utc(2020, 1, 1)},
                             {"commit_hash": "future", "commit_date": utc(2999, 1, 1)}])
    assert hashes(FL.until(df, None, until_now=True)) == ["past"]
    assert hashes(FL.until(df, None)) == ["future", "past"]
