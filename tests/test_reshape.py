"""Nested <-> flat reshaping and last-wins."""

import re

from helpers import change_rows
from pyspark.sql import functions as F
from revlens.operators.reshape import assemble_commits, commit_parts, explode_changes, last_wins
from revlens.sources.logtext import read_json, read_json_array, read_log, write_json, write_json_array, write_log


def test_assemble_then_explode_is_identity(spark):
    rows = [{"commit_hash": "a", "file_paths": f"p{i}", "additions": i} for i in range(5)] + \
           [{"commit_hash": "b", "file_paths": None, "additions": 0}]
    flat = change_rows(spark, rows)
    nested = assemble_commits(flat).collect()
    assert sorted((r.commit_hash, len(r.file_changes)) for r in nested) == [("a", 5), ("b", 0)]
    back = explode_changes(assemble_commits(flat))
    key = lambda r: (r.commit_hash, r.file_paths, r.additions)
    assert sorted(map(key, back.collect())) == sorted(map(key, flat.collect()))


def test_very_large_commit_stays_one_row(spark):
    rows = [{"commit_hash": "hot", "file_paths": f"p{i:05d}", "additions": 1} for i in range(6000)] + \
           [{"commit_hash": "small", "file_paths": "x", "additions": 2}]
    nested = {r.commit_hash: r.file_changes for r in assemble_commits(change_rows(spark, rows)).collect()}
    assert [c.file_path for c in nested["hot"]] == [f"p{i:05d}" for i in range(6000)]
    assert len(nested["small"]) == 1


def test_last_wins_per_column(spark):
    df = spark.createDataFrame([("c", "p", 1, 10, 1, "A"), ("c", "p", 2, 20, 2, "M"), ("c", "q", 1, 5, 5, "D")],
                               "commit_hash string, file_path string, pos int, additions long, deletions long, change_type string")
    got = sorted(tuple(r) for r in last_wins(df).collect())
    assert got == [("c", "p", 20, 2, "M"), ("c", "q", 5, 5, "D")]


def _facts(parts):
    return sorted((r.commit_hash or "", r.part, r.author_name, [(c.file_path, c.additions) for c in r.file_changes]) for r in parts.collect())


def test_parts_are_bounded_whole_and_the_same_in_any_layout(spark):
    rows = [{"commit_hash": "hot", "author_name": "h", "file_paths": f"p{i % 700:05d}", "additions": i % 3} for i in range(2500)]
    rows += [{"commit_hash": None, "author_name": "n", "file_paths": f"q{i}"} for i in range(12)]
    rows += [{"commit_hash": "same", "author_name": "s", "file_paths": "x", "additions": 7}] * 25
    rows += [{"commit_hash": "none", "author_name": "e", "file_paths": None}, {"commit_hash": "one", "author_name": "o", "file_paths": "x"}]
    flat = change_rows(spark, rows)
    got = _facts(commit_parts(flat, 10))
    assert got == _facts(commit_parts(flat.repartition(5, "file_paths"), 10))
    assert max(len(c) for *_, c in got) == 10
    want = {}
    for r in rows:
        want.setdefault((r["commit_hash"] or "", r["author_name"]), []).extend([(r["file_paths"], r.get("additions", 0))] if r["file_paths"] else [])
    for (h, author), changes in want.items():
        mine = [(p, c) for g, p, a, c in got if g == h and a == author]
        assert [p for p, _ in mine] == list(range(max(1, -(-len(changes) // 10))))
        assert [x for _, c in mine for x in c] == sorted(changes)
    assert len(got) == sum(max(1, -(-len(c) // 10)) for c in want.values())
    assert commit_parts(flat.limit(0), 10).count() == 0


def test_parts_stay_next_to_each_other_in_dumps(spark, scratch):
    rows = [{"commit_hash": "hot", "commit_timestamp": 5, "commit_message": "m", "file_paths": f"p{i:03d}"} for i in range(95)]
    rows += [{"commit_hash": f"c{i}", "commit_timestamp": i, "file_paths": "x"} for i in range(10)]
    parts = commit_parts(change_rows(spark, rows), 10)
    log, lines, array = scratch("log"), scratch("json"), scratch("array")
    write_log(parts, log)
    write_json(parts, lines)
    write_json_array(parts, array)
    back = [read_log(spark, log, parts=True), read_json(spark, lines, parts=True), read_json_array(spark, array, parts=True)]
    for df in back:
        assert _facts(df) == _facts(parts)
        assert explode_changes(df).count() == len(rows)
    for df, name in ((spark.read.option("lineSep", "@@@COMMIT@@@").text(log), r"^hot@@@"), (spark.read.text(lines), '"commit_hash":"hot"'),
                     (spark.read.text(array), '"commit_hash":"hot"')):
        order = [r.value for r in df.select("value", "_metadata.file_name", F.monotonically_increasing_id().alias("i")).orderBy("file_name", "i").collect()]
        places = [i for i, v in enumerate(v for v in order if v.strip()) if re.search(name, v)]
        assert places == list(range(places[0], places[0] + 10))
