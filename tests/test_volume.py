"""What steps move and how often they read, where that decides whether a large history fits."""

import hashlib
import os
import time

import pytest
from conftest import SMOKE
from helpers import change_rows, commit_rows
from pyspark.sql import functions as F
from revlens.functions.scalar import strip_ws
from revlens.operators import diff as D
from revlens.operators import graph as G
from revlens.operators.reshape import commit_parts
from revlens.plans import queries_flows, queries_io
from revlens.session import materialize, persist_rows, persist_table
from revlens.sources import logtext as LT
from revlens.sources import patchtext as PT
from revlens.sources import testdata as td


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dumps_are_read_once(spark, scratch):
    path = scratch("dumps")
    spark.createDataFrame([("commit 0123456789\n\n    m\n\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+one\n",)], "value string").write.text(path)
    found = PT.patch_scan(spark, path)
    assert found.inputFiles() and all(f.endswith(".parquet") for f in found.inputFiles())
    assert [tuple(r) for r in found.collect()] == [("0123456789", "x", 1, 0)]


def test_patch_dumps_are_compressed_and_not_shuffled_as_text(spark, monkeypatch):
    paths, scan = [], PT.patch_scan
    monkeypatch.setattr(PT, "patch_scan", lambda s, p: paths.append(p) or scan(s, p))
    queries_io.q_patch_scan(spark, SMOKE)
    assert all(f.endswith(".gz") for f in spark.read.text(paths[0]).inputFiles())
    assert "added line" not in next(x for x in _plan(queries_io.q_patch_line_stats(spark, SMOKE)).splitlines() if "collect_list" in x)


def test_scanned_dump_has_a_file_a_shuffle_partition(spark, monkeypatch):
    paths, scan = [], LT.log_scan
    monkeypatch.setattr(LT, "log_scan", lambda s, p: paths.append(p) or scan(s, p))
    queries_io.q_log_scan(spark, SMOKE)
    assert len(spark.read.text(paths[0]).inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_json_array_is_written_from_one_sort(spark, scratch, monkeypatch):
    def no(df):
        raise AssertionError("checkpointed")

    monkeypatch.setattr("revlens.operators.ranking.materialize", no)
    commits = commit_rows(spark, [{"commit_hash": f"c{i}", "commit_timestamp": i} for i in range(40)])
    path = scratch("array")
    LT.write_json_array(commits.repartition(5), path)
    assert LT.read_json_array(spark, path).count() == 40
    LT.write_json_array(commits.limit(0), f"{path}-none")
    assert [r.value for r in spark.read.text(f"{path}-none").collect()] == ["[]"]


def test_parts_cut_from_nested_rows_equal_those_from_the_sort(spark):
    rows = [{"commit_hash": f"c{i % 7}" if i % 7 else None, "author_name": f"a{i % 7}", "file_paths": f"p{i % 5}", "additions": i % 3} for i in range(60)]
    flat = change_rows(spark, [*rows, {"commit_hash": "none", "file_paths": None}])
    facts = lambda df: sorted((r.commit_hash or "", r.part, r.author_name, r.file_changes) for r in df.collect())
    nested = facts(commit_parts(flat, 2))
    assert nested == facts(commit_parts(flat, 2, whole_up_to=1)) and max(len(c) for *_, c in nested) == 2


def test_text_is_trimmed_without_a_regular_expression(spark):
    assert "regexp" not in _plan(spark.createDataFrame([("\n a  ",)], "t string").select(strip_ws("t")))


def test_resent_history_is_assembled_once(spark, monkeypatch):
    files, write = [], LT.write_log
    monkeypatch.setattr(LT, "write_log", lambda commits, path: files.extend(commits.inputFiles()) or write(commits, path))
    queries_flows.q_stream_newest_first(spark, SMOKE)
    assert files and not any(os.path.basename(f).startswith(("lineitem", "orders")) for f in files)


def test_chains_are_thinned_out_before_they_are_doubled(spark, monkeypatch):
    links = spark.range(1, 3000).select(F.concat(F.lit("n"), "id").alias("v"), F.concat(F.lit("n"), F.col("id") - 1).alias("r"))
    moved, doubled = [], G._doubled
    monkeypatch.setattr(G, "_doubled", lambda x: moved.append(x.count()) or doubled(x))
    roots = G._roots_of(links)
    assert roots.count() == 2999 and roots.where("r <> 'n0'").isEmpty() and moved[0] < 600


def test_files_used_up_by_very_similar_pairs_are_not_compared_again(spark, monkeypatch):
    text = lambda i, last: "\n".join([*[f"common {j}" for j in range(12)], *[f"{i} {j}" for j in range(7)], last])
    rows = lambda folder, last: spark.createDataFrame(
        [("c", f"{folder}/{i:02d}", text(i, last)) for i in range(20)], "commit_hash string, path string, content string")
    old, new = rows("old", "before"), rows("new", "after")
    found, pairs = [], D.similar_pairs
    monkeypatch.setattr(D, "similar_pairs", lambda *a: found.append(pairs(*a)) or found[-1])
    got = D.similar_renames(D.renamed_diff(old, new), old, new).collect()
    assert sorted((r.path, r.old_file_path, r.similarity) for r in got) == [(f"new/{i:02d}", f"old/{i:02d}", 95) for i in range(20)]
    assert sum(f.count() for f in found) == 20  # each of 400 pairs shares 60 percent


def test_texts_of_added_files_are_counted_where_they_are_read(spark):
    rows = lambda n: spark.createDataFrame([("c", f"p{i}", f"text {i}\nmore") for i in range(n)], "commit_hash string, path string, content string")
    plan = _plan(D.snapshot_diff(rows(3), rows(5)))
    added = plan[:plan.index("Join LeftSemi")]  # the first branch: above the join only its line counts are left
    assert "splitlines" not in added and "split(" not in added
    assert sorted((r.path, r.change_type, r.additions) for r in D.snapshot_diff(rows(3), rows(5)).collect()) == [("p3", "A", 2), ("p4", "A", 2)]


def test_part_number_is_searched_only_behind_its_mark(spark):
    records = spark.createDataFrame([(f"h@@@FIELD@@@@@@FIELD@@@n@@@FIELD@@@e@@@FIELD@@@2020-01-01T00:00:00Z\t1577836800@@@FIELD@@@{LT.MSG_START}m{LT.MSG_END}\n{tail}",)
                                     for tail in ("1\t2\tp", f"{LT.PART_MARK}3\n1\t2\tp", f"{LT.PART_MARK}x\n1\t2\tp")], "value string")
    parsed = LT.log_parse(records, parts=True)
    assert [(r.part, len(r.file_changes)) for r in parsed.collect()] == [(0, 1), (3, 1), (0, 1)]
    plan = _plan(parsed)
    assert "CASE WHEN StartsWith(_tail" in plan and plan.count("regexp_extract(substring_index(_tail") == 1


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


@pytest.mark.parametrize("kept", [persist_table, persist_rows, materialize])
def test_shuffles_go_with_the_write_that_made_them(spark, kept):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = _shuffle_files(spark)
    rows = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids")).orderBy("k"))
    for _ in range(100):  # files are removed behind the action
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and spark.conf.get(setting) == "false"
    assert sorted((r.k, len(r.ids)) for r in rows.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


def test_rows_with_a_type_that_parquet_lacks_are_kept(spark):
    rows = spark.createDataFrame([(1,), (2,)], "a int").withColumn("none", F.lit(None))
    assert sorted(tuple(r) for r in persist_rows(rows).collect()) == [(1, None), (2, None)]


def test_changes_are_joined_by_the_key_they_are_grouped_by(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = td.commits(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 6  # two sides of three joins


def test_array_is_written_compressed(spark, scratch, monkeypatch):
    paths, read = [], LT.read_json_array
    monkeypatch.setattr(LT, "read_json_array", lambda s, p, **k: paths.append(p) or read(s, p, **k))
    queries_io.q_json_array_roundtrip(spark, SMOKE)
    queries_io.q_json_parts_roundtrip(spark, SMOKE)
    for p in paths:
        files = spark.read.text(p).inputFiles()
        assert files and all(f.endswith(".gz") for f in files)
    path = scratch("array")
    LT.write_json_array(commit_rows(spark, [{"commit_hash": f"c{i}", "commit_timestamp": i} for i in range(40)]).repartition(5), path, compression="gzip")
    assert sorted(r.commit_hash for r in LT.read_json_array(spark, path).collect()) == sorted(f"c{i}" for i in range(40))


def test_array_lines_are_told_apart_as_before(spark, scratch):
    path = scratch("lines")
    spark.createDataFrame([(x,) for x in ("[", " \t", ",", "[,]", "]", ' ,\t[{"commit_hash":"a, ]"} ,\x0b', '{"commit_hash":"b"}]')], "value string").write.text(path)
    assert sorted(r.commit_hash for r in LT.read_json_array(spark, path).collect()) == ["a, ]", "b"]
    spark.createDataFrame([("][",)], "value string").write.text(f"{path}-odd")
    with pytest.raises(Exception, match="not one object a line"):
        LT.read_json_array(spark, f"{path}-odd").collect()


def test_parts_are_streamed_from_compressed_dumps(spark, monkeypatch):
    paths, board = [], queries_flows._board_of
    monkeypatch.setattr(queries_flows, "_board_of", lambda s, src, n: paths.append(src) or board(s, src, n))
    queries_flows.q_stream_parts(spark, SMOKE)
    files = spark.read.text(paths[0]).inputFiles()
    assert files and all(f.endswith(".gz") for f in files)


def test_a_content_of_many_files_takes_its_partners_in_few_rounds(spark, monkeypatch):
    text = lambda last: "\n".join([*[f"common {j}" for j in range(9)], last])
    old = [(f"old/{i:02d}", text("same")) for i in range(20)] + [("old/other", text("other"))]
    new = [(f"new/{i:02d}", text(f"new {i // 2}")) for i in range(30)]  # 15 contents of two files for 21
    rows = lambda files: spark.createDataFrame([("c", *f) for f in files], "commit_hash string, path string, content string")
    names, persist = [], D.persist_table
    monkeypatch.setattr(D, "persist_table", lambda df, name="table", *a: names.append(name) or persist(df, name, *a))
    got = D.similar_renames(D.renamed_diff(rows(old), rows(new)), rows(old), rows(new)).collect()

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    pairs = sorted((hashlib.md5(f"{digest(o)}/{digest(n)}".encode()).hexdigest(), p, q) for p, o in old for q, n in new)
    chosen: dict[str, str] = {}
    for _, p, q in pairs:
        if p not in chosen.values() and q not in chosen:
            chosen[q] = p
    assert {r.path: r.old_file_path for r in got if r.change_type == "R"} == chosen and len(chosen) == 21
    assert sum(n == "similar-pairs" for n in names) <= 8 and sum(n.startswith("similar-") for n in names) <= 10
