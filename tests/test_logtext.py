"""Text sources: marker logs, file-stat lines, numstat / name-status, unified diffs, round trip."""

import pytest
from pyspark.sql import functions as F

from helpers import commit_rows, utc
from revlens.functions.scalar import strip_ws
from revlens.operators.reshape import explode_changes
from revlens.sources import logtext as LT

C, FD = "@@@COMMIT@@@", "@@@FIELD@@@"


def rec(h, parents, name, email, date, epoch, msg, lines=()):
    head = f"{C}{h}{FD}{parents}{FD}{name}{FD}{email}{FD}{date}\t{epoch}{FD}---MSG_START---{msg}---MSG_END---"
    return head + "".join("\n" + ln for ln in lines) + "\n"


def write(scratch, text):
    import os

    path = scratch("log")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "part-0.log"), "w") as fh:
        fh.write(text)
    return path


def test_records_with_binary_root_and_renamed_files(spark, scratch):
    text = (rec("f00d", "", "Zoe Q", "zoe@corp.test", "2019-07-04T08:30:00+09:00", 1562196600, "import tree",
                ["300\t0\tA\tlib/core.c", "-\t-\tA\tart/logo.png", "7\t0\tA\tREADME", ""])
            + rec("beef", "f00d", "Max P", "max@corp.test", "2019-08-01T00:00:00Z", 1564617601, "tidy up",
                  ["4\t9\tM\tlib/core.c"])
            + rec("cafe", "beef f00d", "Zoe Q", "zoe@corp.test", "2019-08-02T23:59:59-05:00", 1564808399, "join work"))
    commits = LT.read_log(spark, write(scratch, text))
    got = {r.commit_hash: r for r in commits.collect()}
    assert {h: list(r.parent_hashes) for h, r in got.items()} == {"f00d": [], "beef": ["f00d"], "cafe": ["beef", "f00d"]}
    # commit_date and commit_timestamp are independent fields: both kept as given
    assert got["beef"].commit_timestamp == 1564617601
    assert got["beef"].commit_date.replace(tzinfo=None) == utc(2019, 8, 1).replace(tzinfo=None)
    assert [(f.file_path, f.additions, f.deletions) for f in got["f00d"].file_changes] == [
        ("lib/core.c", 300, 0), ("art/logo.png", 0, 0), ("README", 7, 0)]
    assert explode_changes(commits).count() == 5


def test_message_over_lines_and_untyped_file_line(spark, scratch):
    text = rec("d1ce", "", "P", "p@q", "2020-02-29T12:00:00+02:00", 1582970400, "first\n\nthird\n", ["8\t0\tdocs/a b.txt"])
    (c,) = LT.read_log(spark, write(scratch, text)).collect()
    assert c.commit_message == "first\n\nthird"
    assert [(f.file_path, f.change_type, f.additions) for f in c.file_changes] == [("docs/a b.txt", "", 8)]


def test_commits_without_file_stats_explode_to_null_rows(spark, scratch):
    text = rec("a", "", "N", "e", "2023-01-01T00:00:00Z", 1, "m") + rec("b", "a", "N", "e", "2023-01-02T00:00:00Z", 2, "m")
    rows = explode_changes(LT.read_log(spark, write(scratch, text))).collect()
    assert len(rows) == 2
    assert all(r.file_paths is None and r.additions == 0 and r.deletions == 0 for r in rows)


def test_line_parser_cases(spark):
    lines = ["10\t5\tfile.txt", "-\t-\tf", "10\t5", "abc\tdef\tf", "10\t5\t", "", "M", "\tf",
             "10\t5\tM\t", "diff --git a/x b/x", "a" * 40, "1\t2\tA\tok"]
    df = spark.createDataFrame([("\n".join(lines),)], "block string")
    (r,) = df.select(LT.file_stat_parse(F.col("block")).alias("fc")).collect()
    got = [(f.file_path, f.additions, f.deletions, f.change_type) for f in r.fc]
    assert got == [("file.txt", 10, 5, ""), ("f", 0, 0, ""), ("M", 10, 5, ""), ("ok", 1, 2, "A")]


def test_malformed_records_rejected(spark):
    good = rec("g", "", "N", "e", "2023-01-01T00:00:00Z", 1, "m")[len(C):]
    no_end = good.replace("---MSG_END---", "")
    bad_date = rec("b", "", "N", "e", "yesterday", 1, "m")[len(C):]
    bad_epoch = rec("x", "", "N", "e", "2023-01-01T00:00:00Z", "soon", "m")[len(C):]
    few = f"f{FD}p{FD}n---MSG_END---"
    df = spark.createDataFrame([(v,) for v in (good, no_end, bad_date, bad_epoch, few)], "value string")
    assert [r.commit_hash for r in LT.log_parse(df).collect()] == ["g"]
    assert LT.log_parse(df, keep_rejects=True).count() == 4


def test_empty_message_policy(spark):
    raw = rec("e", "", "N", "e", "2023-01-01T00:00:00Z", 1, "")[len(C):]
    df = spark.createDataFrame([(raw,)], "value string")
    assert LT.log_parse(df).first().commit_message == ""
    assert LT.log_parse(df, empty_message_fallback=True).first().commit_message == "---MSG_START------MSG_END---"


def test_render_parse_round_trip(spark, scratch):
    commits = commit_rows(spark, [
        {"commit_hash": f"h{i}", "parent_hashes": [f"h{i-1}"] if i else [], "author_name": f"n{i % 3}",
         "author_email": f"e{i % 3}@x", "commit_date": utc(2024, 1, 1 + i % 28), "commit_timestamp": 1704067200 + 86400 * i,
         "commit_message": f"subject {i}\n\nbody", "file_changes": [(f"p{i}/a.txt", i, 1, "M", None), (f"q{i}", 0, 2, "", None)]}
        for i in range(50)])
    path = scratch("rt")
    LT.write_log(commits, path)
    back = LT.read_log(spark, path)
    key = lambda r: (r.commit_hash, tuple(r.parent_hashes), r.author_name, r.author_email, r.commit_timestamp,
                     r.commit_message, tuple((f.file_path, f.additions, f.deletions, f.change_type) for f in r.file_changes))
    assert sorted(map(key, back.collect())) == sorted(map(key, commits.collect()))


def test_numstat_parse(spark):
    df = spark.createDataFrame([(v,) for v in ["1\t2\ta.txt", "-\t-\tbin", "x\t1\tbad", "1\t2", "3\t4\tpath\twith tab",
                                               "5\t6\t  "]], "value string")
    got = [(r.file_path, r.additions, r.deletions) for r in LT.numstat_parse(df).collect()]
    assert got == [("a.txt", 1, 2), ("bin", 0, 0), ("path\twith tab", 3, 4)]


def test_numstat_cli_variant_skips_header(spark):
    df = spark.createDataFrame([(v,) for v in ["a" * 40, "1\t2\tA\tnew.txt", "1\t2\tp"]], "value string")
    got = [(r.file_path, r.additions) for r in LT.numstat_parse(df, cli_variant=True).collect()]
    assert got == [("new.txt", 1), ("p", 1)]


def test_name_status_parse(spark):
    df = spark.createDataFrame([(v,) for v in ["M\tfile.txt", "A\tnew.txt", "D\told.txt", "R100\told.txt\tnew.txt",
                                               "C090\tsrc.txt\tdst.txt", "", "M", "\tf"]], "value string")
    got = [(r.change_type, r.file_path, r.old_file_path) for r in LT.name_status_parse(df).collect()]
    assert got == [("M", "file.txt", None), ("A", "new.txt", None), ("D", "old.txt", None),
                   ("R100", "new.txt", "old.txt"), ("C090", "dst.txt", "src.txt")]


def test_patch_line_stats(spark):
    patch = ("diff --git a/f.txt b/f.txt\nindex 1..2 100644\n--- a/f.txt\n+++ b/f.txt\n@@ -1,2 +1,2 @@\n"
             " same\n-old\n+new\n+more\ndiff --git a/g.txt b/g.txt\n--- a/g.txt\n+++ /dev/null\n-gone\n"
             "diff --git a/h b/h\n--- a/h\n+++ b/h\n---x\n+++y\n+z\n")
    df = spark.createDataFrame([("c", patch)], "commit_hash string, patch string")
    got = sorted((r.file_path, r.additions, r.deletions) for r in LT.patch_line_stats(df).collect())
    assert got == [("f.txt", 2, 1), ("h", 1, 0)]


def test_json_round_trip(spark, scratch):
    commits = commit_rows(spark, [{"commit_hash": "a", "commit_date": utc(2023, 2, 3, 4, 5, 6),
                                   "file_changes": [("x", 1, 2, "M", None)]}])
    path = scratch("json")
    LT.write_json(commits, path)
    (r,) = LT.read_json(spark, path).collect()
    assert r.commit_hash == "a" and r.file_changes[0].file_path == "x"
    assert r.commit_date.replace(tzinfo=None) == utc(2023, 2, 3, 4, 5, 6).replace(tzinfo=None)


def test_name_status_dict_variant(spark):
    df = spark.createDataFrame([(v,) for v in ["M\tfile.txt ", "R100\told.txt\tnew.txt", "A\ta\tb\tc", "", "D"]],
                               "value string")
    got = [(r.change_type, r.file_path, r.old_file_path) for r in LT.name_status_parse(df, dict_variant=True).collect()]
    assert got == [("M", "file.txt", None), ("R100", "new.txt", None)]


def test_json_array_over_many_files(spark, scratch):
    import glob
    import json

    rows = [{"commit_hash": f"h{i}", "commit_timestamp": 1000 + i % 7, "commit_message": 'a "quoted" [x],\n{y}'} for i in range(50)]
    commits = commit_rows(spark, rows).withColumn("file_changes", F.expr("array(named_struct('file_path', 'p', 'additions', 1L, 'deletions', 2L, 'change_type', 'M', 'old_file_path', cast(null as string)))"))
    path = scratch("json-array")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        LT.write_json_array(commits.repartition(4), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(glob.glob(f"{path.removeprefix('file:')}/part-*"))
    whole = json.loads("".join(open(f).read() for f in files))
    assert len(files) > 3 and [(c["commit_timestamp"], c["commit_hash"]) for c in whole] == sorted(
        ((r["commit_timestamp"], r["commit_hash"]) for r in rows), key=lambda x: (-x[0], x[1]))
    back = LT.read_json_array(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, commits.select(*back.columns).collect()))
    LT.write_json_array(commits.limit(0), f"{path}-none")
    assert LT.read_json_array(spark, f"{path}-none").count() == 0
    spark.createDataFrame([("[",), ('{"commit_hash": "k"},',), ('{"commit_hash": "m"}',), ("]",)], "value string").coalesce(1).write.text(f"{path}-ends")
    assert {r.commit_hash for r in LT.read_json_array(spark, f"{path}-ends").collect()} == {"k", "m"}
    spark.createDataFrame([("[",), (" {",), (' "commit_hash": "k" }]',)], "value string").coalesce(1).write.text(f"{path}-indented")
    with pytest.raises(Exception, match="not one object a line"):
        LT.read_json_array(spark, f"{path}-indented").collect()


def test_strip_is_python_strip(spark):
    edges = ["", " ", "\t\n", "\u3000", "\x85a\u2028", " a b\u00a0", "a", "\x1c-\x1f", "e\u0301 ", "\u200bx\u200b", "x\u205f\u1680", None]
    rows = spark.createDataFrame([(x,) for x in edges], "v string").select("v", strip_ws("v").alias("o")).collect()
    assert [r.o for r in rows] == [None if r.v is None else r.v.strip() for r in rows]


def test_patch_lines_at_every_kind_of_break(spark):
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", "\u2028"]
    patches = [f"diff --git a/x b/x{e}--- a/x{e}+++ b/x{e}+one{e}+{e}++two{e}+++three{e}-{e}---four{e}-five{e}{e} +six{e}" for e in breaks]
    rows = LT.patch_line_stats(spark.createDataFrame([(str(i), p) for i, p in enumerate(patches)], "commit_hash string, patch string")).collect()
    assert sorted((int(r.commit_hash), r.file_path, r.additions, r.deletions) for r in rows) == [(i, "x", 3, 2) for i in range(len(breaks))]
