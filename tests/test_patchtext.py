"""Diff dumps read by sections: headers carried over splits, odd paths, no sections."""

import os
import random

import pytest

from revlens.sources import patchtext as PT

HASH = "0123456789abcdef0123456789abcdef0123456{:d}"


def dump(seed, commits=40):
    """Text of a dump and what it holds."""
    rng = random.Random(seed)
    text, want = "", {}
    for c in range(commits):
        sha = f"{seed:02d}{c:038x}"
        text += f"commit {sha}\nAuthor: A <a@b>\n\n    commit {sha[:9]} in a message\n    diff --git a/x b/x\n\n"
        for _ in range(rng.choice((0, 1, 1, 2, 5))):
            kind, name = rng.choice(("plain", "plain", "quoted", "deleted", "binary", "rename")), f"f{rng.randrange(4)}.txt"
            add, rem = rng.randrange(6), rng.randrange(6)
            body = " context\n commit deadbeef1\n" + "+plus\n" * add + "-minus\n" * rem + "+commit 1234567\n" + "\\ No newline at end of file\n"
            shown, real = (f'"b/\\303\\251 \\"{name}\\t"', f'é "{name}\t') if kind == "quoted" else (f"b/{name}", name)
            text += f"diff --git a/{name} b/{name}\nindex 1..2 100644\n"
            if kind == "binary":
                text += f"Binary files a/{name} and b/{name} differ\n"
            elif kind == "rename":
                text += f"similarity index 100%\nrename from {name}\nrename to z{name}\n"
            else:
                text += f"--- a/{name}\n+++ {'/dev/null' if kind == 'deleted' else shown}\n@@ -1 +1 @@\n{body}"
                if kind != "deleted":
                    want[(sha, real)] = (add + 1, rem)
        text += "\n"
    return text, want


@pytest.mark.parametrize("split", ["134217728", "2000"])
def test_sections_of_many_files_and_splits(spark, scratch, split):
    path = scratch("dumps")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    want = {}
    for k in range(3):
        text, found = dump(k)
        want |= found
        with open(os.path.join(local, f"d{k}.patch"), "w") as f:
            f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "4194304" if split != "2000" else "1")
    try:
        rows = PT.patch_scan(spark, path).collect()
        splits = PT.section_rows(spark, path).select("file", "start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits == 3 if split != "2000" else splits > 9
    assert {(r.commit_hash, r.file_path): (r.additions, r.deletions) for r in rows} == want and len(rows) == len(want)


def test_dumps_without_headers_or_sections(spark, scratch):
    path = scratch("odd")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    for name, text in {"a": "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+one\n", "b": "", "c": f"commit {HASH.format(1)}\n\n    nothing\n"}.items():
        with open(os.path.join(local, name), "w") as f:
            f.write(text)
    (r,) = PT.patch_scan(spark, path).collect()
    assert (r.commit_hash, r.file_path, r.additions, r.deletions) == (None, "x", 1, 0)
