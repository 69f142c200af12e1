"""Commit graph, stat merges, snapshot diffs, exact renames, set comparison."""

import pytest

from helpers import commit_rows
from revlens.operators import diff as D
from revlens.operators import graph as G


def _dag(spark):
    # a <- b <- c <- e (merge of c and d), a <- d ; f isolated root; g child of missing parent
    edges = {"a": [], "b": ["a"], "c": ["b"], "d": ["a"], "e": ["c", "d"], "f": [], "g": ["zz"]}
    return commit_rows(spark, [{"commit_hash": h, "parent_hashes": p} for h, p in edges.items()])


def test_reachable_from(spark):
    dag = _dag(spark)
    tips = spark.createDataFrame([("e",)], "commit_hash string")
    assert sorted(r.commit_hash for r in G.reachable_from(dag, tips).collect()) == ["a", "b", "c", "d", "e"]
    tips2 = spark.createDataFrame([("d",), ("b",)], "commit_hash string")
    assert sorted(r.commit_hash for r in G.reachable_from(dag, tips2).collect()) == ["a", "b", "d"]


def test_all_refs(spark):
    got = sorted(r.commit_hash for r in G.all_refs_commits(_dag(spark)).collect())
    assert got == ["a", "b", "c", "d", "e", "f", "g", "zz"]


def test_first_parent(spark):
    fp = {r.commit_hash: (r.first_parent, r.parent_author) for r in G.first_parent(_dag(spark)).collect()}
    assert fp["e"] == ("c", "a") and fp["a"] == (None, None) and fp["g"] == ("zz", None)


def test_merge_stats_full_outer(spark):
    num = spark.createDataFrame([("c", 1, "x", 1, 2), ("c", 2, "x", 5, 6), ("c", 3, "y", 1, 1)],
                                "commit_hash string, pos int, file_path string, additions long, deletions long")
    ns = spark.createDataFrame([("c", 1, "x", "A"), ("c", 2, "x", "M"), ("c", 3, "z", "D")],
                               "commit_hash string, pos int, file_path string, change_type string")
    got = sorted(tuple(r) for r in D.merge_stats(num, ns).collect())
    assert got == [("c", "x", 5, 6, "M"), ("c", "y", 1, 1, "U"), ("c", "z", 0, 0, "D")]
    assert D.touched_paths(num, ns).count() == 3


def _snap(spark, rows):
    return spark.createDataFrame(rows, "commit_hash string, path string, content string")


def test_snapshot_diff_and_renames(spark):
    old = _snap(spark, [("c", "keep", "a\nb\nc\n"), ("c", "gone", "x\ny"), ("c", "moved", "same\n"),
                        ("c", "src", "copy me\n")])
    new = _snap(spark, [("c", "keep", "a\nB\nc\nd\n"), ("c", "added", "1\n2\n3"), ("c", "moved2", "same\n"),
                        ("c", "src", "copy me\n"), ("c", "copy", "copy me\n")])
    diff = D.snapshot_diff(old, new)
    got = sorted((r.path, r.change_type, r.additions, r.deletions) for r in diff.collect())
    assert got == [("added", "A", 3, 0), ("copy", "A", 1, 0), ("gone", "D", 0, 2), ("keep", "M", 2, 1),
                   ("moved", "D", 0, 1), ("moved2", "A", 1, 0)]
    ren = sorted((r.path, r.change_type, r.old_file_path) for r in D.exact_renames(diff, old, new).collect())
    assert ren == [("added", "A", None), ("copy", "C", "src"), ("gone", "D", None), ("keep", "M", None),
                   ("moved2", "R", "moved")]


def test_text_lines_matches_splitlines(spark):
    from pyspark.sql import functions as F

    from revlens.functions.scalar import count_text_lines

    samples = ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n", "\n\n", "a\rb", "x\x0by\x0c", "a b", "a\x85"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    rows = df.select("t", D.text_lines(F.col("t")).alias("l"), count_text_lines("t").alias("n")).collect()
    for r in rows:
        assert list(r.l) == r.t.splitlines(), repr(r.t)
        assert r.n == len(r.t.splitlines()), repr(r.t)


def test_change_set_diff_tolerance(spark):
    from helpers import utc

    a = commit_rows(spark, [{"commit_hash": "1", "commit_message": "m", "commit_timestamp": 100, "parent_hashes": ["p", "q"]},
                            {"commit_hash": "2", "commit_message": "n", "commit_timestamp": 200}])
    b = commit_rows(spark, [{"commit_hash": "x", "commit_message": "  m\n", "commit_timestamp": 102, "parent_hashes": ["q", "p"]},
                            {"commit_hash": "y", "commit_message": "n", "commit_timestamp": 203,
                             "commit_date": utc(2023, 1, 1)}])
    got = sorted((r.side, r.message, r.ts) for r in D.change_set_diff(a, b).collect())
    assert got == [("only_a", "n", 200), ("only_b", "n", 203)]


def test_all_refs_with_explicit_refs(spark):
    refs = spark.createDataFrame([("c",)], "commit_hash string")
    got = sorted(r.commit_hash for r in G.all_refs_commits(_dag(spark), refs).collect())
    assert got == ["a", "b", "c"]


def test_reachable_includes_parents_outside_the_history(spark):
    tips = spark.createDataFrame([("e",), ("g",), (None,), ("e",)], "commit_hash string")
    assert sorted(r.commit_hash for r in G.reachable_from(_dag(spark), tips).collect()) == ["a", "b", "c", "d", "e", "g", "zz"]


def test_snapshot_diff_patch_override(spark):
    old = _snap(spark, [("c", "m", "a\nb\n")])
    new = _snap(spark, [("c", "m", "a\nc\n")])
    ps = spark.createDataFrame([("c", "m", 7, 9)], "commit_hash string, file_path string, additions long, deletions long")
    (r,) = D.snapshot_diff(old, new, patch_stats=ps).collect()
    assert (r.change_type, r.additions, r.deletions, r.count_kind) == ("M", 7, 9, "patch")
    (r,) = D.snapshot_diff(old, new).collect()
    assert r.count_kind == "net"


def test_tree_changes_against_first_parent(spark):
    commits = commit_rows(spark, [{"commit_hash": "r", "parent_hashes": []},
                                  {"commit_hash": "x", "parent_hashes": ["r"]},
                                  {"commit_hash": "m", "parent_hashes": ["x", "r"]}])
    trees = _snap(spark, [("r", "a", "1\n"), ("x", "a", "1\n2\n"), ("x", "b", "b\n"), ("m", "b", "b\n"),
                          ("m", "c", "c\nc\n")])
    got = sorted((r.commit_hash, r.path, r.change_type, r.additions, r.deletions)
                 for r in D.tree_changes(commits, trees).collect())
    assert got == [("m", "a", "D", 0, 2), ("m", "c", "A", 2, 0), ("r", "a", "A", 1, 0),
                   ("x", "a", "M", 1, 0), ("x", "b", "A", 1, 0)]


def test_max_rounds_raises_instead_of_truncating(spark):
    import pytest as _pytest

    tips = spark.createDataFrame([("e",)], "commit_hash string")
    with _pytest.raises(RuntimeError):
        G.reachable_from(_dag(spark), tips, max_rounds=1)
    assert G.reachable_from(_dag(spark), tips, max_rounds=2).count() == 5


def test_straight_history_takes_few_jumps(spark):
    n = 300
    commits = commit_rows(spark, [{"commit_hash": f"n{i}", "parent_hashes": [f"n{i - 1}"] if i else []} for i in range(n)])
    tips = spark.createDataFrame([("n250",)], "commit_hash string")
    # the plain rounds, then one contraction takes the rest of the chain
    assert G.reachable_from(commits, tips, max_rounds=G.PLAIN + 1).count() == 251


@pytest.mark.parametrize("shape", ["ladder", "nested", "crossed"])
def test_deep_merges_take_few_rounds(spark, shape):
    """Second-parent edges in a row, branches merged inside branches, and criss-cross merges."""
    n = 120
    if shape == "ladder":  # the way down is always the second parent
        rows = {f"n{i}": [f"x{i}", f"n{i + 1}"] for i in range(n)} | {f"x{i}": ["root"] for i in range(n)} | {f"n{n}": ["root"], "root": []}
    elif shape == "nested":  # branch i leaves the line at a{i} and comes back at m{i}, around branch i + 1
        rows = {f"m{i}": [f"a{i}", f"m{i + 1}"] for i in range(n)} | {f"a{i + 1}": [f"a{i}"] for i in range(n)} | {f"m{n}": [f"a{n}"], "a0": []}
    else:
        rows = {f"{s}{i}": [f"a{i + 1}", f"b{i + 1}"][:: 1 if s == "a" else -1] for i in range(n) for s in "ab"} | {f"a{n}": [], f"b{n}": []}
    rows |= {"other": ["side"], "side": [], "above": [next(iter(rows))]}
    commits = commit_rows(spark, [{"commit_hash": h, "parent_hashes": p} for h, p in rows.items()])
    top = next(iter(rows))
    want, stack = set(), [top]
    while stack:
        h = stack.pop()
        if h not in want:
            want.add(h)
            stack.extend(rows[h])
    tips = spark.createDataFrame([(top,)], "commit_hash string")
    assert {r.commit_hash for r in G.reachable_from(commits, tips, max_rounds=G.PLAIN + 6).collect()} == want


def test_tree_changes_with_a_branch_point_of_many_children(spark):
    kids = [{"commit_hash": f"k{i}", "parent_hashes": ["r"]} for i in range(7)]
    commits = commit_rows(spark, [{"commit_hash": "r", "parent_hashes": []}] + kids)
    trees = _snap(spark, [("r", "a", "1\n"), ("r", "b", "2\n")] + [(f"k{i}", "a", f"{i}\n") for i in range(7)])
    got = sorted((r.commit_hash, r.path, r.change_type) for r in D.tree_changes(commits, trees).collect())
    want = sorted([("r", "a", "A"), ("r", "b", "A")] + [(f"k{i}", "b", "D") for i in range(7)]
                  + [(f"k{i}", "a", "M") for i in range(7) if i != 1])
    assert got == want


def test_reachability_matches_brute_force_on_random_dag(spark):
    import random

    rng = random.Random(11)
    n = 300
    parents = {f"n{i}": [f"n{j}" for j in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2])))] for i in range(n)}
    parents["n299"].append("missing")  # a parent outside the history
    commits = commit_rows(spark, [{"commit_hash": h, "parent_hashes": p} for h, p in parents.items()])
    tips = [f"n{i}" for i in (299, 250, 120)]
    seen, stack = set(), list(tips)
    while stack:
        h = stack.pop()
        if h not in seen:
            seen.add(h)
            stack.extend(parents.get(h, []))
    tip_df = spark.createDataFrame([(t,) for t in tips], "commit_hash string")
    assert sorted(r.commit_hash for r in G.reachable_from(commits, tip_df).collect()) == sorted(seen)


def test_merge_stats_needs_positions(spark):
    import pytest as _pytest

    num = spark.createDataFrame([("c", "x", 1, 2)], "commit_hash string, file_path string, additions long, deletions long")
    with _pytest.raises(ValueError):
        D.merge_stats(num, num)


def _pairing(a, b, tol=2):
    """Most pairs within the tolerance, by time order: what stays on either side."""
    a, b, only = sorted(a), sorted(b), []
    while a and b:
        if abs(a[0] - b[0]) <= tol:
            a.pop(0), b.pop(0)
        else:
            only.append(("only_a", a.pop(0)) if a[0] < b[0] else ("only_b", b.pop(0)))
    return sorted(only + [("only_a", t) for t in a] + [("only_b", t) for t in b])


def test_change_set_diff_one_missing_commit_shifts_nothing(spark):
    row = lambda i, t: {"commit_hash": str(i), "commit_message": "m", "commit_timestamp": t}
    a = commit_rows(spark, [row(1, 0), row(2, 100)])
    b = commit_rows(spark, [row(3, 100)])
    assert [(r.side, r.ts) for r in D.change_set_diff(a, b).collect()] == [("only_a", 0)]


def test_change_set_diff_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    sides, want = ([], []), []
    for m in range(25):
        times = [[rng.randint(0, 30) for _ in range(rng.randint(0, 14))] for _ in range(2)]
        for rows, ts in zip(sides, times, strict=True):
            rows += [{"commit_hash": f"{m}-{len(rows)}", "commit_message": f"m{m}", "commit_timestamp": t} for t in ts]
        want += [(f"m{m}", side, t) for side, t in _pairing(*times)]
    got = D.change_set_diff(*(commit_rows(spark, rows) for rows in sides)).collect()
    assert sorted((r.message, r.side, r.ts) for r in got) == sorted(want)


def test_change_set_diff_long_runs_in_stretches(spark, monkeypatch):
    """Runs over many stretches and tree levels pair as the brute force does."""
    import random

    monkeypatch.setattr(D, "STRETCH_BITS", 2)
    rng = random.Random(8)
    sides, want = ([], []), []
    dense = list(range(-300, 300))
    some = lambda p, shift: [t + shift() for t in dense for _ in range(rng.choice((1, 1, 3))) if rng.random() < p]
    cases = [(dense, [t + 1 for t in dense]), (dense, dense[7:]), (some(0.5, lambda: 0), some(0.5, lambda: 0)), (dense, []),
             (some(0.9, lambda: 0), some(0.8, lambda: rng.randint(0, 3))), (some(0.2, lambda: 0), some(0.2, lambda: 2)),
             ([0, 4, 8, 8], [2, 6, 6, 10]), ([5], [1 << 33])]
    for m, times in enumerate(cases):
        for rows, ts in zip(sides, times, strict=True):
            rows += [{"commit_hash": f"{m}-{len(rows)}", "commit_message": f"m{m}", "commit_timestamp": t} for t in ts]
        want += [(f"m{m}", side, t) for side, t in _pairing(*times)]
    got = D.change_set_diff(*(commit_rows(spark, rows) for rows in sides))
    assert sorted((r.message, r.side, r.ts) for r in got.collect()) == sorted(want)


def test_change_set_diff_gathers_a_stretch_at_most(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(D, "STRETCH_BITS", 4)
    sizes, real = [], D.materialize

    def noted(df):
        out = real(df)
        sizes.extend(out.agg(F.max(F.size(c))).first()[0] or 0 for c in ("events", "children") if c in out.columns)
        return out

    monkeypatch.setattr(D, "materialize", noted)
    times = range(3000), range(1, 3000)
    a, b = (commit_rows(spark, [{"commit_hash": str(t), "commit_message": "", "commit_timestamp": t} for t in ts]) for ts in times)
    assert [(r.side, r.ts) for r in D.change_set_diff(a, b).collect()] == _pairing(*times)
    assert len(sizes) > 2 and max(sizes) <= 16 + 2


def test_change_set_diff_other_tolerances(spark):
    import random

    rng = random.Random(9)
    times = [sorted(rng.randint(0, 4000) for _ in range(700)) for _ in range(2)]
    a, b = (commit_rows(spark, [{"commit_hash": str(k), "commit_message": "m", "commit_timestamp": t} for k, t in enumerate(ts)]) for ts in times)
    for tol in (0, 7):
        got = sorted((r.side, r.ts) for r in D.change_set_diff(a, b, tol).collect())
        assert got == _pairing(*times, tol)


def _brute_renames(old, new, threshold=50):
    """Greedy 1:1 over all pairs of one commit's deleted and added files, by score, then hash, then paths."""
    import hashlib
    from collections import Counter

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    gone, come = {p: t for p, t in old.items() if p not in new}, {p: t for p, t in new.items() if p not in old}
    for digest in {h(t) for t in gone.values()}:  # equal contents first
        for a, b in zip(sorted(p for p, t in gone.items() if h(t) == digest), sorted(p for p, t in come.items() if h(t) == digest), strict=False):
            del gone[a], come[b]
    scored = []
    for a, s in gone.items():
        for b, t in come.items():
            x, y = Counter(s.splitlines()), Counter(t.splitlines())
            shared, longer = sum((x & y).values()), max(sum(x.values()), sum(y.values()))
            if shared and shared * 100 >= longer * threshold:
                tie = hashlib.md5(f"{h(s)}/{h(t)}".encode()).hexdigest()
                scored.append((-(shared * 100 // longer), tie, a, b, sum(y.values()) - shared, sum(x.values()) - shared))
    used, out = set(), []
    for score, _, a, b, plus, minus in sorted(scored):
        if ("o", a) not in used and ("n", b) not in used:
            used |= {("o", a), ("n", b)}
            out.append((b, a, plus, minus, -score))
    return sorted(out)


def test_similar_renames_equal_brute_force(spark):
    import random

    rnd = random.Random(5)
    commits = {}
    for c in range(4):
        pool = [f"line {i}" for i in range(30)] + ["", "}", "licence"]
        texts = ["\n".join(rnd.choices(pool, k=rnd.choice([0, 1, 4, 9, 20]))) for _ in range(25)]
        old = {f"old/{i:02d}": rnd.choice(texts) for i in range(30)}
        new = {}
        for i, t in enumerate(rnd.choices(list(old.values()), k=30)):
            ls = t.split("\n")
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                ls[rnd.randrange(len(ls))] = rnd.choice(pool)
            new[f"new/{i:02d}"] = "\n".join(ls)
        old["both"], new["both"] = "a", "b"
        commits[f"c{c}"] = (old, new)
    commits["only old"] = ({"x": "1\n2"}, {})
    rows = lambda k: spark.createDataFrame([(c, p, t) for c, sides in commits.items() for p, t in sides[k].items()],
                                           "commit_hash string, path string, content string")
    old, new = rows(0), rows(1)
    got = D.similar_renames(D.renamed_diff(old, new), old, new).collect()
    for c, (a, b) in commits.items():
        mine = [r for r in got if r.commit_hash == c]
        found = sorted((r.path, r.old_file_path, r.additions, r.deletions, r.similarity) for r in mine if r.change_type == "R" and (r.similarity < 100 or r.additions))
        want = _brute_renames(a, b)
        exact = [r for r in mine if r.change_type == "R" and r.similarity == 100 and a[r.old_file_path] == b[r.path]]
        assert found == [w for w in want if w[4] < 100 or w[2]]
        # every path is told once: as it is, or as one end of a rename
        ends = [r.path for r in mine] + [r.old_file_path for r in mine if r.change_type == "R"]
        assert sorted(ends) == sorted(set(a) | set(b) - {p for p in a if a[p] == b.get(p)})
        assert len(exact) + len(found) + sum(w[4] == 100 and not w[2] for w in want) >= len(exact)


def test_similar_renames_of_many_equal_files_and_none(spark):
    old = [("c", f"old/{i:03d}", "a\nb\nc\nd") for i in range(120)] + [("c", "keep", "x")]
    new = [("c", f"new/{i:03d}", "a\nb\nc\nE") for i in range(100)] + [("c", "keep", "x")]
    schema = "commit_hash string, path string, content string"
    o, n = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    got = D.similar_renames(D.renamed_diff(o, n), o, n).collect()
    assert sorted((r.path, r.old_file_path, r.additions, r.deletions, r.similarity) for r in got if r.change_type == "R") == \
        [(f"new/{i:03d}", f"old/{i:03d}", 1, 1, 75) for i in range(100)]
    assert sorted(r.path for r in got if r.change_type == "D") == [f"old/{i:03d}" for i in range(100, 120)]
    assert not D.similar_renames(D.renamed_diff(o, n), o, n, threshold=76).where("change_type = 'R'").count()
    none = o.limit(0)
    assert D.similar_renames(D.renamed_diff(none, none), none, none).count() == 0
