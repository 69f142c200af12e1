"""Author statistics: known answers, ties, empty input, legacy decile join."""

import random

import pandas as pd

from helpers import change_rows
from revlens.operators.ranking import with_decile, with_rank
from revlens.operators.stats import author_scoreboard, author_totals, decile_distribution


def _by_author(df):
    return {r["author_name"]: r.asDict() for r in df.collect()}


def test_rank_and_deciles_known_answer(spark):
    rows = [
        {"commit_hash": "1", "author_name": "a", "author_email": "a@x", "additions": 100},
        {"commit_hash": "2", "author_name": "b", "author_email": "b@x", "additions": 50},
        {"commit_hash": "3", "author_name": "c", "author_email": "c@x", "additions": 200},
        {"commit_hash": "4", "author_name": "d", "author_email": "d@x", "additions": 10},
    ]
    st = _by_author(author_scoreboard(change_rows(spark, rows)))
    assert [st[k]["rank"] for k in "cabd"] == [1, 2, 3, 4]
    assert [st[k]["diff_decile"] for k in "cabd"] == [1, 5, 8, 10]
    assert [st[k]["commit_decile"] for k in "cabd"] == [1, 1, 1, 1]


def test_totals_two_commits(spark):
    rows = [
        {"commit_hash": "h1", "author_name": "A", "author_email": "a@x", "additions": 10, "deletions": 5},
        {"commit_hash": "h2", "author_name": "A", "author_email": "a@x", "additions": 5, "deletions": 2},
        {"commit_hash": "h3", "author_name": "B", "author_email": "b@x", "additions": 20, "deletions": 10},
    ]
    st = _by_author(author_scoreboard(change_rows(spark, rows)))
    assert (st["A"]["total"], st["A"]["commits"]) == (22, 2)
    assert (st["B"]["total"], st["B"]["commits"]) == (30, 1)


def test_two_files_one_commit_counts_once(spark):
    rows = [
        {"commit_hash": "h1", "file_paths": "x", "additions": 10, "deletions": 5},
        {"commit_hash": "h1", "file_paths": "y", "additions": 0, "deletions": 0},
    ]
    (r,) = author_totals(change_rows(spark, rows)).collect()
    assert (r.added, r.deleted, r.commits) == (10, 5, 1)


def test_empty_input_gives_empty_stats(spark):
    out = author_scoreboard(change_rows(spark, []))
    assert out.count() == 0
    assert out.columns == ["author_email", "author_name", "added", "deleted", "commits", "total", "rank",
                           "diff_decile", "commit_decile"]


def test_null_author_dropped(spark):
    rows = [{"author_name": None, "additions": 5}, {"author_name": "x", "additions": 1}]
    assert [r.author_name for r in author_scoreboard(change_rows(spark, rows)).collect()] == ["x"]


def test_ordered_by_total_desc(spark):
    rows = [{"commit_hash": str(i), "author_name": f"n{i}", "author_email": f"e{i}", "additions": (i * 7) % 5}
            for i in range(20)]
    totals = [r.total for r in author_scoreboard(change_rows(spark, rows)).collect()]
    assert totals == sorted(totals, reverse=True)


def _reference_deciles(values):
    # the reference's loop, restated: leading tie group -> 1, later groups -> min(10, ceil(rank*10/n))
    s = sorted(values, reverse=True)
    n, out, cur = len(s), {}, 1
    for i, v in enumerate(s):
        if i > 0 and v < s[i - 1]:
            cur = min(10, -(-(i + 1) * 10 // n))
        out.setdefault(v, cur)
    return out


def test_rank_and_decile_match_pandas_on_random_ties(spark):
    rng = random.Random(7)
    for n in (1, 2, 5, 9, 10, 11, 37, 200):
        vals = [rng.choice([0, 1, 2, 3, 5, 8, 13, 10**6, -4, 2.5]) for _ in range(n)]
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id int, v double")
        got = {r.id: (r.rank, r.dec) for r in with_decile(with_rank(df, "v", "rank"), "v", "dec").collect()}
        ranks = pd.Series(vals).rank(method="min", ascending=False).astype(int)
        dec = _reference_deciles(vals)
        for i, v in enumerate(vals):
            assert got[i] == (ranks[i], dec[v]), (n, i, v)


def test_decile_monotone_and_top_is_one(spark):
    rows = [{"commit_hash": str(i), "author_name": f"n{i % 50}", "author_email": f"e{i % 50}",
             "additions": (i * 31) % 97} for i in range(400)]
    st = author_scoreboard(change_rows(spark, rows)).collect()
    assert st[0].diff_decile == 1
    decs = [r.diff_decile for r in st]
    assert decs == sorted(decs)
    assert sum(r.total for r in st) == sum((i * 31) % 97 for i in range(400))


def test_distribution_omits_empty_deciles(spark):
    rows = [{"commit_hash": str(i), "author_name": f"n{i}", "author_email": f"e{i}", "additions": 5} for i in range(3)]
    d = decile_distribution(author_scoreboard(change_rows(spark, rows)), "diff").collect()
    assert [(r.decile, r.min_value, r.max_value, r.authors) for r in d] == [(1, 5, 5, 3)]


def test_shared_email_keeps_one_row_per_author(spark):
    rows = [{"commit_hash": str(i), "author_name": f"name{i}", "author_email": "shared@x", "additions": i + 1}
            for i in range(3)]
    assert author_scoreboard(change_rows(spark, rows)).count() == 3


def test_positions_in_group_match_row_number(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from revlens.operators.ranking import positions_in_group

    rows = [("hot", f"p{i:04d}") for i in range(500)] + [("small", "b"), ("small", "a"), (None, "z"), (None, "y")]
    df = spark.createDataFrame(rows, "g string, path string").repartition(7)
    got = {(r.g, r.path): r.pos for r in positions_in_group(df, ["g"], ["path"]).collect()}
    want = {(r.g, r.path): r.rn for r in
            df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("path"))).collect()}
    assert got == want


def test_dataset_profile_exact_and_approximate(spark):
    from revlens.operators.stats import dataset_profile

    rows = [{"commit_hash": f"h{i % 7}", "author_email": f"e{i % 3}", "additions": 1} for i in range(30)]
    exact = dataset_profile(change_rows(spark, rows)).first()
    approx = dataset_profile(change_rows(spark, rows), approximate=True).first()
    assert (exact.authors, exact.commits, exact.additions, exact.rows) == (3, 7, 30, 30)
    assert (approx.authors, approx.commits) == (3, 7)


def test_positions_across_many_sort_partitions(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from revlens.operators.ranking import positions_in_group

    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 37}", i) for i in range(600)] + [(None, i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.k): r.pos for r in positions_in_group(df, ["g"], ["k"]).collect()}
        parts = df.orderBy("g", "k").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {(r.g, r.k): r.rn for r in
            df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k"))).collect()}
    assert parts > 1
    assert got == want


def test_rank_across_many_sort_partitions(spark):
    from revlens.operators.ranking import with_rank

    values = [i * i % 701 for i in range(2000)] + [5] * 500 + [None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v long").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r["rank"], r.n) for r in with_rank(df, "v", "rank", "n").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    known = sorted((v for v in values if v is not None), reverse=True)
    first = {v: k + 1 for k, v in reversed(list(enumerate(known)))}
    assert got == {i: (first[v], len(known)) if v is not None else (None, None) for i, v in enumerate(values)}


def test_dataset_profile_counts_nulls_as_before(spark):
    from revlens.operators.stats import dataset_profile

    rows = [{"commit_hash": None, "author_email": "a", "additions": 1}, {"commit_hash": "h", "author_email": None, "additions": 2},
            {"commit_hash": "h", "author_email": "a", "additions": 3}]
    r = dataset_profile(change_rows(spark, rows)).first()
    assert (r.authors, r.commits, r.additions, r.rows) == (1, 1, 6, 3)
