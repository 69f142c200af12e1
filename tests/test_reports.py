"""Report frames and scalar display helpers."""

from pyspark.sql import functions as F

from helpers import change_rows
from revlens.functions import scalar as X
from revlens.operators import reports as R
from revlens.operators.stats import author_scoreboard


def _stats(spark):
    rows = [{"commit_hash": f"h{i}", "author_name": n, "author_email": e, "additions": a, "deletions": d}
            for i, (n, e, a, d) in enumerate([("Alice", "alice@x", 10, 0), ("Bob", "bob@y", 3, 4),
                                              ("A very long author name indeed", "someone.with.long.mail@example.com", 1, 0)])]
    return author_scoreboard(change_rows(spark, rows), ordered=False)


def test_scoreboard_report_labels(spark):
    rep = {r.rank: r for r in R.scoreboard_report(_stats(spark)).collect()}
    assert rep[1].author == "Alice <alice@x>" and rep[1].lines_deleted == "-"
    assert len(rep[3].author) == 45 and rep[3].author.endswith("...")


def test_author_report_percentile_and_avg(spark):
    (r,) = R.author_report(_stats(spark), "bob").collect()
    assert (r.rank_label, r.percentile, r.avg_diff_per_commit) == ("#2 of 1", "Top 100.0%", "7 lines")


def test_pivot_has_ten_metrics_in_order(spark):
    rows = R.author_pivot(_stats(spark), "alice").orderBy("ordinal").collect()
    assert [r.metric for r in rows] == R.PIVOT_METRICS
    assert rows[1].value == "#1 of 1"


def test_distribution_range_label(spark):
    d = R.decile_distribution_report(_stats(spark), "diff").collect()
    assert [r.range for r in d][0] == "10"


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(" Jane Doe <jane@x>", "a--b\nbody", "add", 1234567, 1234567, 0.25)],
                               "ident string, msg string, kind string, lo long, hi long, x double")
    name, email = X.split_author("ident")
    r = df.select(name.alias("n"), email.alias("e"), X.message_subject("msg").alias("s"),
                  X.change_type_code("kind").alias("k"), X.range_label("lo", F.col("hi") + 1).alias("rl"),
                  X.fmt_fixed("x", 1).alias("f"), X.hash_text(F.lit("ab")).alias("h")).first()
    assert (r.n, r.e, r.s, r.k) == ("Jane Doe", "jane@x", "a b", "A")
    assert r.rl == "1,234,567-1,234,568" and r.f == "0.2" and r.h == "6162"


def test_pivot_every_author_without_query(spark):
    rows = R.author_pivot(_stats(spark)).collect()
    assert len(rows) == 30
    ranks = sorted(r.value for r in rows if r.metric == "Rank")
    assert ranks == ["#1 of 3", "#2 of 3", "#3 of 3"]


def test_strip_and_split_match_python_whitespace(spark):
    from revlens.functions.scalar import parse_parents, strip_ws

    samples = ["  a b  ", "\t\x1c x \x85", "\xa0y　", " z ", "a\x1fb", "", "   "]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    rows = df.select("t", strip_ws("t").alias("s"), parse_parents("t").alias("p")).collect()
    for r in rows:
        assert r.s == r.t.strip(), repr(r.t)
        assert list(r.p) == r.t.split(), repr(r.t)


def test_repair_hash_undoes_doubled_hex(spark):
    h = "0123456789abcdef0123456789abcdef01234567"
    df = spark.createDataFrame([(h,)], "h string")
    r = df.select(X.hash_text("h").alias("d"), X.repair_hash(X.hash_text("h")).alias("back"),
                  X.repair_hash("h").alias("same")).first()
    assert len(r.d) == 80 and r.back == h and r.same == h
