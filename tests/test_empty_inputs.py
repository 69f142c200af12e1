"""Every operator accepts empty input and returns an empty (typed) result."""

import pytest

from helpers import change_rows, commit_rows
from revlens.operators import diff as D
from revlens.operators import filters as FL
from revlens.operators import graph as G
from revlens.operators import reports as R
from revlens.operators import reshape as RS
from revlens.operators import stats as S
from revlens.sources import logtext as LT


def _empty_changes(spark):
    return change_rows(spark, [])


def _empty_commits(spark):
    return commit_rows(spark, [])


CASES = {
    "since": lambda sp: FL.since(_empty_changes(sp), "2020-01-01"),
    "author_mask": lambda sp: FL.author_mask(_empty_changes(sp), "x|y"),
    "grep": lambda sp: FL.grep_regex(_empty_changes(sp), "^a"),
    "paths": lambda sp: FL.paths(_empty_changes(sp), include=["a/"], exclude=["a/b"]),
    "paths_nested": lambda sp: FL.paths_nested(_empty_commits(sp), include=["a/"]),
    "explode": lambda sp: RS.explode_changes(_empty_commits(sp)),
    "assemble": lambda sp: RS.assemble_commits(_empty_changes(sp)),
    "totals": lambda sp: S.author_totals(_empty_changes(sp)),
    "scoreboard": lambda sp: S.author_scoreboard(_empty_changes(sp)),
    "distribution": lambda sp: S.decile_distribution(S.author_scoreboard(_empty_changes(sp)), "commit"),
    "monthly": lambda sp: S.commits_per_month(_empty_changes(sp)),
    "top_files": lambda sp: S.top_files_by_deletions(_empty_changes(sp)),
    "report": lambda sp: R.scoreboard_report(S.author_scoreboard(_empty_changes(sp))),
    "author_report": lambda sp: R.author_report(S.author_scoreboard(_empty_changes(sp)), "a"),
    "pivot": lambda sp: R.author_pivot(S.author_scoreboard(_empty_changes(sp))),
    "first_parent": lambda sp: G.first_parent(_empty_commits(sp)),
    "all_refs": lambda sp: G.all_refs_commits(_empty_commits(sp)),
    "reachable": lambda sp: G.reachable_from(_empty_commits(sp), sp.createDataFrame([], "commit_hash string")),
    "log_parse": lambda sp: LT.log_parse(sp.createDataFrame([], "value string")),
    "numstat": lambda sp: LT.numstat_parse(sp.createDataFrame([], "value string")),
    "name_status": lambda sp: LT.name_status_parse(sp.createDataFrame([], "value string")),
    "patch": lambda sp: LT.patch_line_stats(sp.createDataFrame([], "commit_hash string, patch string")),
    "snapshot_diff": lambda sp: D.snapshot_diff(*[sp.createDataFrame([], "commit_hash string, path string, content string")] * 2),
    "change_set_diff": lambda sp: D.change_set_diff(_empty_commits(sp), _empty_commits(sp)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_empty(spark, name):
    assert CASES[name](spark).count() == 0


def test_dataset_profile_on_empty_is_one_zero_row(spark):
    (r,) = S.dataset_profile(_empty_changes(spark)).collect()
    assert (r.authors, r.commits, r.additions, r.deletions, r.rows) == (0, 0, 0, 0, 0)


def test_one_row_per_author(spark):
    rows = [{"commit_hash": f"h{i}", "author_name": f"n{i % 4}", "author_email": f"e{i % 2}", "additions": i}
            for i in range(40)]
    st = S.author_scoreboard(change_rows(spark, rows)).collect()
    keys = [(r.author_email, r.author_name) for r in st]
    assert len(keys) == len(set(keys)) == 4
    assert sum(r.added for r in st) == sum(range(40))
