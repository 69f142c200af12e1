"""Property: render -> parse is the identity on commits the text format can represent."""

from datetime import datetime, timezone

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import commit_rows
from revlens.sources import logtext as LT

# the dump format cannot carry its own markers, tabs/newlines in fields, or surrounding spaces
_text = st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc", "Zl", "Zp", "Zs")), min_size=1, max_size=12)
_word = st.text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789._-/", min_size=1, max_size=12)
_path = st.builds(lambda a, b: f"{a} {b}", _word, _word) | _word
_change = st.tuples(_path, st.integers(0, 10**6), st.integers(0, 10**6), st.sampled_from(["A", "M", "D", "R100", ""]))
_commit = st.fixed_dictionaries({
    "name": _text,
    "email": _word,
    "msg_lines": st.lists(_text, min_size=1, max_size=3),
    "ts": st.integers(0, 2 * 10**9),
    "changes": st.lists(_change, max_size=4),
    "n_parents": st.integers(0, 2),
})


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_commit, min_size=1, max_size=15))
def test_render_parse_identity(spark, scratch, commits):
    rows = []
    for i, c in enumerate(commits):
        ts = datetime.fromtimestamp(c["ts"], tz=timezone.utc)
        rows.append({
            "commit_hash": f"h{i:04d}", "parent_hashes": [f"h{j:04d}" for j in range(max(0, i - c["n_parents"]), i)],
            "author_name": c["name"], "author_email": c["email"], "commit_date": ts, "commit_timestamp": c["ts"],
            "commit_message": "\n".join(c["msg_lines"]),
            "file_changes": [(p, a, d, t, None) for p, a, d, t in c["changes"]],
        })
    df = commit_rows(spark, rows)
    path = scratch("prop")
    LT.write_log(df, path)
    back = {r.commit_hash: r for r in LT.read_log(spark, path).collect()}
    assert set(back) == {r["commit_hash"] for r in rows}
    for r in rows:
        b = back[r["commit_hash"]]
        assert (b.author_name, b.author_email, b.commit_timestamp) == (r["author_name"], r["author_email"], r["commit_timestamp"])
        assert list(b.parent_hashes) == r["parent_hashes"]
        assert b.commit_message == r["commit_message"].strip()
        assert b.commit_date.timestamp() == r["commit_date"].timestamp()  # same instant
        got = [(f.file_path, f.additions, f.deletions, f.change_type) for f in b.file_changes]
        assert got == [(p, a, d, t) for p, a, d, t, _ in r["file_changes"]]
