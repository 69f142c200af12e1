"""Column-level functions (PRJ-*). All built from ``pyspark.sql.functions``: no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The characters Python's str.strip()/str.split() treat as whitespace.
PY_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# The same characters, one by one.
_WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(x) -> Column:
    """Python ``str.strip()``: trims every whitespace character, not only spaces.

    Only text that begins or ends with one is trimmed, by characters: a regular expression would try every place of it."""
    t, ws = _c(x), F.lit(_WS_CHARS)
    edge = F.contains(ws, F.substring(t, 1, 1)) | F.contains(ws, F.substring(t, -1, 1))
    return F.when(edge, F.btrim(t, ws)).otherwise(t)


def split_author(ident) -> tuple[Column, Column]:
    """PRJ-1: ``"Name <mail>"`` -> (trimmed name, email without the angle brackets)."""
    parts = F.split(_c(ident), "<", 2)
    name = strip_ws(F.get(parts, 0))
    email = F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"^>+|>+$", "")
    return name, email


def epoch_to_utc(epoch) -> Column:
    """PRJ-2: epoch seconds -> timestamp (session zone pinned to UTC)."""
    return F.timestamp_seconds(_c(epoch))


def message_subject(msg) -> Column:
    """PRJ-3: first line of the message, ``--`` replaced by a space."""
    return F.replace(F.substring_index(_c(msg), "\n", 1), F.lit("--"), F.lit(" "))


def change_type_code(kind) -> Column:
    """PRJ-4: add / delete / modify -> A / D / M, anything else -> U."""
    k = _c(kind)
    return F.when(k == "add", "A").when(k == "delete", "D").when(k == "modify", "M").otherwise("U")


def root_change_flip(parents, change_type, additions, deletions) -> tuple[Column, Column]:
    """PRJ-5: on a parentless commit a ``D`` is really an add: additions := deletions, deletions := 0."""
    flip = (F.size(_c(parents)) == 0) & (_c(change_type) == "D")
    return (
        F.when(flip, _c(deletions)).otherwise(_c(additions)),
        F.when(flip, F.lit(0).cast("bigint")).otherwise(_c(deletions)),
    )


def change_path(change_type, new_path, old_path) -> tuple[Column, Column]:
    """PRJ-6: path = new path (old path for deletes); old path kept only for renames."""
    t = _c(change_type)
    path = F.when(t == "D", F.coalesce(_c(old_path), _c(new_path))).otherwise(F.coalesce(_c(new_path), _c(old_path)))
    old = F.when(t == "R", _c(old_path))
    return path, old


def hash_text(ident) -> Column:
    """PRJ-7: hex of the UTF-8 text (an already-hex id doubles to 80 characters)."""
    return F.lower(F.hex(F.encode(_c(ident), "UTF-8")))


def repair_hash(h) -> Column:
    """Undo PRJ-7 on 80-character doubled ids; other values pass through."""
    x = _c(h)
    return F.when(F.length(x) == 80, F.decode(F.unhex(x), "UTF-8")).otherwise(x)


def parse_parents(text) -> Column:
    """PRJ-8: whitespace separated hashes -> array; empty -> []."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), f"{PY_WS}+"), lambda z: z != "")


MSG_START = "---MSG_START---"
MSG_END = "---MSG_END---"


def parse_message(raw, empty_fallback: bool = False) -> Column:
    """PRJ-9: text between the first start marker and the next end marker, stripped.

    Without a start marker the raw part is used. An empty marked message becomes '' unless
    ``empty_fallback`` (the reference's behaviour: fall back to the raw part).
    """
    r = _c(raw)
    after_first = F.substr(r, F.instr(r, MSG_START) + F.lit(len(MSG_START)))
    inner = F.substring_index(after_first, MSG_END, 1)
    msg = F.when(F.instr(r, MSG_START) > 0, inner).otherwise(r)
    if empty_fallback:
        msg = F.when(msg == "", r).otherwise(msg)
    return strip_ws(msg)


def parse_iso_date(text) -> Column:
    """PRJ-10: ISO-8601 with offset (``Z`` accepted) -> timestamp; unparsable -> null."""
    return F.try_to_timestamp(_c(text))


# The line terminators of Python's str.splitlines().
_SPLITLINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_OTHER_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"  # few texts hold one; the others are split at one character
_TERMINATOR_AT_END = r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])$"


def count_text_lines(text) -> Column:
    """PRJ-11: ``len(text.splitlines())``; '' -> 0; missing -> 0."""
    t = _c(text)
    by_feed = F.size(F.split(t, "\n")) - F.when(t.endswith("\n"), 1).otherwise(0)
    by_any = F.size(F.split(t, _SPLITLINES)) - F.when(t.rlike(_TERMINATOR_AT_END), 1).otherwise(0)
    n = F.when(t.rlike(_OTHER_BREAK), by_any).otherwise(by_feed)
    return F.coalesce(F.when(t == "", F.lit(0)).otherwise(n), F.lit(0)).cast("bigint")


def total_diff(added, deleted) -> Column:
    """PRJ-12."""
    return (_c(added) + _c(deleted)).cast("bigint")


def percentile(rank, n_authors) -> Column:
    """PRJ-13: (rank - 1) / n * 100."""
    return (_c(rank) - 1) / _c(n_authors) * 100.0


def avg_diff_per_commit(total, commits) -> Column:
    """PRJ-14: total / commits, 0 without commits."""
    return F.when(_c(commits) > 0, _c(total) / _c(commits)).otherwise(F.lit(0.0))


def author_label(name, email, width: int | None = 45) -> Column:
    """PRJ-15: ``"name <email>"``; longer than ``width`` -> first width-3 chars + '...'."""
    label = F.concat(_c(name), F.lit(" <"), _c(email), F.lit(">"))
    if width is None:
        return label
    return F.when(F.length(label) > width, F.concat(F.substring(label, 1, width - 3), F.lit("..."))).otherwise(label)


def dash_if_zero(x) -> Column:
    """PRJ-16: count as text, '-' when not > 0."""
    return F.when(_c(x) > 0, _c(x).cast("string")).otherwise(F.lit("-"))


def range_label(lo, hi) -> Column:
    """PRJ-17: 'min-max' with thousands separators, a single value when equal."""
    a = F.format_number(_c(lo), 0)
    b = F.format_number(_c(hi), 0)
    return F.when(_c(lo) == _c(hi), a).otherwise(F.concat(a, F.lit("-"), b))


def utc_date(ts) -> Column:
    """Day of an instant in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(_c(ts)) / 86400).cast("int"))


def month_bucket(ts) -> Column:
    """PRJ-21: ``strftime(ts, '%Y-%m')`` of an instant in UTC."""
    return F.date_format(utc_date(ts), "yyyy-MM")


def fmt_fixed(x, digits: int) -> Column:
    """Python ``f'{x:.{digits}f}'`` (half-even on the value) without thousands separators."""
    return F.format_string(f"%.{digits}f", F.bround(_c(x).cast("double"), digits))
