"""Row filters on flat CHANGE rows and nested COMMIT rows (FLT-*).

Every bound is a literal resolved before planning, so Catalyst pushes date and path predicates
into the Parquet scan (row-group min/max, ``StringStartsWith``). Nested filters run on the
``file_changes`` array with ``filter``/``exists`` before any explode.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.period import DEFAULT_PERIOD, day_edges, parse_period, resolve_window
from revlens.functions.scalar import message_subject, utc_date


def _ts(dt: datetime) -> Column:
    return F.lit(dt).cast("timestamp")


# ---- time -----------------------------------------------------------------------------

def since(df: DataFrame, when: str | datetime | None, col: str = "commit_date", now: datetime | None = None) -> DataFrame:
    """FLT-1 (+FLT-3): keep ``col >= since``; a date-only bound starts at 00:00:00 UTC, '6 months ago'
    counts back from ``now`` (the clock by default)."""
    lo, _ = day_edges(when, None, now)
    return df if lo is None else df.where(F.col(col) >= _ts(lo))


def until(df: DataFrame, when: str | datetime | None, col: str = "commit_date",
          until_now: bool = False, now: datetime | None = None) -> DataFrame:
    """FLT-2 (+FLT-3): keep ``col <= until``; a date-only bound ends at 23:59:59.999999 UTC, '1 day ago'
    counts back from ``now`` (the clock by default).

    ``until_now`` bounds an open end by the current time (one backend's default).
    """
    _, hi = day_edges(None, when, now)
    if hi is None:
        return df.where(F.col(col) <= F.current_timestamp()) if until_now else df
    return df.where(F.col(col) <= _ts(hi))


def date_range(df: DataFrame, since_: str | None, until_: str | None, col: str = "commit_date",
               now: datetime | None = None) -> DataFrame:
    return until(since(df, since_, col, now), until_, col, now=now)


def period_window(df: DataFrame, start=None, end=None, period: str | None = None,
                  col: str = "commit_date", today=None) -> DataFrame:
    """FLT-4: [end - period, end] with day edges; end defaults to today, period to 3 months."""
    w = resolve_window(start, end, period, today)
    return date_range(df, w.since, w.until, col)


def within_period(df: DataFrame, end_col: str, period: str | None = None, col: str = "commit_date") -> DataFrame:
    """FLT-4 with a per-row end: keep rows whose ``col`` lies in [end - period, end] (whole days,
    UTC), ``end`` read from ``end_col``. Month/year periods clamp at month end (``add_months``)."""
    p = parse_period(period or DEFAULT_PERIOD)
    end_day = utc_date(end_col) if dict(df.dtypes)[end_col] == "timestamp" else F.to_date(F.col(end_col))
    start_day = F.date_sub(F.add_months(end_day, -p.months), p.days)
    return df.where(utc_date(col).between(start_day, end_day))


def window_in_order(start: str | Column, end: str | Column) -> Column:
    """FLT-5 as a column: the window's start day is not after its end day (both in UTC)."""
    return utc_date(start) <= utc_date(end)


def check_windows(df: DataFrame, start: str, end: str) -> DataFrame:
    """FLT-5 on a table of windows: the same rows; the first one that starts after its end fails the job."""
    wrong = F.raise_error(F.format_string("window starts after its end: %s, %s", F.col(start).cast("string"), F.col(end).cast("string")))
    return df.select(*[F.when(window_in_order(start, end), F.col(c)).otherwise(wrong.cast(df.schema[c].dataType)).alias(c) if c == start else F.col(c)
                       for c in df.columns])


def stop_at_since(df: DataFrame, when: str | datetime | None, col: str = "commit_date") -> DataFrame:
    """FLT-22: a newest-first walk stopping at the first older commit = the ``since`` filter
    (pruning comes from Parquet statistics / partition pruning instead of the walk order)."""
    return since(df, when, col)


# ---- author ---------------------------------------------------------------------------

def _parts(query: str, strip: bool, lower: bool, drop_empty: bool) -> list[str]:
    parts = query.split("|")
    if strip:
        parts = [p.strip() for p in parts]
    if lower:
        parts = [p.lower() for p in parts]
    if drop_empty:
        parts = [p for p in parts if p]
    return parts


def author_predicate(query: str | None, match: str = "literal", case_sensitive: bool = False,
                     target: str = "name_or_email", any_of: bool = True,
                     drop_empty_parts: bool = False,
                     name: str = "author_name", email: str = "author_email") -> Column | None:
    """One author rule with explicit options (D3).

    match: 'literal' (substring) or 'regex' (Java regex, ``find`` semantics);
    target: 'name_or_email' (either column) or 'ident' (the text ``"Name <email>"``);
    any_of: split the query on '|' and accept any part.
    """
    if query is None:
        return None
    parts = _parts(query, strip=True, lower=(match == "literal" and not case_sensitive),
                   drop_empty=drop_empty_parts) if any_of else [query]
    if not parts:
        return F.lit(False)
    n, e = F.col(name), F.col(email)
    if target == "ident":
        fields = [F.concat(n, F.lit(" <"), e, F.lit(">"))]
    else:
        fields = [n, e]

    def one(field: Column, part: str) -> Column:
        if match == "regex":
            pat = part if case_sensitive else f"(?i){part}"
            return field.rlike(pat)
        if case_sensitive:
            return field.contains(part)
        return F.lower(field).contains(part.lower())

    terms = [F.coalesce(one(f, p), F.lit(False)) for p in parts for f in fields]
    pred = terms[0]
    for t in terms[1:]:
        pred = pred | t
    return pred


def author(df: DataFrame, query: str | None, **opts) -> DataFrame:
    pred = author_predicate(query, **opts)
    return df if pred is None else df.where(pred)


def author_literal_ci(df, query):
    """FLT-6: substring of name OR email, case-insensitive."""
    return author(df, query, match="literal", case_sensitive=False, any_of=False)


def author_literal_cs(df, query):
    """FLT-7: substring of name OR email, case-sensitive."""
    return author(df, query, match="literal", case_sensitive=True, any_of=False)


def author_any_regex(df, query):
    """FLT-8: any '|' part, as a case-sensitive regex, found in ``"Name <email>"``."""
    return author(df, query, match="regex", case_sensitive=True, target="ident", drop_empty_parts=True)


def author_mask(df, query):
    """FLT-9: any '|' part, case-insensitive regex, on name or email; an empty part matches all."""
    return author(df, query, match="regex", case_sensitive=False)


def author_stats_match(stats, query, ignore_empty_parts: bool = False):
    """FLT-10: any '|' part, literal, lower-cased, stripped; None -> every row."""
    return author(stats, query, match="literal", case_sensitive=False, drop_empty_parts=ignore_empty_parts)


def current_user(me: tuple[str, str] | None, author_query: str | None) -> str | None:
    """FLT-11: ``me=(name, email)`` becomes the query ``name|email``; both given -> error."""
    if me is not None and author_query is not None:
        raise ValueError("Cannot use both an author query and the current user")
    if me is not None:
        return f"{me[0]}|{me[1]}"
    return author_query


# ---- message --------------------------------------------------------------------------

def grep(df: DataFrame, pattern: str | None, mode: str = "regex", scope: str = "message",
         case_sensitive: bool = True, col: str = "commit_message") -> DataFrame:
    """FLT-12..14 (D5): regex on any message line, literal on the message, or literal on the subject."""
    if pattern is None:
        return df
    text = message_subject(col) if scope == "subject" else F.col(col)
    if mode == "regex":
        pat = ("" if case_sensitive else "(?i)") + "(?m)" + pattern
        return df.where(text.rlike(pat))
    if case_sensitive:
        return df.where(text.contains(pattern))
    return df.where(F.lower(text).contains(pattern.lower()))


def grep_regex(df, pattern):
    """FLT-12."""
    return grep(df, pattern, "regex", "message")


def grep_literal(df, pattern):
    """FLT-13."""
    return grep(df, pattern, "literal", "message")


def grep_subject(df, pattern):
    """FLT-14: case-insensitive literal on the first line."""
    return grep(df, pattern, "literal", "subject", case_sensitive=False)


# ---- merges and paths -----------------------------------------------------------------

def merges_only(df: DataFrame, enabled: bool = True, col: str = "parent_hashes") -> DataFrame:
    """FLT-15: more than one parent."""
    return df.where(F.size(col) > 1) if enabled else df


def _prefix_any(path: Column, prefixes: Sequence[str]) -> Column:
    pred = None
    for p in prefixes:
        t = path.startswith(p)
        pred = t if pred is None else (pred | t)
    return pred


def path_predicate(path: Column, include: Sequence[str] | None, exclude: Sequence[str] | None) -> Column | None:
    """FLT-16/17: include = any prefix; exclude = no prefix; include applied first.

    Written as a plain OR of ``startsWith`` (null path -> null -> dropped) so Parquet receives
    ``StringStartsWith`` filters.
    """
    pred = None
    if include:
        pred = _prefix_any(path, include)
    if exclude:
        ex = path.isNotNull() & ~_prefix_any(path, exclude)
        pred = ex if pred is None else (pred & ex)
    return pred


def paths(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
          col: str = "file_paths") -> DataFrame:
    """FLT-16..18 on flat rows: a row survives only if its path passes. Commits whose changes all
    fail (and commits without changes) disappear, which is FLT-18 on the flat form."""
    pred = path_predicate(F.col(col), include, exclude)
    return df if pred is None else df.where(pred)


def paths_nested(commits: DataFrame, include: Sequence[str] | None = None,
                 exclude: Sequence[str] | None = None, drop_emptied: bool = True) -> DataFrame:
    """FLT-16..18 on nested rows: filter the change array, then drop commits left empty."""
    if not include and not exclude:
        return commits
    out = commits.withColumn(
        "file_changes", F.filter("file_changes", lambda fc: path_predicate(fc["file_path"], include, exclude))
    )
    return drop_emptied_commits(out) if drop_emptied else out


def drop_emptied_commits(commits: DataFrame) -> DataFrame:
    """FLT-18: with path filters on, commits without remaining changes are dropped."""
    return commits.where(F.size("file_changes") > 0)


def where(df: DataFrame, condition: str | Column | None) -> DataFrame:
    """FLT-21: pass-through predicate (SQL text or Column)."""
    if condition is None:
        return df
    return df.where(F.expr(condition) if isinstance(condition, str) else condition)
