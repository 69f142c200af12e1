"""Analysis window (FLT-3..5, SRC-8): parameters resolved to literals before planning.

These run on the driver over a handful of parameter strings, never over data, so Catalyst
sees constant bounds and can push them into the Parquet scan.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

# The words of the period grammar, each as (days, months).
UNITS = {"day": (1, 0), "week": (7, 0), "month": (0, 1), "year": (0, 12)}
ONE = ("a", "an")

DEFAULT_PERIOD = "3 months"


@dataclass(frozen=True)
class Period:
    days: int = 0
    months: int = 0


def parse_period(text: str) -> Period:
    """``<count> <unit>`` with an optional plural and an optional ``ago``; anything else is an error."""
    words = (text or "").lower().split()
    if words[2:] == ["ago"]:
        words = words[:2]
    days, months = UNITS.get(words[1].removesuffix("s"), (0, 0)) if len(words) == 2 else (0, 0)
    if not (days or months) or not (words[0] in ONE or words[0].isdecimal()):
        raise ValueError(f"not a period: {text!r} (examples: '10 days', 'a week', '2 years ago')")
    count = 1 if words[0] in ONE else int(words[0])
    return Period(days=count * days, months=count * months)


def add_months(d: date, months: int) -> date:
    """Calendar month arithmetic clamped at month end (Spark ``add_months`` semantics)."""
    y, m = divmod(d.month - 1 + months, 12)
    year, month = d.year + y, m + 1
    return date(year, month, min(d.day, calendar.monthrange(year, month)[1]))


def minus_period(end: date, period: Period) -> date:
    return add_months(end, -period.months) - timedelta(days=period.days)


def parse_day(text: str | date | datetime) -> date:
    """The day of an ISO date or date and time; the whole text must parse."""
    if isinstance(text, datetime):
        return text.date()
    if isinstance(text, date):
        return text
    try:
        return datetime.fromisoformat(str(text).strip()).date()
    except ValueError as e:
        raise ValueError(f"not an ISO date: {text!r}") from e


def _instant(bound: str | date | datetime | None, edge: time, now: datetime | None) -> datetime | None:
    """A bound as an instant: a day means its ``edge`` in UTC, '<period> ago' counts back from ``now``."""
    if bound is None or bound == "":
        return None
    if isinstance(bound, str):
        text = bound.strip()
        if text.lower().endswith("ago"):
            clock = now or datetime.now(timezone.utc)
            clock = clock if clock.tzinfo else clock.replace(tzinfo=timezone.utc)
            return datetime.combine(minus_period(clock.date(), parse_period(text)), clock.timetz())
        try:
            bound = date.fromisoformat(text)
        except ValueError:
            try:
                bound = datetime.fromisoformat(text)
            except ValueError as e:
                raise ValueError(f"not a date or a period ago: {text!r}") from e
    if not isinstance(bound, datetime):
        return datetime.combine(bound, edge, tzinfo=timezone.utc)
    return bound if bound.tzinfo else bound.replace(tzinfo=timezone.utc)


def day_edges(since: str | None, until: str | None, now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """FLT-3: a date-only since means 00:00:00, a date-only until 23:59:59.999999 (UTC); '3 weeks ago'
    counts back from ``now`` (the clock by default)."""
    return _instant(since, time.min, now), _instant(until, time.max, now)


@dataclass(frozen=True)
class Window:
    start: date
    end: date

    @property
    def since(self) -> str:
        return self.start.isoformat()

    @property
    def until(self) -> str:
        return self.end.isoformat()


def resolve_window(start: str | date | None = None, end: str | date | None = None,
                   period: str | None = None, today: date | None = None) -> Window:
    """FLT-4 / FLT-5: end defaults to today, start to end - period (default 3 months)."""
    end_d = parse_day(end) if end else (today or datetime.now(timezone.utc).date())
    start_d = parse_day(start) if start else minus_period(end_d, parse_period(period or DEFAULT_PERIOD))
    check_window(start_d, end_d)
    return Window(start_d, end_d)


def check_window(start: date, end: date) -> None:
    """FLT-5: start after end is an error."""
    if start > end:
        raise ValueError("the window starts after its end")
