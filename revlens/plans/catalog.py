"""Registered queries: one per operator of the inventory, each with its DuckDB oracle.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame whose columns are aliased to the
oracle's names. Timestamps are returned as TIMESTAMP_NTZ and lists as space-joined text so
both engines render the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.oracle import SCOREBOARD_FROM_SRC, with_mapping
from revlens.schema import CHANGE_COLUMNS
from revlens.sources import testdata as td

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def ntz(col: str) -> F.Column:
    return F.col(col).cast("timestamp_ntz").alias(col)


def parents_text(col: str = "parent_hashes", alias: str = "parents") -> F.Column:
    return F.array_join(F.col(col), " ").alias(alias)


#: The public columns in oracle-comparable form: parents as text, times without a zone.
CHANGE_SELECT = "SELECT " + ", ".join("parents" if c == "parent_hashes" else c for c in CHANGE_COLUMNS) + " FROM changes"


def change_out(df: DataFrame) -> DataFrame:
    """Flat CHANGE rows in oracle-comparable form."""
    rendered = {"parent_hashes": parents_text(), "commit_date": ntz("commit_date")}
    return df.select(*[rendered.get(c, c) for c in CHANGE_COLUMNS])


# Import the query modules for their registrations.
from revlens.plans import queries_core  # noqa: E402,F401
from revlens.plans import queries_filters  # noqa: E402,F401
from revlens.plans import queries_projections  # noqa: E402,F401
from revlens.plans import queries_io  # noqa: E402,F401
from revlens.plans import queries_graph  # noqa: E402,F401
from revlens.plans import queries_flows  # noqa: E402,F401


def queries() -> dict[str, QueryFn]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["queries", "oracle_sql", "register", "ntz", "parents_text", "with_mapping",
           "SCOREBOARD_FROM_SRC", "td", "change_out", "CHANGE_SELECT"]
