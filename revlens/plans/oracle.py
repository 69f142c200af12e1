"""Oracle SQL (DuckDB dialect) shared pieces: the test-data mapping as CTEs.

Every oracle query is ``MAPPING + <its own CTEs and SELECT>``. The mapping repeats
``revlens.sources.testdata`` relationally; it is independent code, written in SQL.
"""

from __future__ import annotations

MAPPING = """
WITH o AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
         CASE WHEN o_orderstatus = 'P' OR o_orderkey = 0 THEN NULL ELSE o_orderkey // 2 END AS p1,
         CASE WHEN o_orderstatus = 'P' OR o_orderkey = 0 OR o_orderpriority <> '1-URGENT'
                   OR o_orderkey // 3 = o_orderkey // 2 THEN NULL ELSE o_orderkey // 3 END AS p2
  FROM orders
),
commits AS (
  SELECT o_orderkey AS ok,
         CAST(o_orderkey AS VARCHAR) AS commit_hash,
         concat_ws(' ', CAST(p1 AS VARCHAR), CAST(p2 AS VARCHAR)) AS parents,
         CAST(p1 AS VARCHAR) AS first_parent,
         (CASE WHEN p1 IS NULL THEN 0 ELSE 1 END + CASE WHEN p2 IS NULL THEN 0 ELSE 1 END) AS n_parents,
         c_name AS author_name,
         lower(c_mktsegment) || '.' || lower(replace(c_name, '#', '.')) || '@example.com' AS author_email,
         lower(c_mktsegment) || '.' || CAST(c_nationkey AS VARCHAR) || '@example.com' AS shared_email,
         o_orderdate AS commit_date,
         CAST(epoch(o_orderdate) AS BIGINT) AS commit_timestamp,
         o_orderpriority || ' ' || o_orderstatus || chr(10) || 'order ' || CAST(o_orderkey AS VARCHAR)
           AS commit_message
  FROM o JOIN customer ON c_custkey = o_custkey
),
files AS (
  SELECT l_orderkey AS ok,
         lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '/' || replace(p_name, ' ', '_') || '.txt'
           AS file_path,
         CAST(l_quantity AS BIGINT) AS additions,
         CAST(l_linenumber AS BIGINT) AS deletions,
         CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' WHEN 'R' THEN 'D' END AS change_type
  FROM lineitem JOIN part ON p_partkey = l_partkey
),
changes AS (
  SELECT c.ok, c.commit_hash, c.parents, c.n_parents, c.author_name, c.author_email, c.shared_email,
         c.commit_date, c.commit_timestamp, c.commit_message,
         f.file_path AS file_paths, f.change_type,
         coalesce(f.additions, 0) AS additions, coalesce(f.deletions, 0) AS deletions,
         CAST(NULL AS VARCHAR) AS old_file_path
  FROM commits c LEFT JOIN files f ON f.ok = c.ok
),
files_pos AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS commit_hash,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos,
         lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '/' || replace(p_name, ' ', '_') || '.txt'
           AS file_path,
         CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions,
         CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' WHEN 'R' THEN 'D' END AS change_type
  FROM lineitem JOIN part ON p_partkey = l_partkey
),
event_changes AS (
  SELECT CAST(event_id AS VARCHAR) AS commit_hash,
         'user' || CAST(user_id AS VARCHAR) AS author_name,
         'user' || CAST(user_id AS VARCHAR) || '@events.example.com' AS author_email,
         ts AS commit_date, event_type AS commit_message,
         CAST(round(value * 100) AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions
  FROM events
)
"""


def with_mapping(body: str) -> str:
    """Prefix the mapping. ``body`` may start with ``, name AS (...)`` to add CTEs."""
    body = body.strip()
    if body.startswith(","):
        return MAPPING.rstrip() + body + "\n"
    return MAPPING + body + "\n"


# Scoreboard core over a CTE named `src` with (author_email, author_name, commit_hash,
# additions, deletions). Written with a distinct aggregate and global RANK on purpose:
# an independent formulation of the Spark plan.
SCOREBOARD_FROM_SRC = """
, totals AS (
  SELECT author_email, author_name,
         CAST(coalesce(sum(additions), 0) AS BIGINT) AS added,
         CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deleted,
         CAST(count(DISTINCT commit_hash) AS BIGINT) AS commits
  FROM src WHERE author_email IS NOT NULL AND author_name IS NOT NULL
  GROUP BY author_email, author_name
),
ranked AS (
  SELECT *, added + deleted AS total,
         rank() OVER (ORDER BY added + deleted DESC) AS rk,
         rank() OVER (ORDER BY commits DESC) AS crk,
         count(*) OVER () AS n
  FROM totals
),
stats AS (
  SELECT author_email, author_name, added, deleted, commits, CAST(total AS BIGINT) AS total,
         CAST(rk AS BIGINT) AS rank,
         CAST(CASE WHEN rk = 1 THEN 1 ELSE least(10, (rk * 10 + n - 1) // n) END AS INTEGER) AS diff_decile,
         CAST(CASE WHEN crk = 1 THEN 1 ELSE least(10, (crk * 10 + n - 1) // n) END AS INTEGER) AS commit_decile
  FROM ranked
)
"""
