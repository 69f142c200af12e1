"""Adapter: the driver's TPC-H-like tables read as a change history.

orders -> commits, customers -> authors, line items -> file changes. The mapping is plain
DataFrame code; the oracle SQL in ``revlens.plans.catalog`` repeats it as a CTE.

    commit_hash      cast(o_orderkey as string)
    parent_hashes    [o_orderkey div 2]; '1-URGENT' orders also get o_orderkey div 3 (merges);
                     'P' orders and order 0 are roots. Row-local (no window), heap-shaped:
                     depth O(log n), and no author's history is ever sorted in one task
    author_name      c_name
    author_email     lower(c_mktsegment) . lower(c_name with '#' -> '.') @example.com
                     (email_mode='shared': lower(c_mktsegment) . c_nationkey @example.com)
    commit_date      o_orderdate (UTC)         commit_timestamp  epoch seconds of it
    commit_message   o_orderpriority ' ' o_orderstatus '\n' 'order ' o_orderkey
    file_paths       lower(p_type) / lower(p_brand) without '#' / p_name with '_' .txt
    additions        l_quantity      deletions   l_linenumber
    change_type      l_returnflag A -> A, N -> M, R -> D
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.schema import CHANGE_COLUMNS, COMMIT_COLUMNS
from revlens.session import pin_utc, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _email(mode: str) -> Column:
    seg = F.lower(F.col("c_mktsegment"))
    if mode == "shared":
        return F.concat(seg, F.lit("."), F.col("c_nationkey").cast("string"), F.lit("@example.com"))
    return F.concat(seg, F.lit("."), F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with their customers as stored, and their parents."""
    pin_utc(spark)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    k = F.col("o_orderkey")
    root = (F.col("o_orderstatus") == F.lit("P")) | (k == 0)
    urgent = F.col("o_orderpriority") == F.lit("1-URGENT")
    both = F.array(F.floor(k / 2).cast("string"), F.when(urgent, F.floor(k / 3).cast("string")))
    parents = F.when(root, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.filter(both, lambda x: x.isNotNull())))
    return orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).withColumn("parent_hashes", parents)


def _head_columns(email_mode: str) -> dict[str, Column]:
    """The columns of a commit but its parents, out of an order and its customer."""
    date = F.col("o_orderdate").cast("timestamp")
    return {
        "commit_hash": F.col("o_orderkey").cast("string"),
        "author_name": F.col("c_name"),
        "author_email": _email(email_mode),
        "commit_date": date,
        "commit_timestamp": F.unix_timestamp(date),
        "commit_message": F.concat(
            F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus"), F.lit("\n"),
            F.lit("order "), F.col("o_orderkey").cast("string"),
        ),
    }


def commit_heads(spark: SparkSession, sf_dir: str, email_mode: str = "segment") -> DataFrame:
    """One row per commit (no file changes) plus the integer key ``_ok`` for joins."""
    orders = _orders(spark, sf_dir).withColumns(_head_columns(email_mode))
    return orders.select(F.col("o_orderkey").alias("_ok"), *COMMIT_COLUMNS[:7])


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item as a file change, keyed by ``_ok`` (the order key)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    path = F.concat(
        F.lower(F.col("p_type")), F.lit("/"),
        F.replace(F.lower(F.col("p_brand")), F.lit("#"), F.lit("")), F.lit("/"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".txt"),
    )
    ctype = (
        F.when(F.col("l_returnflag") == "A", "A")
        .when(F.col("l_returnflag") == "N", "M")
        .when(F.col("l_returnflag") == "R", "D")
    )
    return li.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").alias("_ok"),
        path.alias("file_path"),
        F.col("l_quantity").cast("bigint").alias("additions"),
        F.col("l_linenumber").cast("bigint").alias("deletions"),
        ctype.alias("change_type"),
        F.lit(None).cast("string").alias("old_file_path"),
    )


def changes(spark: SparkSession, sf_dir: str, email_mode: str = "segment") -> DataFrame:
    """Flat CHANGE frame: commits with their file rows; a commit without files -> null path, 0/0. One left
    join, so every table is scanned once. It is joined on the commit's hash, by which rows are grouped later, so
    they are not shuffled again for that; the other commit columns are made behind the join."""
    zero = F.lit(0).cast("bigint")
    columns = _head_columns(email_mode)
    orders = _orders(spark, sf_dir).withColumn("commit_hash", columns.pop("commit_hash"))
    files = file_rows(spark, sf_dir).withColumn("commit_hash", F.col("_ok").cast("string")).drop("_ok")
    return orders.join(files, "commit_hash", "left").withColumns(columns).select(
        *COMMIT_COLUMNS[:7],
        F.col("file_path").alias("file_paths"),
        "change_type",
        F.coalesce("additions", zero).alias("additions"),
        F.coalesce("deletions", zero).alias("deletions"),
        "old_file_path",
    ).select(*CHANGE_COLUMNS)


def commits(spark: SparkSession, sf_dir: str, email_mode: str = "segment") -> DataFrame:
    """Nested COMMIT frame: the flat changes assembled per commit (AGG-5)."""
    from revlens.operators.reshape import assemble_commits

    return assemble_commits(changes(spark, sf_dir, email_mode))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second change set from ``events``: user -> author, event -> commit, value in cents -> additions."""
    pin_utc(spark)
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    date = F.col("ts").cast("timestamp")
    return ev.select(
        F.col("event_id").cast("string").alias("commit_hash"),
        F.array().cast("array<string>").alias("parent_hashes"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author_name"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@events.example.com")).alias("author_email"),
        date.alias("commit_date"),
        F.unix_timestamp(date).alias("commit_timestamp"),
        F.col("event_type").alias("commit_message"),
        F.concat(F.col("event_type"), F.lit(".log")).alias("file_paths"),
        F.lit("M").alias("change_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("additions"),
        F.lit(0).cast("bigint").alias("deletions"),
        F.lit(None).cast("string").alias("old_file_path"),
    )


# Fixed order of line items inside one order: every line item column, so "last" is defined.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def file_rows_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_rows`` plus ``commit_hash`` and ``pos``: the line's place inside its commit, a struct of
    every line item column (row-local and totally ordered; no per-order window)."""
    li = spread(table(spark, sf_dir, "lineitem"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    path = F.concat(
        F.lower(F.col("p_type")), F.lit("/"),
        F.replace(F.lower(F.col("p_brand")), F.lit("#"), F.lit("")), F.lit("/"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".txt"),
    )
    ctype = (
        F.when(F.col("l_returnflag") == "A", "A")
        .when(F.col("l_returnflag") == "N", "M")
        .when(F.col("l_returnflag") == "R", "D")
    )
    return li.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").cast("string").alias("commit_hash"),
        F.struct(*LINE_ORDER).alias("pos"),
        path.alias("file_path"),
        F.col("l_quantity").cast("bigint").alias("additions"),
        F.col("l_linenumber").cast("bigint").alias("deletions"),
        ctype.alias("change_type"),
    )
