"""Global order without one task: RANK, deciles and positions inside groups.

``RANK() OVER (ORDER BY v DESC)`` in Spark runs in one task, and a window partitioned by a key puts a
hot key into one task. Here rows are sorted by range partitioning instead (any run of equal or similar
values is spread over as many sort partitions as its size needs), each row remembers its partition and
place, and what a row needs from before its own partition comes from a table with one row per sort
partition: that table is as small as the number of partitions, and the only thing broadcast.

Ranks collapse ties first (``groupBy(v).count()``, combined map-side), so a value shared by a third of
all rows is one row; the rank goes back to the rows by a plain join on the value, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialize

_BEFORE = (Window.unboundedPreceding, -1)


def in_order(df: DataFrame, *order) -> DataFrame:
    """``df`` sorted globally, once, with ``_part`` (sort partition) and ``_idx`` (place in it)."""
    placed = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    return placed.select("*", F.shiftrightunsigned("_mid", 33).alias("_part"),
                         F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_idx")).drop("_mid")


def _sum_before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*_BEFORE)), F.lit(0))


def multi_value_ranks(df: DataFrame, cols: list[str], descending: bool = True) -> DataFrame:
    """Min-ranks of the distinct values of several columns of one type: rows ``(_kind, _v, _rank, _n)``,
    ``_kind`` being the column's index and ``_n`` the number of ranked rows. The columns are stacked as
    (index, value) pairs, so one count, one sort and one pass of prefix sums serve all of them."""
    pairs = F.array(*[F.struct(F.lit(i).alias("_kind"), F.col(c).alias("_v")) for i, c in enumerate(cols)])
    counts = df.select(F.inline(pairs)).where(F.col("_v").isNotNull()).groupBy("_kind", "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    placed = in_order(counts, "_kind", F.col("_v").desc() if descending else F.col("_v").asc())
    per_part = placed.groupBy("_part", "_kind").agg(F.sum("_cnt").alias("_c"))
    by_kind = Window.partitionBy("_kind")  # a row per sort partition
    offsets = per_part.select("_part", "_kind", _sum_before("_c", by_kind.orderBy("_part")).alias("_off"), F.sum("_c").over(by_kind).alias("_n"))
    inside = placed.select("*", _sum_before("_cnt", Window.partitionBy("_part", "_kind").orderBy("_idx")).alias("_in"))
    return inside.join(F.broadcast(offsets), ["_part", "_kind"]).select(
        "_kind", "_v", (F.col("_off") + F.col("_in") + 1).cast("bigint").alias("_rank"), F.col("_n").cast("bigint").alias("_n"))


def with_rank(df: DataFrame, value_col: str, rank_col: str = "rank",
              count_col: str | None = None, descending: bool = True) -> DataFrame:
    """Attach the global min-rank of ``value_col`` (and optionally the row count) to every row."""
    ranks = multi_value_ranks(df, [value_col], descending).select(
        F.col("_v").alias(value_col), F.col("_rank").alias(rank_col), *([F.col("_n").alias(count_col)] if count_col else []))
    return df.join(ranks, value_col, "left")


def decile_of(rank: Column, n: Column) -> Column:
    """Leading tie group -> 1; later groups -> min(10, ceil(rank * 10 / n)), integral arithmetic."""
    r = rank.cast("bigint")
    nn = n.cast("bigint")
    later = F.least(F.lit(10).cast("bigint"), F.floor((r * 10 + nn - 1) / nn).cast("bigint"))
    return F.when(r == 1, F.lit(1)).otherwise(later).cast("int")


def with_decile(df: DataFrame, value_col: str, decile_col: str) -> DataFrame:
    """Decile of ``value_col`` (descending, tie-aware); NOT ``ntile``, which splits ties."""
    rk, n = f"_rk_{decile_col}", f"_n_{decile_col}"
    ranked = with_rank(df, value_col, rk, n)
    return ranked.withColumn(decile_col, decile_of(F.col(rk), F.col(n))).drop(rk, n)


def run_starts(df: DataFrame, order: list[str], starts) -> DataFrame:
    """Rows in the order of ``order`` with ``_gpos`` (global position from 1) and ``_start`` (position of
    the first row of the row's run). ``starts(before, row)`` says whether a row begins a run, from structs
    of the ``order`` columns of the row before (null for the first) and of the row itself. No join or
    window is keyed by a run, so a run may hold any share of the rows."""
    placed = in_order(df, *order)
    row = F.struct(*[F.col(c) for c in order])
    per_part = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"), F.max_by(row, "_idx").alias("_last"))
    by_part, in_part = Window.orderBy("_part"), Window.partitionBy("_part").orderBy("_idx")
    parts = per_part.select("_part", _sum_before("_c", by_part).alias("_off"), F.lag("_last").over(by_part).alias("_prev"))
    marked = placed.join(F.broadcast(parts), "_part").withColumn("_gpos", F.col("_off") + F.col("_idx") + 1)
    first = starts(F.coalesce(F.lag(row).over(in_part), F.col("_prev")), row)
    marked = marked.withColumn("_first", F.when(first, F.col("_gpos")))
    marked = materialize(marked.withColumn("_in", F.max("_first").over(in_part.rowsBetween(Window.unboundedPreceding, 0))))
    carry = marked.groupBy("_part").agg(F.max("_first").alias("_m")).select(
        "_part", F.max("_m").over(by_part.rowsBetween(*_BEFORE)).alias("_carry"))
    return marked.join(F.broadcast(carry), "_part").select(*df.columns, "_gpos", F.coalesce("_in", "_carry").alias("_start"))


def positions_in_group(df: DataFrame, group_cols, order_cols, out: str = "pos") -> DataFrame:
    """1-based position of each row inside its group by ``order_cols`` (``row_number`` semantics)
    without sorting, joining or windowing a group in one task."""
    group_cols, order_cols = list(group_cols), list(order_cols)

    def starts(before: Column, row: Column) -> Column:
        same = F.lit(True)
        for c in group_cols:
            same = same & before[c].eqNullSafe(row[c])
        return before.isNull() | ~same

    runs = run_starts(df, [*group_cols, *order_cols], starts)
    return runs.withColumn(out, (F.col("_gpos") - F.col("_start") + 1).cast("bigint")).drop("_gpos", "_start")
