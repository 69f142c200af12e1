"""Connected components of a link table by alternating stars, entirely in DataFrame operations.

Each round every node links all its larger neighbours to the smallest node it knows (large star),
then all its smaller ones (small star). Links only ever point towards smaller nodes, so the rounds
end, after a number of rounds that grows with the logarithm of the longest path, when every link
points to the smallest node of its component. Minima are combined map-side and the joins are plain
inner joins, so a node with a third of all links is split by Spark's skew handling. Nothing but a
count and a checksum a round reaches the driver; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import Scratch


def _star(pairs: DataFrame, towards: DataFrame) -> DataFrame:
    """Links every v of ``pairs`` (u, v) to the smallest node known to its u."""
    return (pairs.join(towards, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (u, v): any pairs of longs. Returns (u, v): each non-root node and its root, the
    smallest node of its component. Loops and repeated links are ignored; no links -> no rows."""
    edges = scratch.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        # large star: u's neighbours on both sides give its minimum; the larger ones move there
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(_star(both.where("v > u"), low).distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = scratch.keep(_star(large, low).union(low.select("u", F.col("m").alias("v"))).distinct())
