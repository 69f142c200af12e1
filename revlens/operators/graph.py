"""The commit graph: parent edges, first parent, reachability (JN-4, JN-7, SET-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import persist_table


def parent_edges(commits: DataFrame) -> DataFrame:
    """(commit_hash, pos, parent_hash) for every parent; roots yield no edge."""
    return commits.select("commit_hash", F.posexplode("parent_hashes").alias("pos", "parent_hash"))


def first_parent(commits: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """JN-4: each commit with its first parent's row (one left join; root or a parent missing from a
    shallow history -> nulls). A branch point with very many children is a hot key on the left side,
    which AQE splits."""
    p = (parents if parents is not None else commits).select(
        F.col("commit_hash").alias("first_parent"),
        F.col("author_name").alias("parent_author"),
        F.col("commit_timestamp").alias("parent_timestamp"),
    )
    return commits.withColumn("first_parent", F.get(F.col("parent_hashes"), 0)).join(p, "first_parent", "left")


PLAIN, LEVELS = 8, 4  # plain rounds before the graph is contracted, and parents of parents in each
MAX_LEVELS = 62
THIN = 8  # turns that thin out chains before they are doubled: 0.75^8 of the rows are left, about a tenth
SHRINK = 0.8  # contraction goes on while the edges left are at most this share of those before


def _up(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Distinct parents of the rows of ``reached`` (column ``v``)."""
    return edges.join(reached.select(F.col("v").alias("c")), "c", "left_semi").select(F.col("p").alias("v")).distinct()


def _coin(c: str, turn: int):
    return F.xxhash64(F.lit(turn), F.col(c)).bitwiseAND(F.lit(1)) == 1


def _roots_of(links: DataFrame) -> DataFrame:
    """(v, r): where the chains of ``links`` (v, r), at most one a ``v``, end. ``THIN`` turns first take out a
    quarter of the rows each: those whose own coin shows heads and whose ``r`` shows tails; links to them go
    on to their ``r``. Doubling then moves a tenth of the rows, and those taken out follow their ``r``, last
    turn first. So no more than a few times the links is moved, however long a chain is."""
    out = []
    for turn in range(THIN):
        goes = _coin("v", turn) & ~_coin("r", turn)
        gone = links.where(goes).select(F.col("v").alias("r"), F.col("r").alias("on"))
        kept = links.where(~goes)
        out.append(links.where(goes))
        links = persist_table(kept.join(gone, "r", "left").select("v", F.coalesce("on", "r").alias("r")), "chains")
    roots = _doubled(links)
    for gone in reversed(out):
        ends = roots.select(F.col("v").alias("r"), F.col("r").alias("end"))
        roots = persist_table(roots.unionByName(gone.join(ends, "r", "left").select("v", F.coalesce("end", "r").alias("r"))), "chains")
    return roots


def _doubled(links: DataFrame) -> DataFrame:
    """``_roots_of`` by doubling how far every row has come: a chain of n links takes log2(n) joins."""
    for _ in range(MAX_LEVELS):
        far = links.join(links.select(F.col("v").alias("r"), F.col("r").alias("further")), "r", "left")
        links = persist_table(far.select("v", F.coalesce("further", "r").alias("r"), F.col("further").isNotNull().alias("moved")), "chains")
        if links.where("moved").isEmpty():
            return links.select("v", "r")
        links = links.select("v", "r")
    raise RuntimeError("the commit graph has a cycle")


def _contract(edges: DataFrame, tips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One contraction: (edges left, merged). A commit all of whose children are one commit is reached just if
    that child is, so it merges into it (``merged``: v, r), chains at once. Then heads that are no tip, which
    nothing reaches, go with their edges. Tips stay themselves."""
    children = edges.groupBy("p").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    single = children.where("low = high").select(F.col("p").alias("v"), F.col("low").alias("r"))
    merged = _roots_of(persist_table(single.join(tips, "v", "left_anti"), "single"))
    c, p = (merged.withColumnsRenamed({"v": x, "r": f"{x}_root"}) for x in "cp")
    moved = edges.join(c, "c", "left").join(p, "p", "left").select(F.coalesce("c_root", "c").alias("c"), F.coalesce("p_root", "p").alias("p"))
    moved = persist_table(moved.where("c <> p").distinct(), "edges")
    heads = moved.select("c").distinct().join(moved.select(F.col("p").alias("c")), "c", "left_anti")
    dead = heads.join(tips.select(F.col("v").alias("c")), "c", "left_anti")
    return persist_table(moved.join(dead, "c", "left_anti"), "edges"), merged


def _jump_tables(first: DataFrame) -> list[DataFrame]:
    """(v, up): the k-th table leads 2^k steps up a forest of one parent each; log2(depth) tables."""
    tables = [first]
    while True:
        half = tables[-1]
        double = persist_table(half.join(half.select(F.col("v").alias("up"), F.col("up").alias("further")), "up").select(
            "v", F.col("further").alias("up")), "jump")
        if double.isEmpty():
            return tables
        tables.append(double)
        if len(tables) > MAX_LEVELS:
            raise RuntimeError("the commit graph has a cycle")


def reachable_from(commits: DataFrame, tips: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """JN-7: commits reachable from ``tips`` (column ``commit_hash``) through parent edges.

    * Few plain rounds first, each ``LEVELS`` generations of parents: that is all a shallow question needs.
    * Where a frontier is left, the unreached part of the graph is contracted: a commit with one child is
      reached just if its child is, so it merges into it, and doubling merges a chain of any length in
      log2(length) joins. Merged branches thereby become single edges, and what they were nested in
      contracts in turn, together with everything that hangs below one commit; heads that no tip reaches
      go. So neither the length of a history nor nested merges cost a round each.
    * What doesn't contract (criss-cross merges) is walked by jump tables of 1, 2, 4, ... first parents: a round
      adds all first-parent ancestors of its frontier. Then merged commits join what they merged into.

    ``max_rounds`` (plain rounds, contractions and walks) raises instead of truncating; every table is written to
    the shared folder, so a lost executor recomputes at most the step at hand.
    """
    rounds = 0

    def count() -> None:
        nonlocal rounds
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError("reachability did not converge within the given number of rounds")
        rounds += 1

    edges = parent_edges(commits).where("parent_hash IS NOT NULL").select(F.col("commit_hash").alias("c"), F.col("parent_hash").alias("p"))
    edges = persist_table(edges, "edges")
    frontier = persist_table(tips.select(F.col("commit_hash").alias("v")).where("v IS NOT NULL").distinct(), "frontier")
    found = [frontier]
    for _ in range(PLAIN):
        count()
        frontier = _expand(edges, frontier, found)
        if frontier.isEmpty():
            return _hashes(found)

    # what is reached needs no edge to it, and only the frontier's own edges lead on
    done = persist_table(_union(found).distinct(), "reached")
    found = [done]
    old = done.join(frontier, "v", "left_anti").select(F.col("v").alias("c"))
    rest = persist_table(edges.join(old, "c", "left_anti").join(done.select(F.col("v").alias("p")), "p", "left_anti"), "edges")
    merges, size = [], rest.count()
    while size:
        count()
        rest, merged = _contract(rest, frontier)
        merges.append(merged)
        before, size = size, rest.count()
        if size > SHRINK * before:
            break
    if size:
        jumps = _jump_tables(persist_table(rest.groupBy("c").agg(F.min("p").alias("up")).withColumnRenamed("c", "v"), "jump"))
        while True:
            count()
            reach = frontier
            for level, jump in enumerate(jumps, 1):
                here_and_up = F.array_compact(F.array("v", "up"))
                reach = reach.join(jump, "v", "left").select(F.explode(here_and_up).alias("v")).distinct()
                if level % 5 == 0:  # plans stay short
                    reach = persist_table(reach, "reach")
            reach = persist_table(reach, "reached")
            found.append(reach)
            frontier = _expand(rest, reach, found, 1)
            if frontier.isEmpty():
                break
    seen = persist_table(_union(found).distinct(), "reached")
    for merged in reversed(merges):
        below = merged.join(seen.select(F.col("v").alias("r")), "r", "left_semi").select("v")
        seen = persist_table(seen.union(below).distinct(), "reached")
    return seen.select(F.col("v").alias("commit_hash"))


def _expand(edges: DataFrame, frontier: DataFrame, found: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """The next ``levels`` generations of parents that are not in ``found``, which they join."""
    generations = []
    for _ in range(levels):
        generations.append(_up(edges, generations[-1] if generations else frontier))
    new = _union(generations).distinct().join(_union(found), "v", "left_anti")
    new = persist_table(new, "frontier")
    found.append(new)
    if len(found) >= 8:  # few parts to read in each round
        found[:] = [persist_table(_union(found).distinct(), "reached")]
    return new


def _hashes(found: list[DataFrame]) -> DataFrame:
    return _union(found).select(F.col("v").alias("commit_hash")).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def branch_tips(commits: DataFrame) -> DataFrame:
    """Commits that are nobody's parent (the heads of all branches)."""
    parents = parent_edges(commits).select(F.col("parent_hash").alias("commit_hash")).distinct()
    return commits.select("commit_hash").join(parents, "commit_hash", "left_anti")


def all_refs_commits(commits: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """SET-2: distinct commits reachable from any ref (``rev-list --all``).

    Without explicit ``refs`` every branch tip (childless commit) is a ref. In a finite acyclic
    commit graph every commit lies below some childless commit (follow children until there are
    none), so the answer is every commit plus every referenced parent (a parent missing from a
    shallow history included): one distinct union, no rounds. Explicit refs use the frontier
    expansion of ``reachable_from``.
    """
    if refs is not None:
        return reachable_from(commits, refs)
    parents = parent_edges(commits).select(F.col("parent_hash").alias("commit_hash"))
    return commits.select("commit_hash").unionByName(parents).where(F.col("commit_hash").isNotNull()).distinct()
