"""Comparing change tables and snapshots (JN-1, JN-5, JN-6, SET-1, SET-3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.scalar import _OTHER_BREAK, _SPLITLINES, _TERMINATOR_AT_END, count_text_lines, strip_ws
from revlens.operators.ranking import positions_in_group
from revlens.session import materialize, persist_table

_LINE_SPLIT = _SPLITLINES
_ENDS_WITH_TERMINATOR = _TERMINATOR_AT_END
#: Similarities in percent that ``similar_renames`` settles before it looks for less similar pairs.
BANDS = (90, 70)
#: Set difference: seconds a stretch and children a tree node, as a power of two (more if the tolerance needs it).
STRETCH_BITS = 10


def text_lines(text) -> Column:
    """``str.splitlines()`` as an array column ('' -> [], a trailing terminator adds no line)."""
    t = F.col(text) if isinstance(text, str) else text
    other = t.rlike(_OTHER_BREAK)
    parts = F.when(other, F.split(t, _LINE_SPLIT)).otherwise(F.split(t, "\n"))
    ends = F.when(other, t.rlike(_ENDS_WITH_TERMINATOR)).otherwise(t.endswith("\n"))
    trimmed = F.when(ends, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(trimmed)


def merge_stats(numstat: DataFrame, name_status: DataFrame, keys=("commit_hash",)) -> DataFrame:
    """JN-1: numstat and name-status lines by (commit, path); the last line (largest ``pos``, which both
    sides must carry) wins on each side; missing counts -> 0, missing type -> 'U'.

    One aggregate over the stacked lines of both sides instead of a full outer join of two: one shuffle,
    of rows already reduced to one a key and task."""
    for side in (numstat, name_status):
        if "pos" not in side.columns:
            raise ValueError("merge_stats needs the column pos: the last line is undefined without it")
    k = [*keys, "file_path"]
    none = F.lit(None)
    lines = numstat.select(*k, F.col("pos").alias("_cp"), "additions", "deletions", none.cast(numstat.schema["pos"].dataType).alias("_tp"),
                           none.cast("string").alias("change_type")).unionByName(
        name_status.select(*k, none.cast(name_status.schema["pos"].dataType).alias("_cp"), none.cast("bigint").alias("additions"),
                           none.cast("bigint").alias("deletions"), F.col("pos").alias("_tp"), "change_type"))
    return lines.groupBy(*k).agg(  # a line of the other side has no position and never wins
        F.coalesce(F.max_by("additions", "_cp"), F.lit(0)).cast("bigint").alias("additions"),
        F.coalesce(F.max_by("deletions", "_cp"), F.lit(0)).cast("bigint").alias("deletions"),
        F.coalesce(F.max_by("change_type", "_tp"), F.lit("U")).alias("change_type"),
    )


def touched_paths(numstat: DataFrame, name_status: DataFrame, keys=("commit_hash",)) -> DataFrame:
    """SET-1: distinct union of the paths in both stat tables."""
    k = [*keys, "file_path"]
    return numstat.select(*k).union(name_status.select(*k)).distinct()


def content_hashes(snapshot: DataFrame, keys=("commit_hash",), path_col: str = "path", content_col: str = "content",
                   hash_col: str | None = None) -> DataFrame:
    """(keys, path, _h) of a snapshot: what comparisons move instead of contents."""
    h = F.col(hash_col) if hash_col else F.sha2(F.col(content_col), 256)
    return snapshot.select(*keys, path_col, h.alias("_h"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys=("commit_hash",), path_col: str = "path",
                  content_col: str = "content", hash_col: str | None = None,
                  patch_stats: DataFrame | None = None, hashes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """JN-5: two path -> content tables -> (path, change_type A/D/M, additions, deletions, count_kind).

    Only new = add (lines of the new text), only old = delete (lines of the old text): ``count_kind`` is
    'lines'. Differing content = modify. Its counts are those of ``patch_stats`` (keys, path, additions,
    deletions; e.g. ``patch_line_stats`` output) where given: 'patch'. Elsewhere they are the net change of
    each distinct line's number, in which moved lines count 0: 'net', a lower bound of a line diff.
    Contents are compared by hash (``hashes``: both sides' ``content_hashes``, if at hand); they are
    fetched for changed paths only.
    """
    k = [*keys, path_col]
    text = lambda side: lambda paths, of=F.col: side.select(*k, of(content_col).alias("_t")).join(paths, k, "left_semi")
    ho, hn = hashes or tuple(content_hashes(x, keys, path_col, content_col, hash_col) for x in (old, new))
    return _diff(ho, hn, text(old), text(new), keys, path_col, patch_stats)


def _diff(ho: DataFrame, hn: DataFrame, old_text, new_text, keys, path_col: str, patch_stats: DataFrame | None) -> DataFrame:
    """``old_text(paths, of)`` and ``new_text(paths, of)`` fetch (keys, path, _t) for a table of changed paths: the
    contents, or what ``of`` makes of them where they are read."""
    k = [*keys, path_col]
    # 1. compare (commit, path, hash) only: contents of unchanged files never move
    changed = persist_table(
        ho.withColumnRenamed("_h", "_oh").join(hn.withColumnRenamed("_h", "_nh"), k, "full")
        .where(~F.col("_oh").eqNullSafe(F.col("_nh"))).select(
            *k, F.when(F.col("_oh").isNull(), "A").when(F.col("_nh").isNull(), "D").otherwise("M").alias("change_type")),
        "snapshot-changed")
    # 2. contents of modified paths only, and line counts of the others (the changed-key table has real size
    #    statistics, so Spark broadcasts it when small and the snapshots are filtered map-side)
    of_kind = lambda kind: changed.where(F.col("change_type") == kind)
    none = F.lit(0).cast("bigint")

    def whole(kind: str, fetch) -> DataFrame:
        counted = of_kind(kind).join(fetch(of_kind(kind).select(*k), count_text_lines), k, "left")
        lines = F.coalesce("_t", none)
        return counted.select(*k, "change_type", (lines if kind == "A" else none).alias("additions"),
                              (lines if kind == "D" else none).alias("deletions"), F.lit("lines").alias("count_kind"))

    adds_dels = whole("A", new_text).unionByName(whole("D", old_text))
    oc, nc = (fetch(of_kind("M").select(*k)).withColumnRenamed("_t", c) for fetch, c in ((old_text, "_ot"), (new_text, "_nt")))
    mods = of_kind("M").join(oc, k, "left").join(nc, k, "left")
    # new lines count +1, old lines -1, in one explode; a modified path always has a line
    signed = F.concat(
        F.transform(text_lines(F.col("_nt")), lambda x: F.struct(x.alias("line"), F.lit(1).alias("s"))),
        F.transform(text_lines(F.col("_ot")), lambda x: F.struct(x.alias("line"), F.lit(-1).alias("s"))),
    )
    per_line = mods.select(*k, F.inline(signed))
    net = per_line.groupBy(*k, "line").agg(F.sum("s").alias("d"))
    modified = net.groupBy(*k).agg(
        F.sum(F.greatest(F.col("d"), F.lit(0))).cast("bigint").alias("additions"),
        F.sum(F.greatest(-F.col("d"), F.lit(0))).cast("bigint").alias("deletions"),
    ).select(*k, F.lit("M").alias("change_type"), "additions", "deletions", F.lit("net").alias("count_kind"))
    if patch_stats is not None:
        ps = patch_stats.select(*keys, F.col("file_path").alias(path_col) if "file_path" in patch_stats.columns
                                else F.col(path_col), F.col("additions").alias("_pa"), F.col("deletions").alias("_pd"))
        modified = modified.join(ps, k, "left").select(
            *k, "change_type",
            F.coalesce("_pa", "additions").cast("bigint").alias("additions"),
            F.coalesce("_pd", "deletions").cast("bigint").alias("deletions"),
            F.when(F.col("_pa").isNotNull() & F.col("_pd").isNotNull(), "patch").otherwise("net").alias("count_kind"))
    return adds_dels.unionByName(modified)


def tree_changes(commits: DataFrame, trees: DataFrame, path_col: str = "path", content_col: str = "content",
                 hash_col: str | None = None) -> DataFrame:
    """JN-4 + JN-5 (D7): each commit's changes against its first parent's tree.

    ``trees`` holds (commit_hash, path, content[, hash]) snapshots. They are hashed where they are read;
    the parent's (path, hash) rows are relabelled with the child's id through the first-parent edge (an
    inner join, no per-commit loop; AQE splits a branch point with very many children on either side).
    Contents follow for changed paths only, found through the same edge. A root commit, or a parent missing
    from a shallow history, diffs against the empty tree (everything added)."""
    edge = persist_table(commits.select("commit_hash", F.get(F.col("parent_hashes"), 0).alias("_parent")).where(
        F.col("_parent").isNotNull()), "parent-edges")
    hashes = persist_table(content_hashes(trees, path_col=path_col, content_col=content_col, hash_col=hash_col), "tree-hashes")
    old = edge.join(hashes.withColumnRenamed("commit_hash", "_parent"), "_parent").select("commit_hash", path_col, "_h")
    texts = lambda of: trees.select("commit_hash", path_col, of(content_col).alias("_t"))

    def of_parent(paths: DataFrame, of=F.col) -> DataFrame:
        wanted = paths.join(edge, "commit_hash")
        return wanted.join(texts(of).withColumnRenamed("commit_hash", "_parent"), ["_parent", path_col]).select("commit_hash", path_col, "_t")

    def of_commit(paths: DataFrame, of=F.col) -> DataFrame:
        return texts(of).join(paths, ["commit_hash", path_col], "left_semi")

    return _diff(old, hashes, of_parent, of_commit, ("commit_hash",), path_col, None)


def renamed_diff(old: DataFrame, new: DataFrame, keys=("commit_hash",), path_col: str = "path",
                 content_col: str = "content") -> DataFrame:
    """JN-5 then JN-6 with every content hashed once."""
    hashes = tuple(persist_table(content_hashes(x, keys, path_col, content_col), "hashes") for x in (old, new))
    changes = snapshot_diff(old, new, keys, path_col, content_col, hashes=hashes)
    return exact_renames(changes, old, new, keys, path_col, content_col, hashes)


def exact_renames(changes: DataFrame, old: DataFrame, new: DataFrame, keys=("commit_hash",), path_col: str = "path",
                  content_col: str = "content", hashes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """JN-6: in one commit pair the k-th delete and the k-th add of identical content (ordered by
    path) -> 'R' with 0/0 and the old path; an unpaired add whose content still exists unchanged
    at another path -> 'C' from the smallest such path. Other rows pass through.

    ``changes`` is ``snapshot_diff`` output; ``old``/``new`` are the snapshots, ``hashes`` their written
    ``content_hashes`` if at hand.
    """
    k = list(keys)
    # Each of these is read by several branches below: computed once (diff rows and path->hash
    # tables are small next to the snapshots' contents).
    changes = materialize(changes.select(*k, path_col, "change_type", "additions", "deletions"))
    hashes = hashes or tuple(persist_table(content_hashes(x, keys, path_col, content_col), "hashes") for x in (old, new))
    h_old, h_new = (h.withColumnRenamed(path_col, "_p") for h in hashes)
    d = changes.where(F.col("change_type") == "D").join(
        h_old.withColumnRenamed("_p", path_col), [*k, path_col]).select(*k, path_col, "_h")
    a = changes.where(F.col("change_type") == "A").join(
        h_new.withColumnRenamed("_p", path_col), [*k, path_col]).select(*k, path_col, "_h")
    # k-th delete pairs with k-th add of the same content; positions without a per-group sort,
    # both sides in one pass (side tag in the group key)
    both = materialize(positions_in_group(
        d.withColumn("_side", F.lit("d")).unionByName(a.withColumn("_side", F.lit("a"))),
        ["_side", *k, "_h"], [path_col], "_i"))
    d = both.where(F.col("_side") == "d").drop("_side")
    a = both.where(F.col("_side") == "a").drop("_side")
    pairs = materialize(a.alias("a").join(d.alias("d"), [*k, "_h", "_i"]).select(
        *k, F.col(f"a.{path_col}").alias(path_col), F.col(f"d.{path_col}").alias("old_file_path")))
    renamed_new = pairs.select(*k, path_col, F.lit("R").alias("change_type"),
                               F.lit(0).cast("bigint").alias("additions"), F.lit(0).cast("bigint").alias("deletions"),
                               "old_file_path")
    consumed = pairs.select(*k, path_col).unionByName(pairs.select(*k, F.col("old_file_path").alias(path_col)))
    rest = changes.join(consumed, [*k, path_col], "left_anti")
    # copies: unpaired adds whose content is unchanged at another path in both snapshots
    unchanged = h_old.join(h_new, [*k, "_p", "_h"]).groupBy(*k, "_h").agg(F.min("_p").alias("_src"))
    unpaired_adds = a.join(pairs.select(*k, path_col), [*k, path_col], "left_anti").select(*k, path_col, "_h")
    # a hash shared by very many unpaired adds (e.g. empty files) is a hot key of an inner join: AQE splits it
    copies = unpaired_adds.join(unchanged, [*k, "_h"]).select(*k, path_col, F.col("_src").alias("old_file_path"))
    rest = rest.join(copies, [*k, path_col], "left").select(
        *k, path_col,
        F.when(F.col("old_file_path").isNotNull(), F.lit("C")).otherwise(F.col("change_type")).alias("change_type"),
        "additions", "deletions", "old_file_path",
    )
    return renamed_new.unionByName(rest)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(lines: Column) -> Column:
    """Array of (line, c): each line of a sorted array once, with how often it occurs."""
    def of(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)), lambda i: i.isNotNull())
        return _with(starts, lambda s: F.transform(s, lambda at, j: F.struct(
            F.get(a, at).alias("line"), (F.coalesce(F.get(s, j + 1), F.size(a)) - at).cast("bigint").alias("c"))))

    return _with(lines, of)


def _line_runs(snapshot: DataFrame, contents: DataFrame, keys: list[str], path_col: str, content_col: str) -> DataFrame:
    """``contents`` (keys, path, ...) with ``_n``, the number of lines, and ``_runs``: each line once, by its hash, and
    how often it occurs. Lines are hashed where texts are read, and a content of many rows alike is one row."""
    hashed = F.transform(text_lines(content_col), lambda x: F.unhex(F.md5(x)))
    found = contents.join(snapshot.select(*keys, path_col, hashed.alias("_l")), [*keys, path_col])
    whole = found.groupBy(*contents.columns).agg(F.sort_array(F.flatten(F.collect_list("_l"))).alias("_l"))
    return whole.where(F.size("_l") > 0).select(*contents.columns, F.size("_l").cast("bigint").alias("_n"), _runs(F.col("_l")).alias("_runs"))


def line_prefixes(runs: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """(keys, _side, _id, _line, _n, _before): the lines of each content, rarest in its commit first, as far as two
    contents of ``threshold`` percent must share one of them; ``_before`` counts the lines before it."""
    lines = runs.select(*keys, "_side", "_id", "_n", F.inline("_runs")).withColumnRenamed("line", "_line")
    spread = lines.groupBy(*keys, "_line").agg(F.count(F.lit(1)).alias("_df"))
    inside = Window.partitionBy("_id").orderBy("_df", "_line")  # the lines of one file
    placed = lines.join(spread, [*keys, "_line"]).withColumn(
        "_before", F.coalesce(F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.where(_in_prefix(threshold)).select(*keys, "_side", "_id", "_line", "_n", "_before")


def _in_prefix(threshold: int) -> Column:
    return F.col("_before") <= F.col("_n") - F.ceil(F.col("_n") * threshold / 100)


def _shared(a: Column, b: Column) -> Column:
    """How many lines two arrays of (line, c) have in common, counted with repeats."""
    def of(x: Column) -> Column:
        same = lambda i: F.get(x, i)["line"] == F.get(x, i - 1)["line"]
        return F.aggregate(F.sequence(F.lit(1), F.size(x)), F.lit(0).cast("bigint"), lambda n, i: n + F.when(
            same(i), F.least(F.get(x, i)["c"], F.get(x, i - 1)["c"])).otherwise(0))

    return _with(F.sort_array(F.concat(a, b)), of)


def similar_pairs(runs: DataFrame, prefixes: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """(keys, _ido, _idn, _ho, _hn, _no, _nn, _shared, _score) of every deleted and added content of a commit that
    share at least ``threshold`` percent of the longer one's lines, counted with repeats.

    A set-similarity join: the lines of a content are put in order, rarest in its commit first; two contents
    that similar share a line among the first ``n - need + 1`` of each, so only these prefixes are joined, by
    (commit, line). Sizes and what remains behind the shared line bound the overlap before it is counted on
    all lines, which come in one row a content. Lines all files have (licences, braces) stand last and join nothing."""
    prefix = prefixes.where(_in_prefix(threshold))
    side = lambda k, mark: prefix.where(F.col("_side") == k).select(
        *keys, "_line", F.col("_id").alias(f"_id{mark}"), F.col("_n").alias(f"_n{mark}"), (F.col("_n") - F.col("_before")).alias(f"_rest{mark}"))
    longer = F.greatest("_no", "_nn")
    met = side("d", "o").join(side("a", "n"), [*keys, "_line"]).where(
        (F.least("_no", "_nn") * 100 >= longer * threshold) & (F.least("_resto", "_restn") * 100 >= longer * threshold))
    candidates = met.select("_ido", "_idn").distinct()
    of = lambda mark: [F.col(c).alias(f"{c}{mark}") for c in ("_id", "_h", "_n", "_runs")]
    both = candidates.join(runs.select(*keys, *of("o")), "_ido").join(runs.select(*of("n")), "_idn")
    shared = both.withColumn("_shared", _shared(F.col("_runso"), F.col("_runsn")))
    return shared.where(F.col("_shared") * 100 >= longer * threshold).select(
        *keys, "_ido", "_idn", "_ho", "_hn", "_no", "_nn", "_shared", F.floor(F.col("_shared") * 100 / longer).cast("int").alias("_score"))


def _spent(spark, taken: list[DataFrame], side: str) -> DataFrame:
    """(_id, _u): how many files of each content the pairs taken so far have used."""
    spent = spark.range(0).select(F.col("id").alias("_id"), F.col("id").alias("_k"))
    for t in taken:
        spent = spent.unionByName(t.select(F.col(f"_id{side}").alias("_id"), F.col("_take").alias("_k")))
    return spent.groupBy("_id").agg(F.sum("_k").alias("_u"))


def _settled(left: DataFrame) -> DataFrame:
    """``left`` (_ido, _idn, _order, _ro, _rn: files left of either content) with ``_take``, the files a pair could use, and
    ``_won``: whether it takes so many whatever becomes of the better pairs, as both its contents have enough files for
    all of these too. The best pair of all always has. The windows hold the pairs of one content."""
    taken = left.withColumn("_take", F.least("_ro", "_rn"))
    for side in "on":
        better = Window.partitionBy(f"_id{side}").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
        taken = taken.withColumn(f"_b{side}", F.sum("_take").over(better))
    return taken.withColumn("_won", (F.col("_bo") <= F.col("_ro")) & (F.col("_bn") <= F.col("_rn"))).drop("_bo", "_bn")


def _dominant_pairs(pairs: DataFrame, contents: DataFrame, taken: list[DataFrame]) -> None:
    """The greedy choice over ``pairs`` by score, ties by a hash, after the pairs in ``taken``; adds to it tables
    (columns of ``pairs``, _order, _take): how many files of either content a pair takes. A round takes every pair whose
    contents have files enough for it and all better ones: one that is the best for both, and those of a content of many
    files as far as these go, however many partners it has. Random ties make the rounds few."""
    spark = pairs.sparkSession
    # smaller is better; a struct without ties, the same for both ends
    order = F.struct((-F.col("_score")).alias("s"), F.md5(F.concat("_ho", F.lit("/"), "_hn")).alias("t"))
    left = pairs.withColumn("_order", order)
    for side in "on":
        free = contents.join(_spent(spark, taken, side), "_id", "left").select(
            F.col("_id").alias(f"_id{side}"), (F.col("_count") - F.coalesce("_u", F.lit(0))).alias(f"_r{side}"))
        left = left.join(free.where(F.col(f"_r{side}") > 0), f"_id{side}")
    while True:
        state = persist_table(_settled(left), "similar-pairs")
        won, left = state.where("_won"), state.where("not _won")
        taken.append(won.select(*pairs.columns, "_order", "_take"))
        if left.isEmpty():
            return
        for side in "on":
            used = won.groupBy(f"_id{side}").agg(F.sum("_take").alias("_used"))
            left = left.join(used, f"_id{side}", "left").withColumn(f"_r{side}", F.col(f"_r{side}") - F.coalesce("_used", F.lit(0))).drop("_used")
        left = left.where((F.col("_ro") > 0) & (F.col("_rn") > 0)).drop("_take", "_won")


def _with_places(chosen: DataFrame) -> DataFrame:
    """``chosen`` with _fo and _fn, how many files of its contents the better pairs took."""
    for side in "on":
        better = Window.partitionBy(f"_id{side}").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
        chosen = chosen.withColumn(f"_f{side}", F.coalesce(F.sum("_take").over(better), F.lit(0)))
    return chosen


def similar_renames(changes: DataFrame, old: DataFrame, new: DataFrame, keys=("commit_hash",), path_col: str = "path",
                    content_col: str = "content", threshold: int = 50,
                    hashes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """JN-6 beyond equal contents: a deleted and an added path of one commit whose texts share at least
    ``threshold`` percent of the longer one's lines -> 'R' with the old path, ``similarity`` (percent, rounded
    down) and the lines that differ as additions and deletions. Other rows pass through, ``similarity`` null
    (100 for renames and copies found by ``exact_renames``, whose output ``changes`` is).

    Pairs are 1:1, the most similar first (ties by a hash of both contents); paths of one content go in path
    order. Contents that occur at many paths are compared once, with their number, and no task holds a commit's
    pairs. Similarities are settled from the top in ``BANDS``: what very similar pairs have used up is not compared
    with the many files that are less so, which changes no choice. Texts without a line are never similar; no deletes or no adds -> nothing changes.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold is a percentage above 0")
    k = list(keys)
    changes = persist_table(changes.select(*k, path_col, "change_type", "additions", "deletions", "old_file_path"), "rename-changes")
    hashes = hashes or tuple(persist_table(content_hashes(x, keys, path_col, content_col), "hashes") for x in (old, new))
    sides = []
    for mark, kind, hashed in (("d", "D", hashes[0]), ("a", "A", hashes[1])):
        sides.append(changes.where(F.col("change_type") == kind).join(hashed, [*k, path_col]).select(*k, path_col, "_h", F.lit(mark).alias("_side")))
    files = materialize(positions_in_group(sides[0].unionByName(sides[1]), ["_side", *k, "_h"], [path_col], "_i"))
    contents = files.groupBy("_side", *k, "_h").agg(F.count(F.lit(1)).alias("_count"), F.min(path_col).alias(path_col))
    contents = persist_table(contents.withColumn("_id", F.monotonically_increasing_id()), "contents")
    runs = [_line_runs(snapshot, contents.where(F.col("_side") == mark).drop("_count"), k, path_col, content_col) for mark, snapshot in (("d", old), ("a", new))]
    runs = persist_table(runs[0].unionByName(runs[1]).drop(path_col), "line-runs")
    prefixes = persist_table(line_prefixes(runs, k, threshold), "line-prefixes")
    taken: list[DataFrame] = []
    for least in [*(b for b in BANDS if b > threshold), threshold]:
        if taken:
            spent = _spent(old.sparkSession, taken, "o").unionByName(_spent(old.sparkSession, taken, "n"))
            full = contents.join(spent, "_id").where(F.col("_u") >= F.col("_count")).select("_id")
            prefixes = persist_table(prefixes.join(full, "_id", "left_anti"), "line-prefixes")
        _dominant_pairs(similar_pairs(runs, prefixes, k, least), contents, taken)
    chosen = persist_table(_with_places(reduce(DataFrame.unionByName, taken)), "similar-taken")
    path_of = lambda mark, h, name: files.where(F.col("_side") == mark).select(*k, F.col("_h").alias(h), "_i", F.col(path_col).alias(name))
    olds = chosen.join(path_of("d", "_ho", "old_file_path"), [*k, "_ho"]).where(
        (F.col("_i") > F.col("_fo")) & (F.col("_i") <= F.col("_fo") + F.col("_take"))).withColumn("_j", F.col("_i") - F.col("_fo") + F.col("_fn")).drop("_i")
    paired = olds.join(path_of("a", "_hn", path_col).withColumnRenamed("_i", "_j"), [*k, "_hn", "_j"])
    renamed = persist_table(paired.select(
        *k, path_col, F.lit("R").alias("change_type"), (F.col("_nn") - F.col("_shared")).alias("additions"),
        (F.col("_no") - F.col("_shared")).alias("deletions"), "old_file_path", F.col("_score").alias("similarity")), "similar-renames")
    gone = renamed.select(*k, path_col, F.lit("A").alias("change_type")).unionByName(
        renamed.select(*k, F.col("old_file_path").alias(path_col), F.lit("D").alias("change_type")))
    rest = changes.join(gone, [*k, path_col, "change_type"], "left_anti").select(
        *k, path_col, "change_type", "additions", "deletions", "old_file_path",
        F.when(F.col("old_file_path").isNotNull(), F.lit(100)).alias("similarity"))
    return renamed.unionByName(rest)


def normalize_commit_set(commits: DataFrame) -> DataFrame:
    """SET-3 normal form: no hash, parents sorted, message stripped."""
    return commits.select(
        "author_name", "author_email",
        strip_ws("commit_message").alias("message"),
        F.array_join(F.array_sort("parent_hashes"), " ").alias("parents"),
        F.col("commit_timestamp").alias("ts"),
    )


def change_set_diff(a: DataFrame, b: DataFrame, tolerance_s: int = 2) -> DataFrame:
    """SET-3: rows of either set without a partner in the other: same author, stripped message and parent
    set, time within ``tolerance_s``. Partners are paired 1:1, as many as can be: in time order, each row
    with the earliest unpaired one of the other side that is not too old.

    Rows of a key are first counted per second and side (equal rows are one row from there on). What waits
    is always the latest rows of one side, so one signed number (first side > 0) is the whole state, and a
    second turns it into ``clamp(state, -nb, na of the tolerance before) + na - nb``. Such steps compose to a
    step of the same form, so a key's seconds are cut into stretches of 2^``STRETCH_BITS`` seconds, each
    folded to one step; where stretches touch, a tree of at most 2^``STRETCH_BITS`` children a node
    (``_arriving``) tells each the state it begins with. No task or array holds more than a stretch."""
    key = ["author_name", "author_email", "message", "parents"]
    side = lambda df, name: normalize_commit_set(df).select(*key, F.col("ts").cast("bigint").alias("ts"), F.lit(int(name == "a")).alias("na"), F.lit(int(name == "b")).alias("nb"))
    seconds = side(a, "a").unionByName(side(b, "b")).groupBy(*key, "ts").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    seconds = materialize(seconds)
    bits = max(STRETCH_BITS, int(tolerance_s).bit_length())

    # each second in its stretch, and as context (place -1, 1) in the next and the one before if near to it
    at = lambda shift, place: F.struct(F.shiftright(F.col("ts") + shift, bits).alias("_g"), F.lit(place).alias("place"))
    places = F.array_distinct(F.array(at(0, 0), at(tolerance_s, -1), at(-tolerance_s, 1)))
    own = F.shiftright("ts", bits)
    placed = seconds.where(F.col("ts").isNotNull()).select(
        *key, "ts", "na", "nb", F.inline(F.filter(places, lambda x: (x["place"] == 0) | (x["_g"] != own))))
    by_time = Window.partitionBy(*key, "_g").orderBy("ts")  # at most a stretch and its context
    before, after = by_time.rangeBetween(-tolerance_s, 0), by_time.rangeBetween(0, tolerance_s)
    near = placed.select(*key, "_g", F.struct(
        "ts", "place", "na", "nb", (F.sum("nb").over(before) - F.col("nb")).alias("lo"), (F.sum("na").over(before) - F.col("na")).alias("hi"),
        (F.sum("na").over(after) - F.col("na")).alias("later_a"), (F.sum("nb").over(after) - F.col("nb")).alias("later_b"),
        (F.count(F.lit(1)).over(after) - 1).cast("int").alias("ahead")).alias("e"))
    stretches = near.where("e.place >= 0").groupBy(*key, "_g").agg(F.sort_array(F.collect_list("e")).alias("events"))
    steps = F.transform(F.filter("events", lambda e: e["place"] == 0), lambda e: F.struct(
        (-e["lo"]).alias("low"), e["hi"].alias("high"), (e["na"] - e["nb"]).alias("add")))
    stretches = materialize(stretches.where(F.exists("events", lambda e: e["place"] == 0)).select(
        *key, "_g", "events", _composed(steps).alias("step"), (F.get(steps, F.lit(0))["low"] < F.get(steps, F.lit(0))["high"]).alias("chained")))

    links = stretches.where(F.col("chained") | F.exists("events", lambda e: e["place"] == 1)).select(*key, "_g", "step")
    arriving = _arriving(links, key)
    alone = stretches.where(~F.col("chained")).select(*key, "events", F.lit(0).cast("bigint").alias("_x"))
    fed = _joined(stretches.where("chained"), arriving, [*key, "_g"]).select(*key, "events", "_x")
    left = alone.unionByName(fed).select(*key, F.inline(_unpaired(F.col("events"), F.col("_x"))))
    timeless = seconds.where(F.col("ts").isNull()).select(*key, "ts", (F.col("na") - F.col("nb")).alias("n"))
    left = left.unionByName(timeless).where("n <> 0")
    out = left.select(F.when(F.col("n") > 0, "only_a").otherwise("only_b").alias("side"), *key, "ts",
                      F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("n"))).alias("_i"))
    return out.drop("_i")


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def _take(x: Column, step: Column) -> Column:
    """The state after a step (low, high, add)."""
    return _clamp(x, step["low"], step["high"]) + step["add"]


def _composed(steps: Column) -> Column:
    """One step (low, high, add) that does what an array of steps does in turn."""
    far = F.lit(1 << 62)
    whole = F.struct((-far).alias("low"), far.alias("high"), F.lit(0).cast("bigint").alias("add"))

    def then(s: Column, e: Column) -> Column:
        low, high = e["low"] - s["add"], e["high"] - s["add"]
        return F.struct(_clamp(s["low"], low, high).alias("low"), _clamp(s["high"], low, high).alias("high"), (s["add"] + e["add"]).alias("add"))

    return F.aggregate(steps, whole, then)


def _joined(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal columns, nulls equal."""
    named = found.select(*[F.col(c).alias(f"_r{c}") for c in on], *[c for c in found.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return rows.join(named, same)


def _arriving(links: DataFrame, key: list[str]) -> DataFrame:
    """(key, _g, _x): the state in which each stretch begins, from the steps of the stretches before it. Steps
    are composed up a tree by position, and states handed down it: a node has at most 2^``STRETCH_BITS``
    children, and a position of 63 bits few levels."""
    first, last = links.agg(F.min("_g"), F.max("_g")).first()
    if first is None:
        return links.select(*key, "_g", F.lit(0).cast("bigint").alias("_x"))
    levels = [links.select(*key, (F.col("_g") - F.lit(first)).alias("_i"), "step")]
    span = last - first
    while span or len(levels) == 1:
        span >>= STRETCH_BITS
        children = F.sort_array(F.collect_list(F.struct("_i", "step"))).alias("children")
        node = levels[-1].groupBy(*key, F.shiftright("_i", STRETCH_BITS).alias("_up")).agg(children)
        levels.append(materialize(node.select(*key, F.col("_up").alias("_i"), "children", _composed(F.col("children.step")).alias("step"))))
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<struct<_i:bigint,_x:bigint>>")

    def hand_down(s: Column, c: Column) -> Column:
        to = F.struct(c["_i"].alias("_i"), s["x"].alias("_x"))
        return F.struct(_take(s["x"], c["step"]).alias("x"), F.concat(s["out"], F.array(to)).alias("out"))

    states = levels[-1].select(*key, "_i", zero.alias("_x"))
    for level in reversed(levels[1:]):
        nodes = _joined(level, states, [*key, "_i"])
        begin = F.struct(F.col("_x").alias("x"), none.alias("out"))
        states = nodes.select(*key, F.inline(F.aggregate("children", begin, hand_down, lambda s: s["out"])))
    return states.select(*key, (F.col("_i") + F.lit(first)).alias("_g"), "_x")


def _unpaired(events: Column, start: Column) -> Column:
    """Array of (ts, n) that stay unpaired of a stretch's own seconds, n > 0 rows of the first side and n < 0
    of the second, where the stretch begins in state ``start``. A second's rows are lost if they still wait
    after the last second within the tolerance; later rows of their side are behind them."""
    begin = F.struct(start.alias("x"), F.array().cast("array<bigint>").alias("all"))

    def walk(s: Column, e: Column) -> Column:
        x = _clamp(s["x"], -e["lo"], e["hi"]) + e["na"] - e["nb"]
        return F.struct(x.alias("x"), F.concat(s["all"], F.array(x)).alias("all"))

    both = F.transform(F.array(F.aggregate(events, begin, walk, lambda s: s["all"])), lambda states: F.transform(events, lambda e, i: F.struct(
        e["ts"].alias("ts"), e["place"].alias("place"),
        (_clamp(F.get(states, i + e["ahead"]) - e["later_a"], F.lit(0), e["na"])
         - _clamp(-F.get(states, i + e["ahead"]) - e["later_b"], F.lit(0), e["nb"])).alias("n"))))
    lost = F.filter(F.get(both, F.lit(0)), lambda r: (r["place"] == 0) & (r["n"] != 0))
    return F.transform(lost, lambda r: F.struct(r["ts"].alias("ts"), r["n"].cast("bigint").alias("n")))
