"""Joins over the commit graph and snapshots (JN-4..7, SET-2, SET-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import diff as D
from revlens.operators import graph as G
from revlens.plans.catalog import register, td, with_mapping


@register("first_parent", with_mapping(
    "SELECT c.commit_hash, c.first_parent, p.author_name AS parent_author, p.commit_timestamp AS parent_timestamp"
    " FROM commits c LEFT JOIN commits p ON p.commit_hash = c.first_parent"))
def q_first_parent(spark, sf):
    heads = td.commit_heads(spark, sf)
    return G.first_parent(heads).select("commit_hash", "first_parent", "parent_author", "parent_timestamp")


_EDGES = """
, edges AS (
  SELECT commit_hash AS child, CAST(p1 AS VARCHAR) AS parent FROM commits JOIN o ON o.o_orderkey = commits.ok
  WHERE p1 IS NOT NULL
  UNION ALL
  SELECT commit_hash, CAST(p2 AS VARCHAR) FROM commits JOIN o ON o.o_orderkey = commits.ok
  WHERE p2 IS NOT NULL),
tips AS (SELECT commit_hash FROM commits WHERE commit_hash NOT IN (SELECT parent FROM edges))
"""


@register("reachable_from", with_mapping(_EDGES + """
, seeds AS (SELECT t.commit_hash FROM tips t JOIN commits c USING (commit_hash)
            WHERE starts_with(c.author_email, 'building.'))
SELECT DISTINCT commit_hash FROM (
  WITH RECURSIVE r(h) AS (SELECT commit_hash FROM seeds
                          UNION SELECT e.parent FROM r JOIN edges e ON e.child = r.h)
  SELECT h AS commit_hash FROM r)"""))
def q_reachable_from(spark, sf):
    heads = td.commit_heads(spark, sf)
    tips = G.branch_tips(heads).join(heads.select("commit_hash", "author_email"), "commit_hash") \
        .where(F.col("author_email").startswith("building."))
    return G.reachable_from(heads, tips)


@register("reachable_chain", """
WITH island AS (SELECT o_orderkey AS k, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS g FROM orders),
tips AS (SELECT g, max(k) AS top FROM island WHERE k % 5000 = 4321 GROUP BY g)
SELECT CAST(k AS VARCHAR) AS commit_hash FROM island JOIN tips USING (g) WHERE k <= top""")
def q_reachable_chain(spark, sf):
    """JN-7 on straight histories: each order's parent is the order numbered one below, if it exists."""
    k = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    parent = k.select((F.col("k") + 1).alias("k"), F.col("k").cast("string").alias("p"))
    chain = k.join(parent, "k", "left").select(
        F.col("k").cast("string").alias("commit_hash"), F.filter(F.array("p"), lambda x: x.isNotNull()).alias("parent_hashes"))
    return G.reachable_from(chain, k.where("k % 5000 = 4321").select(F.col("k").cast("string").alias("commit_hash")))


@register("reachable_ladder", """
WITH island AS (SELECT o_orderkey AS k, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS g FROM orders),
tips AS (SELECT g, max(k) AS top FROM island WHERE k % 5000 = 4321 GROUP BY g),
r AS (SELECT CAST(k AS VARCHAR) AS k FROM island JOIN tips USING (g) WHERE k <= top)
SELECT 'n' || k AS commit_hash FROM r UNION ALL SELECT 'x' || k FROM r UNION ALL SELECT 'root' WHERE EXISTS (SELECT 1 FROM r)""")
def q_reachable_ladder(spark, sf):
    """JN-7 down a ladder: each order merges a commit of its own first and the order below second."""
    k = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    below = k.select((F.col("k") + 1).alias("k"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("p"))
    name = lambda c: F.concat(F.lit(c), F.col("k").cast("string"))
    rungs = k.join(below, "k", "left").select(name("n").alias("commit_hash"), F.array_compact(F.array(name("x"), "p")).alias("parent_hashes"))
    sides = k.select(name("x").alias("commit_hash"), F.array(F.lit("root")).alias("parent_hashes"))
    return G.reachable_from(rungs.union(sides), k.where("k % 5000 = 4321").select(name("n").alias("commit_hash")))


@register("all_refs_commits", with_mapping(_EDGES + """
SELECT DISTINCT commit_hash FROM (
  WITH RECURSIVE r(h) AS (SELECT commit_hash FROM tips
                          UNION SELECT e.parent FROM r JOIN edges e ON e.child = r.h)
  SELECT h AS commit_hash FROM r)"""))
def q_all_refs_commits(spark, sf):
    return G.all_refs_commits(td.commit_heads(spark, sf))


@register("reachable_turns", """
WITH RECURSIVE
  nodes AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS h,
                   CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) END AS parent,
                   conv_id, turn, role FROM conversations),
  last AS (SELECT conv_id, max(turn) AS mt FROM conversations GROUP BY conv_id),
  seeds AS (SELECT n.h FROM nodes n JOIN last l ON l.conv_id = n.conv_id AND l.mt = n.turn WHERE n.role = 'assistant'),
  r(h) AS (SELECT h FROM seeds UNION SELECT n.parent FROM r JOIN nodes n ON n.h = r.h WHERE n.parent IS NOT NULL)
SELECT h AS commit_hash FROM r
""")
def q_reachable_turns(spark, sf):
    """JN-7 on a second graph: conversation turns, parent = previous turn."""
    conv = td.table(spark, sf, "conversations")
    h = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat(F.col("conv_id").cast("string"), F.lit("-"),
                                                (F.col("turn") - 1).cast("string")))
    nodes = conv.select(h.alias("commit_hash"), F.filter(F.array(parent), lambda x: x.isNotNull()).alias("parent_hashes"),
                        "conv_id", "turn", "role")
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    seeds = nodes.join(last, ["conv_id", "turn"]).where(F.col("role") == "assistant").select("commit_hash")
    return G.reachable_from(nodes, seeds)


# ---- snapshots from documents ---------------------------------------------------------
# commit = source; old snapshot: every non-'de' document ('fr' under old/, others under keep/);
# new snapshot: every document except short 'en' ones ('fr' under new/, others under keep/);
# long non-fr/de documents are edited (a line appended, or the first line replaced).

def _snapshots(spark, sf):
    docs = td.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    fr = F.col("lang") == "fr"
    old = docs.where(F.col("lang") != "de").select(
        F.col("source").alias("commit_hash"),
        F.concat(F.when(fr, F.lit("old/")).otherwise(F.lit("keep/")), name).alias("path"),
        F.col("text").alias("content"))
    edited = ~F.col("lang").isin("fr", "de")
    content = (F.when(edited & (F.col("n_chars") > 5000), F.concat(F.col("text"), F.lit("\nextra line")))
               .when(edited & (F.col("n_chars") >= 3000), F.regexp_replace("text", r"^[^\n]*", "REPLACED"))
               .otherwise(F.col("text")))
    new = docs.where(~((F.col("lang") == "en") & (F.col("n_chars") < 300))).select(
        F.col("source").alias("commit_hash"),
        F.concat(F.when(fr, F.lit("new/")).otherwise(F.lit("keep/")), name).alias("path"),
        content.alias("content"))
    return old, new


_TERM = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_SNAP_INPUTS = f"""
WITH docs AS (SELECT doc_id, text, lang, source, n_chars FROM documents),
old AS (SELECT source AS commit_hash, CASE WHEN lang = 'fr' THEN 'old/' ELSE 'keep/' END || CAST(doc_id AS VARCHAR) || '.txt' AS path,
               text AS content FROM docs WHERE lang <> 'de'),
new AS (SELECT source AS commit_hash, CASE WHEN lang = 'fr' THEN 'new/' ELSE 'keep/' END || CAST(doc_id AS VARCHAR) || '.txt' AS path,
               CASE WHEN lang NOT IN ('fr', 'de') AND n_chars > 5000 THEN text || chr(10) || 'extra line'
                    WHEN lang NOT IN ('fr', 'de') AND n_chars >= 3000 THEN regexp_replace(text, '^[^\\n]*', 'REPLACED')
                    ELSE text END AS content
        FROM docs WHERE NOT (lang = 'en' AND n_chars < 300)),
"""
_SNAP_BODY = f"""
j AS (SELECT coalesce(o.commit_hash, n.commit_hash) AS commit_hash, coalesce(o.path, n.path) AS path,
             o.content AS oc, n.content AS nc
      FROM old o FULL OUTER JOIN new n ON o.commit_hash = n.commit_hash AND o.path = n.path
      WHERE o.content IS DISTINCT FROM n.content),
lines AS (
  SELECT commit_hash, path, line, sum(s) AS d FROM (
    SELECT commit_hash, path, unnest(CASE WHEN nc = '' THEN []
             WHEN regexp_matches(nc, '({_TERM})$') THEN list_slice(string_split_regex(nc, '{_TERM}'), 1, -2)
             ELSE string_split_regex(nc, '{_TERM}') END) AS line, 1 AS s
    FROM j WHERE oc IS NOT NULL AND nc IS NOT NULL
    UNION ALL
    SELECT commit_hash, path, unnest(CASE WHEN oc = '' THEN []
             WHEN regexp_matches(oc, '({_TERM})$') THEN list_slice(string_split_regex(oc, '{_TERM}'), 1, -2)
             ELSE string_split_regex(oc, '{_TERM}') END), -1
    FROM j WHERE oc IS NOT NULL AND nc IS NOT NULL) GROUP BY ALL),
changes AS (
  SELECT commit_hash, path, CASE WHEN oc IS NULL THEN 'A' ELSE 'D' END AS change_type,
         CAST(CASE WHEN oc IS NULL THEN
              CASE WHEN nc = '' THEN 0 ELSE len(string_split_regex(nc, '{_TERM}'))
                   - CASE WHEN regexp_matches(nc, '({_TERM})$') THEN 1 ELSE 0 END END ELSE 0 END AS BIGINT) AS additions,
         CAST(CASE WHEN nc IS NULL THEN
              CASE WHEN oc = '' THEN 0 ELSE len(string_split_regex(oc, '{_TERM}'))
                   - CASE WHEN regexp_matches(oc, '({_TERM})$') THEN 1 ELSE 0 END END ELSE 0 END AS BIGINT) AS deletions
  FROM j WHERE oc IS NULL OR nc IS NULL
  UNION ALL
  SELECT j.commit_hash, j.path, 'M',
         CAST(coalesce(sum(greatest(d, 0)), 0) AS BIGINT), CAST(coalesce(sum(greatest(-d, 0)), 0) AS BIGINT)
  FROM j LEFT JOIN lines l ON l.commit_hash = j.commit_hash AND l.path = j.path
  WHERE oc IS NOT NULL AND nc IS NOT NULL GROUP BY j.commit_hash, j.path)
"""
_SNAP_SQL = _SNAP_INPUTS + _SNAP_BODY


_KIND = "CASE WHEN change_type = 'M' THEN 'net' ELSE 'lines' END AS count_kind"


@register("snapshot_diff", _SNAP_SQL + f"SELECT commit_hash, path, change_type, additions, deletions, {_KIND} FROM changes")
def q_snapshot_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    return D.snapshot_diff(old, new)


@register("exact_renames", _SNAP_SQL + """,
ho AS (SELECT commit_hash, path, sha256(content) AS h FROM old),
hn AS (SELECT commit_hash, path, sha256(content) AS h FROM new),
d AS (SELECT c.commit_hash, c.path, ho.h, row_number() OVER (PARTITION BY c.commit_hash, ho.h ORDER BY c.path) AS i
      FROM changes c JOIN ho USING (commit_hash, path) WHERE c.change_type = 'D'),
a AS (SELECT c.commit_hash, c.path, hn.h, row_number() OVER (PARTITION BY c.commit_hash, hn.h ORDER BY c.path) AS i
      FROM changes c JOIN hn USING (commit_hash, path) WHERE c.change_type = 'A'),
pairs AS (SELECT a.commit_hash, a.path, d.path AS old_file_path FROM a JOIN d USING (commit_hash, h, i)),
consumed AS (SELECT commit_hash, path FROM pairs UNION ALL SELECT commit_hash, old_file_path FROM pairs),
rest AS (SELECT c.* FROM changes c ANTI JOIN consumed USING (commit_hash, path)),
unchanged AS (SELECT commit_hash, ho.h, min(ho.path) AS src FROM ho JOIN hn USING (commit_hash, path, h) GROUP BY ALL),
copies AS (SELECT a.commit_hash, a.path, u.src AS old_file_path
           FROM a ANTI JOIN pairs USING (commit_hash, path) JOIN unchanged u ON u.commit_hash = a.commit_hash AND u.h = a.h)
SELECT commit_hash, path, 'R' AS change_type, CAST(0 AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions, old_file_path
FROM pairs
UNION ALL
SELECT r.commit_hash, r.path, CASE WHEN cp.old_file_path IS NOT NULL THEN 'C' ELSE r.change_type END,
       r.additions, r.deletions, cp.old_file_path
FROM rest r LEFT JOIN copies cp USING (commit_hash, path)""")
def q_exact_renames(spark, sf):
    old, new = _snapshots(spark, sf)
    return D.renamed_diff(old, new)


# Every document moves from old/ to new/ in its source's commit: as it is, with another first line, or with two
# lines more. Equal contents pair first; the others by shared lines, the most similar first.
_MOVED_LINES = f"CASE WHEN content = '' THEN [] WHEN regexp_matches(content, '({_TERM})$') THEN list_slice(string_split_regex(content, '{_TERM}'), 1, -2) ELSE string_split_regex(content, '{_TERM}') END"


def _moved(spark, sf):
    docs = td.table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars")
    name, kind = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("n_chars") % 3
    content = (F.when(kind == 0, F.col("text")).when(kind == 1, F.regexp_replace("text", r"^[^\n]*", "REPLACED"))
               .otherwise(F.concat(F.col("text"), F.lit("\nmore\nlines"))))
    side = lambda folder, c: docs.select(F.col("source").alias("commit_hash"), F.concat(F.lit(folder), name).alias("path"), c.alias("content"))
    return side("old/", F.col("text")), side("new/", content)


@register("similar_renames", f"""
WITH RECURSIVE old AS (SELECT source AS commit_hash, 'old/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text AS content FROM documents),
new AS (SELECT source AS commit_hash, 'new/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
               CASE n_chars % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '^[^\n]*', 'REPLACED') ELSE text || chr(10) || 'more' || chr(10) || 'lines' END AS content
        FROM documents),
d AS (SELECT *, sha256(content) AS h, row_number() OVER (PARTITION BY commit_hash, sha256(content) ORDER BY path) AS i FROM old),
a AS (SELECT *, sha256(content) AS h, row_number() OVER (PARTITION BY commit_hash, sha256(content) ORDER BY path) AS i FROM new),
exact AS (SELECT commit_hash, a.path, d.path AS old_path FROM a JOIN d USING (commit_hash, h, i)),
rd AS (SELECT commit_hash, path, h, {_MOVED_LINES} AS ls FROM d ANTI JOIN (SELECT commit_hash, old_path AS path FROM exact) USING (commit_hash, path)),
ra AS (SELECT commit_hash, path, h, {_MOVED_LINES} AS ls FROM a ANTI JOIN exact USING (commit_hash, path)),
ld AS (SELECT commit_hash, h, line, count(*) AS c FROM (SELECT commit_hash, h, unnest(ls) AS line FROM (SELECT DISTINCT commit_hash, h, ls FROM rd)) GROUP BY ALL),
la AS (SELECT commit_hash, h, line, count(*) AS c FROM (SELECT commit_hash, h, unnest(ls) AS line FROM (SELECT DISTINCT commit_hash, h, ls FROM ra)) GROUP BY ALL),
shared AS (SELECT ld.commit_hash, ld.h AS ho, la.h AS hn, CAST(sum(least(ld.c, la.c)) AS BIGINT) AS n FROM ld JOIN la USING (commit_hash, line) GROUP BY ALL),
pairs AS (SELECT rd.commit_hash, rd.path AS old_path, ra.path, len(rd.ls) AS lo, len(ra.ls) AS ln, s.n, s.n * 100 // greatest(len(rd.ls), len(ra.ls)) AS score,
                 row_number() OVER (PARTITION BY rd.commit_hash ORDER BY s.n * 100 // greatest(len(rd.ls), len(ra.ls)) DESC, md5(ho || '/' || hn), rd.path, ra.path) AS i
          FROM shared s JOIN rd ON rd.commit_hash = s.commit_hash AND rd.h = s.ho JOIN ra ON ra.commit_hash = s.commit_hash AND ra.h = s.hn
          WHERE s.n * 100 >= greatest(len(rd.ls), len(ra.ls)) * 50),
walk AS (SELECT commit_hash, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used FROM (SELECT DISTINCT commit_hash FROM pairs)
         UNION ALL
         SELECT w.commit_hash, p.i, CASE WHEN list_contains(w.used, p.old_path) OR list_contains(w.used, p.path) THEN w.used ELSE w.used || [p.old_path, p.path] END
         FROM walk w JOIN pairs p ON p.commit_hash = w.commit_hash AND p.i = w.i + 1),
chosen AS (SELECT p.* FROM pairs p JOIN walk w ON w.commit_hash = p.commit_hash AND w.i = p.i - 1
           WHERE NOT list_contains(w.used, p.old_path) AND NOT list_contains(w.used, p.path))
SELECT commit_hash, path, 'R' AS change_type, CAST(0 AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions, old_path AS old_file_path, 100 AS similarity FROM exact
UNION ALL SELECT commit_hash, path, 'R', CAST(ln - n AS BIGINT), CAST(lo - n AS BIGINT), old_path, CAST(score AS INTEGER) FROM chosen
UNION ALL SELECT commit_hash, path, 'D', CAST(0 AS BIGINT), CAST(len(ls) AS BIGINT), NULL, NULL FROM rd ANTI JOIN (SELECT commit_hash, old_path AS path FROM chosen) USING (commit_hash, path)
UNION ALL SELECT commit_hash, path, 'A', CAST(len(ls) AS BIGINT), CAST(0 AS BIGINT), NULL, NULL FROM ra ANTI JOIN chosen USING (commit_hash, path)""")
def q_similar_renames(spark, sf):
    """JN-6 beyond equal contents: paired 1:1 by the share of lines kept."""
    old, new = _moved(spark, sf)
    return D.similar_renames(D.renamed_diff(old, new), old, new)


# ---- SET-3 ----------------------------------------------------------------------------

def _shifted(spark, sf):
    """Second copy of the history: new hashes, parents reversed, messages padded, times moved
    by 1 s ('O' orders) or 3 s ('F' orders)."""
    heads = td.commit_heads(spark, sf)
    shift = F.when(F.col("commit_message").rlike(r" F\n"), 3).when(F.col("commit_message").rlike(r" O\n"), 1).otherwise(0)
    return heads.select(
        F.concat(F.lit("x"), F.col("commit_hash")).alias("commit_hash"),
        F.reverse("parent_hashes").alias("parent_hashes"),
        "author_name", "author_email", "commit_date",
        (F.col("commit_timestamp") + shift).alias("commit_timestamp"),
        F.concat(F.lit("  "), F.col("commit_message"), F.lit("\n")).alias("commit_message"),
    )


@register("change_set_diff", with_mapping("""
, n AS (SELECT author_name, author_email, commit_message AS message, parents, commit_timestamp AS ts,
               CASE WHEN commit_message LIKE '% F' || chr(10) || '%' THEN 3
                    WHEN commit_message LIKE '% O' || chr(10) || '%' THEN 1 ELSE 0 END AS shift FROM commits)
SELECT 'only_a' AS side, author_name, author_email, message,
       array_to_string(list_sort(string_split(parents, ' ')), ' ') AS parents, ts FROM n WHERE shift > 2
UNION ALL
SELECT 'only_b', author_name, author_email, message,
       array_to_string(list_sort(string_split(parents, ' ')), ' '), ts + shift FROM n WHERE shift > 2"""))
def q_change_set_diff(spark, sf):
    heads = td.commit_heads(spark, sf)
    return D.change_set_diff(heads, _shifted(spark, sf))


# Repeated keys: the history's orders as commits of few natural keys (customer of 7, priority), at
# seconds of a short day; the second set lacks some of them and shifts others by 0 to 3 seconds.
_REPEATED = """
WITH RECURSIVE base AS (
  SELECT o_orderkey AS ok, 'c' || CAST(o_custkey % 7 AS VARCHAR) AS author, o_orderpriority AS message,
         CAST((o_orderkey * 37) % 3000 AS BIGINT) AS ts FROM orders WHERE o_orderstatus <> 'P'),
rows AS (SELECT author, message, ts, 1 AS a, 0 AS b FROM base
         UNION ALL SELECT author, message, ts + (ok % 4), 0, 1 FROM base WHERE ok % 5 <> 0),
sec AS (SELECT author, message, ts, CAST(sum(a) AS BIGINT) AS na, CAST(sum(b) AS BIGINT) AS nb,
               row_number() OVER (PARTITION BY author, message ORDER BY ts) AS i FROM rows GROUP BY author, message, ts),
-- walk through each key's seconds: w2, w1 are the unpaired rows (+ first side, - second) of the two seconds before
walk AS (
  SELECT author, message, i, ts, CAST(0 AS BIGINT) AS t2, CAST(0 AS BIGINT) AS w2, CAST(0 AS BIGINT) AS t1, CAST(0 AS BIGINT) AS w1,
         na - nb AS w0, CAST(0 AS BIGINT) AS lost_ts, CAST(0 AS BIGINT) AS lost FROM sec WHERE i = 1
  UNION ALL
  SELECT author, message, i, ts, t1, v1, t0, v0, CASE WHEN s > 0 THEN na - greatest(0, nb - abs(u2) - abs(u1) - abs(u0))
                                                   WHEN s < 0 THEN greatest(0, na - abs(u2) - abs(u1) - abs(u0)) - nb ELSE na - nb END,
         t2, v2 FROM (
    SELECT *, s * greatest(0, abs(u2) - come) AS x2, s * greatest(0, abs(u1) - greatest(0, come - abs(u2))) AS x1,
           s * greatest(0, abs(u0) - greatest(0, come - abs(u2) - abs(u1))) AS x0,
           CASE WHEN t2 < ts - 2 THEN w2 ELSE s * greatest(0, abs(u2) - come) END AS v2,
           CASE WHEN t1 < ts - 2 THEN w1 ELSE s * greatest(0, abs(u1) - greatest(0, come - abs(u2))) END AS v1,
           CASE WHEN t0 < ts - 2 THEN w0 ELSE s * greatest(0, abs(u0) - greatest(0, come - abs(u2) - abs(u1))) END AS v0
    FROM (SELECT *, CASE WHEN s > 0 THEN nb WHEN s < 0 THEN na ELSE 0 END AS come FROM (
      SELECT *, CASE WHEN u2 + u1 + u0 > 0 THEN 1 WHEN u2 + u1 + u0 < 0 THEN -1 ELSE 0 END AS s FROM (
        SELECT n.author, n.message, n.i, n.ts, n.na, n.nb, w.t2, w.w2, w.t1, w.w1, w.ts AS t0, w.w0,
               CASE WHEN w.t2 < n.ts - 2 THEN 0 ELSE w.w2 END AS u2, CASE WHEN w.t1 < n.ts - 2 THEN 0 ELSE w.w1 END AS u1,
               CASE WHEN w.ts < n.ts - 2 THEN 0 ELSE w.w0 END AS u0
        FROM walk w JOIN sec n ON n.author = w.author AND n.message = w.message AND n.i = w.i + 1))))),
last AS (SELECT * FROM walk w WHERE i = (SELECT max(i) FROM sec n WHERE n.author = w.author AND n.message = w.message)),
lost AS (SELECT author, message, lost_ts AS ts, lost AS n FROM walk UNION ALL SELECT author, message, t2, w2 FROM last
         UNION ALL SELECT author, message, t1, w1 FROM last UNION ALL SELECT author, message, ts, w0 FROM last)
SELECT CASE WHEN n > 0 THEN 'only_a' ELSE 'only_b' END AS side, author AS author_name, author AS author_email, message, '' AS parents, ts
FROM (SELECT author, message, ts, n, unnest(range(abs(n))) AS k FROM lost WHERE n <> 0)
"""


@register("change_set_repeated", _REPEATED)
def q_change_set_repeated(spark, sf):
    """SET-3 where a natural key holds many commits, some missing or shifted on the other side."""
    k, author = F.col("o_orderkey"), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string"))
    base = td.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        k.alias("_k"), k.cast("string").alias("commit_hash"), F.array().cast("array<string>").alias("parent_hashes"),
        author.alias("author_name"), author.alias("author_email"), F.col("o_orderpriority").alias("commit_message"),
        (k * 37 % 3000).cast("bigint").alias("commit_timestamp"))
    other = base.where("_k % 5 <> 0").withColumn("commit_timestamp", F.col("commit_timestamp") + F.col("_k") % 4)
    return D.change_set_diff(base, other)


# ---- JN-4 + JN-5: each commit against its first parent's tree --------------------------
# commit = (conversation, turn), first parent = the previous turn; a commit's tree is three
# files built from its own row: the message, the role, and a per-turn marker file.

def _turn_commits_and_trees(spark, sf):
    conv = td.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    h = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat(F.col("conv_id").cast("string"), F.lit("-"),
                                                (F.col("turn") - 1).cast("string")))
    commits = conv.select(h.alias("commit_hash"), F.filter(F.array(parent), lambda x: x.isNotNull()).alias("parent_hashes"))
    files = F.array(
        F.struct(F.lit("message.txt").alias("path"), F.col("text").alias("content")),
        F.struct(F.lit("role.txt").alias("path"), F.col("role").alias("content")),
        F.struct(F.concat(F.lit("turn-"), F.col("turn").cast("string"), F.lit(".txt")).alias("path"),
                 F.lit("x").alias("content")),
    )
    trees = conv.select(h.alias("commit_hash"), F.inline(files))
    return commits, trees


_TREE_INPUTS = """
WITH t AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS commit_hash,
                  CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) END AS parent,
                  turn, role, text FROM conversations),
trees AS (SELECT commit_hash, 'message.txt' AS path, text AS content FROM t
          UNION ALL SELECT commit_hash, 'role.txt', role FROM t
          UNION ALL SELECT commit_hash, 'turn-' || CAST(turn AS VARCHAR) || '.txt', 'x' FROM t),
old AS (SELECT c.commit_hash, p.path, p.content FROM t c JOIN trees p ON p.commit_hash = c.parent),
new AS (SELECT commit_hash, path, content FROM trees),
"""


@register("tree_changes", _TREE_INPUTS + _SNAP_BODY + f"SELECT commit_hash, path, change_type, additions, deletions, {_KIND} FROM changes")
def q_tree_changes(spark, sf):
    commits, trees = _turn_commits_and_trees(spark, sf)
    return D.tree_changes(commits, trees)
