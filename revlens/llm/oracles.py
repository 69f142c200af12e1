"""DuckDB SQL of the queries of this folder that SQL can express."""

from __future__ import annotations

from revlens.llm import centroids, setjoin

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def jaccard(percent: int = setjoin.PERCENT) -> str:
    """All pairs of sets that share a shingle, and reachability by links, row by row."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w),
e AS (SELECT rid, unnest(sh) AS g FROM s),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
l AS (SELECT p.x, p.y FROM p JOIN s a ON a.rid = p.x JOIN s b ON b.rid = p.y WHERE 100 * c >= {percent} * (len(a.sh) + len(b.sh) - c)),
r AS (SELECT rid AS x, rid AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN r ON r.x = s.rid JOIN s o ON o.rid = r.y GROUP BY s.rid, s.doc_id, len(s.sh)"""


def clusters(n: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS, size: int = centroids.SIZE, grid: int = centroids.GRID) -> str:
    """Every round measures all distances in whole numbers."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT v.rid, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} c ON c.i = v.i GROUP BY v.rid, c.k),
a{k} AS MATERIALIZED (SELECT rid, k, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT a.k, v.i, sum(v.x)::BIGINT AS s, count(*) AS n FROM a{k} a JOIN v ON v.rid = a.rid GROUP BY a.k, v.i),
c{k + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.k = c.k AND m.i = c.i)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
v AS MATERIALIZED (SELECT rid, generate_subscripts(embedding, 1) AS i, floor({grid} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
start AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1 AS k FROM kept ORDER BY k LIMIT {n}),
c0 AS MATERIALIZED (SELECT start.k, v.i, v.x FROM start JOIN v ON v.rid = start.rid),
{",\n".join(steps)},
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY k)
SELECT kept.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
FROM a{rounds} a JOIN kept ON kept.rid = a.rid JOIN h ON h.k = a.k"""


ORACLES: dict[str, str] = {"op11_jaccard": jaccard(), "op12_centroids": clusters()}
