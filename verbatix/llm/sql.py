"""DuckDB SQL of the queries that SQL can express, written apart from them."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op13_url_filter"] = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
found AS (SELECT c.page_id, c.host, c.path, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, arg_max(r.verdict, (length(r.host || r.path), length(r.host))) AS ruled
  FROM cut c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY ALL),
listed AS (SELECT host FROM found WHERE ruled IS NOT NULL GROUP BY host HAVING sum(CASE ruled WHEN 'block' THEN 1 ELSE -1 END) > 0)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host <> '' AND host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM found
"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """op11: every round's assignment and means, one after the other."""
    near = """a{n} AS MATERIALIZED (SELECT rid, arg_min(n, (d, n)) AS cluster, min(d) AS d FROM (
  SELECT rid, n, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{n}) GROUP BY rid)"""
    mean = """m{n} AS (SELECT cluster, i, sum(v) AS s, count(*) AS k FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM kept JOIN a{n} USING (rid)) GROUP BY cluster, i),
c{next} AS MATERIALIZED (SELECT n, coalesce(new, c) AS c FROM c{n} LEFT JOIN (SELECT cluster AS n, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS new FROM m{n} GROUP BY cluster) USING (n))"""
    steps = [near.format(n=0)] + [x for r in range(rounds) for x in (mean.format(n=r, next=r + 1), near.format(n=r + 1))]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor(least(greatest(v::DOUBLE * 256, -134217728), 134217728))::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS n, x AS c FROM kept QUALIFY n < {k}),
{("," + chr(10)).join(steps)}
SELECT vec_id, a.cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (rid) JOIN c{rounds} c ON a.cluster = c.n"""


SQL["op11_centroids"] = _clusters()

# every two documents that share a shingle, then all that links reach
SQL["op1_ngram_join"] = r"""
WITH RECURSIVE worded AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM worded),
sizes AS MATERIALIZED (SELECT doc_id, count(s) AS n FROM worded LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT doc_id, n AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = sizes.doc_id) AS component_id FROM sizes"""
