"""SQL for those numbered operators that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op3_revisit_resolution"] = r"""
WITH host AS (
  SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^([^/]*//[^/]*)', 1) AS front FROM pages
), record AS (
  SELECT page_id * 3 AS record_id, url, page_id * 10 AS fetched, 200 AS status, md5(html) AS tag,
    [{'n': 'date', 'v': CAST(page_id * 10 AS VARCHAR)}, {'n': 'etag', 'v': md5(html)},
     {'n': 'content-length', 'v': CAST(length(html) AS VARCHAR)}, {'n': 'cache-control', 'v': 'max-age=60'}] AS heads
  FROM host
  UNION ALL
  SELECT page_id * 3 + 1, upper(front) || substr(url, length(front) + 1) || '#seen', page_id * 10 + 1000, 304,
    CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'other'
      WHEN page_id % 3 = 0 THEN 'W/' || md5(html) ELSE md5(html) END AS tag,
    [{'n': 'date', 'v': CAST(page_id * 10 + 1000 AS VARCHAR)}, {'n': 'etag', 'v': tag}, {'n': 'cache-control', 'v': 'max-age=600'}]
  FROM host
  UNION ALL
  SELECT page_id * 3 + 2, 'http://' || host || '/', page_id * 10 + 5, CASE WHEN page_id % 4 = 0 THEN 200 ELSE 304 END,
    md5(host || CAST(page_id // 400 AS VARCHAR)) AS tag,
    CASE WHEN page_id % 4 = 0 THEN
      [{'n': 'date', 'v': CAST(page_id * 10 + 5 AS VARCHAR)}, {'n': 'etag', 'v': tag}, {'n': 'server', 'v': 's'}, {'n': 'vary', 'v': 'accept'}]
    ELSE [{'n': 'date', 'v': CAST(page_id * 10 + 5 AS VARCHAR)}, {'n': 'etag', 'v': tag}, {'n': 'vary', 'v': 'accept-encoding'}] END
  FROM host
), bare AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[hH][tT][tT][pP][sS]?://', '') AS b FROM record
), cut AS (
  SELECT *, regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', '') AS h,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*(.*)$', 1),
      '&utm_[a-z]+=[^&]*', '', 'g'), '[?]utm_[a-z]+=[^&]*&?', '?', 'g'), '[?]$', '') AS r FROM bare
), keyed AS (
  SELECT *, h || regexp_replace(r, '/([?]|$)', '\1', 'g') AS url_key FROM cut
), placed AS (
  SELECT *, last_value(CASE WHEN status = 200 THEN record_id END IGNORE NULLS) OVER (
    PARTITION BY url_key ORDER BY fetched, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refers_to FROM keyed
), judged AS (
  SELECT p.record_id, p.url_key, p.refers_to, p.heads AS fresh, s.heads AS stored,
    CASE WHEN p.refers_to IS NULL THEN 'no response' WHEN p.tag IS NULL THEN 'unverified'
      WHEN regexp_replace(p.tag, '^W/', '') = regexp_replace(s.tag, '^W/', '') THEN 'resolved' ELSE 'changed' END AS verdict
  FROM placed p LEFT JOIN keyed s ON s.record_id = p.refers_to WHERE p.status = 304
)
SELECT record_id, url_key, refers_to, verdict, CASE WHEN verdict = 'resolved' THEN
  array_to_string(list_sort(list_concat(
    [x.n || ': ' || x.v FOR x IN stored IF NOT list_contains([f.n FOR f IN fresh], x.n)],
    [f.n || ': ' || f.v FOR f IN fresh])), chr(10)) END AS headers
FROM judged"""


def _clusters_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Every round as two steps: nearest centroid of each vector, then exact floors of means."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), centre0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {clusters}
)"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT vec_id, any_value(k.v) AS v, min({{'d': CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(k.v, m.v)]) AS BIGINT), 'c': m.c}}) AS best
  FROM kept k CROSS JOIN centre{i} m GROUP BY vec_id
)""")
        if i < rounds:
            steps.append(f"""mean{i} AS MATERIALIZED (
  SELECT c, list(x ORDER BY place) AS v FROM (
    SELECT c, place, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM (
      SELECT best.c AS c, unnest(v) AS x, unnest(range(64)) AS place FROM near{i}) GROUP BY c, place) GROUP BY c
), centre{i + 1} AS MATERIALIZED (
  SELECT c, v FROM mean{i} UNION ALL SELECT c, v FROM centre{i} WHERE c NOT IN (SELECT c FROM mean{i})
)""")
    last = rounds
    return "WITH " + ", ".join(steps) + f"""
SELECT n.vec_id, CAST(n.best.c AS INTEGER) AS cluster, n.best.d AS distance,
  CAST(sum(n.best.d) OVER (PARTITION BY n.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM near{last} n JOIN centre{last} m ON m.c = n.best.c"""


ORACLES["op11_bit_plane_clusters"] = _clusters_sql()
