"""DuckDB SQL of those queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["p6_found"] = """
WITH v AS (
  SELECT 'themes' AS field, cluster_id, unnest(themes) AS v FROM story_clusters
  UNION ALL SELECT 'mention_identifiers', cluster_id, unnest(mention_identifiers) FROM story_clusters
  UNION ALL SELECT 'distinct_mention_sources', cluster_id, unnest(distinct_mention_sources) FROM story_clusters),
s AS (SELECT DISTINCT field, cluster_id, lower(trim(v)) AS v FROM v WHERE trim(v) <> ''),
n AS (SELECT field, cluster_id, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT a.field, a.cluster_id AS ca, b.cluster_id AS cb, count(*) AS o FROM s a JOIN s b ON a.field = b.field AND a.v = b.v AND a.cluster_id < b.cluster_id GROUP BY ALL)
SELECT o.field, ca AS cluster_id_a, cb AS cluster_id_b FROM o
JOIN n x ON x.field = o.field AND x.cluster_id = ca JOIN n y ON y.field = o.field AND y.cluster_id = cb
WHERE o * 10 >= (x.n + y.n - o) * 7
"""

SQL["p6_story_roots"] = """
WITH a AS (SELECT DISTINCT cluster_id, lower(trim(v)) AS v FROM (SELECT cluster_id, unnest(dominant_event_types) AS v FROM story_clusters) WHERE trim(v) <> ''),
b AS (SELECT DISTINCT cluster_id, lower(trim(v)) AS v FROM (SELECT cluster_id, unnest(dominant_event_types) AS v FROM root_clusters) WHERE trim(v) <> ''),
n AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY 1), m AS (SELECT cluster_id, count(*) AS m FROM b GROUP BY 1),
o AS (SELECT a.cluster_id AS story_id, b.cluster_id AS root_id, count(*) AS o FROM a JOIN b ON a.v = b.v GROUP BY ALL)
SELECT story_id, root_id FROM o JOIN n ON n.cluster_id = story_id JOIN m ON m.cluster_id = root_id WHERE o * 2 >= n + m - o
"""

SQL["p1_found"] = """
WITH RECURSIVE v AS (
  SELECT 'component' AS kind, component_id AS record_id, CAST(CAST(trim(event_id) AS HUGEINT) AS VARCHAR) AS value FROM cluster_component_events WHERE regexp_full_match(trim(event_id), '[+-]?[0-9]{1,30}')
  UNION SELECT 'story', cluster_id, lower(trim(x)) FROM (SELECT cluster_id, unnest(mention_identifiers) AS x FROM story_clusters) WHERE trim(x) <> ''),
e AS (SELECT DISTINCT a.kind, a.record_id AS x, b.record_id AS y FROM v a JOIN v b ON a.kind = b.kind AND a.value = b.value),
reach(kind, a, b) AS (SELECT kind, x, y FROM e UNION SELECT r.kind, r.a, e.y FROM reach r JOIN e ON e.kind = r.kind AND e.x = r.b)
SELECT kind, a AS record_id, min(b) AS group_id FROM reach GROUP BY 1, 2 HAVING count(*) > 1
"""
