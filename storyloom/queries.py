"""Registry of the core queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import skew
from .runtime import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "p7_found",
    """
    SELECT 'gdelt_events' AS table_name, source_url FROM gdelt_events GROUP BY source_url
    HAVING source_url IS NOT NULL AND count(*) >= 0.02 * (SELECT count(*) FROM gdelt_events)
    UNION ALL
    SELECT 'root_clusters', source_url FROM root_clusters GROUP BY source_url
    HAVING source_url IS NOT NULL AND sum(event_count) > 0 AND sum(event_count) >= 0.1 * (SELECT sum(event_count) FROM root_clusters)
    """,
)
def p7_found(spark, d):
    rows = skew.heavy_keys(load(spark, d, "gdelt_events"), "source_url", 0.02, value="num_articles")
    events = skew.heavy_keys(load(spark, d, "root_clusters"), "source_url", 0.1, "event_count")
    return rows.select(F.lit("gdelt_events").alias("table_name"), F.col("key").alias("source_url")).union(events.select(F.lit("root_clusters"), "key"))


@query(
    "p7_event_profile",
    """
    WITH f AS (SELECT source_url AS key, num_articles AS value, count(*) AS n FROM gdelt_events WHERE source_url IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT key, sum(n) AS n_rows, coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS n_values, count(value) AS n_distinct, max(n) FILTER (WHERE value IS NOT NULL) AS mode_count FROM f GROUP BY key),
    r AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY value) AS upto FROM f WHERE value IS NOT NULL),
    p AS (SELECT r.key, min(value) FILTER (WHERE n = mode_count) AS mode_value, min(value) FILTER (WHERE upto >= 0.5 * n_values) AS p50, min(value) FILTER (WHERE upto >= 0.9 * n_values) AS p90 FROM r JOIN t USING (key) GROUP BY r.key)
    SELECT t.key AS source_url, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_values AS BIGINT) AS n_values, n_distinct, mode_value, mode_count, p50, p90 FROM t LEFT JOIN p ON t.key = p.key
    """,
)
def p7_event_profile(spark, d):
    return skew.per_key_profile(load(spark, d, "gdelt_events"), "source_url", "num_articles").withColumnRenamed("key", "source_url")


from . import query_pipeline, query_search  # noqa: E402,F401
