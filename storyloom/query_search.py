"""Queries of sources, searches, sinks and summaries, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import lookups, scalars
from .operators import graph, quality, search, store
from .queries import query
from .runtime import load
from .sources import articles, feeds

CLUSTERS = ("story_clusters", "root_clusters")


def _ev(spark, d):
    return load(spark, d, "gdelt_events")


def _joined(c):
    return F.array_join(F.col(c), "|").alias(c)


SEVERITY_SQL = "floor(least(CASE quad_class WHEN 2 THEN 2e0 WHEN 3 THEN 5e0 WHEN 4 THEN 10e0 ELSE 0e0 END + greatest(0e0, -coalesce(goldstein_scale, 0e0)) * 5e-1 + abs(coalesce(avg_tone, 0e0)) * 3e-1, 20e0) * 1e2 + 5e-1) / 1e2"


# --- sources -----------------------------------------------------------------------------------------------------------------------------

_MANIFEST_SQL = """
WITH t AS (SELECT DISTINCT date_added AS ts FROM gdelt_events WHERE date_added IS NOT NULL),
m AS (SELECT 'http://feed.example/v2/' || CAST(ts AS VARCHAR) || '.export.CSV.zip' AS url, ts FROM t UNION ALL SELECT 'http://feed.example/v2/' || CAST(ts AS VARCHAR) || '.gkg.csv.zip', ts FROM t)
"""


def _manifest_lines(spark, d):
    ts = _ev(spark, d).filter("date_added is not null").select("date_added").distinct()
    line = lambda kind: F.concat(F.lit("1234 9f0e1d http://feed.example/v2/"), F.col("date_added").cast("string"), F.lit(kind))
    lines = ts.select(line(".export.CSV.zip").alias("value")).union(ts.select(line(".gkg.csv.zip")))
    return lines.union(spark.range(1).select(F.lit("broken line")))


@query("manifest_parse", _MANIFEST_SQL + "SELECT * FROM m")
def manifest_parse(spark, d):
    return feeds.manifest(_manifest_lines(spark, d))


@query("manifest_range", _MANIFEST_SQL + "SELECT * FROM m WHERE url LIKE '%.export.CSV.zip' AND ts BETWEEN 20260205000000 AND 20260207000000")
def manifest_range(spark, d):
    return feeds.manifest_range(feeds.manifest(_manifest_lines(spark, d), "events"), 20260205000000, 20260207000000)


@query("manifest_latest", _MANIFEST_SQL + "SELECT * FROM m WHERE url LIKE '%.gkg.csv.zip' ORDER BY ts DESC LIMIT 1")
def manifest_latest(spark, d):
    return feeds.latest_file(feeds.manifest(_manifest_lines(spark, d), "documents"))


@query("manifest_sidecars", _MANIFEST_SQL + "SELECT a.ts, a.url, b.url AS sidecar_url FROM m a LEFT JOIN m b ON a.ts = b.ts AND b.url LIKE '%.gkg.csv.zip' AND b.ts % 200 = 100 WHERE a.url LIKE '%.export.CSV.zip'")
def manifest_sidecars(spark, d):
    files = feeds.manifest(_manifest_lines(spark, d))
    mine, other = feeds.manifest(_manifest_lines(spark, d), "events"), feeds.manifest(_manifest_lines(spark, d), "documents")
    return feeds.sidecars(mine, other.filter("ts % 200 = 100")).select("ts", "url", "sidecar_url") if files else None


_EVENT_FIELDS = [(n, at) for n, at, _ in feeds.EVENT_COLUMNS]


def _event_lines(spark, d):
    """Events written as rows of the feed, some of them cut short or with text where a number belongs."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    at = {p: n for n, p in _EVENT_FIELDS}
    bad = F.when(F.col("global_event_id") % 97 == 0, "many").otherwise(text("num_mentions"))
    cells = [bad if at.get(i) == "num_mentions" else F.concat(F.lit(" "), text(at[i])) if i in (7, 17) else text(at[i]) if i in at else F.lit("") for i in range(61)]
    line = F.concat_ws("\t", *cells)
    return _ev(spark, d).select(F.when(F.col("global_event_id") % 89 == 0, F.substring_index(line, "\t", 40)).otherwise(line).alias("line"))


@query(
    "parse_events",
    """
    SELECT global_event_id, sql_date, actor1_country_code, actor2_country_code, event_code, event_base_code, event_root_code, quad_class, goldstein_scale, num_mentions, num_sources, num_articles, avg_tone, action_geo_full_name,
      CASE WHEN length(action_geo_country_code) <= 2 THEN upper(action_geo_country_code) END AS action_geo_country_code, date_added, source_url
    FROM (SELECT * REPLACE (upper(actor1_country_code) AS actor1_country_code, upper(actor2_country_code) AS actor2_country_code) FROM gdelt_events)
    WHERE global_event_id % 97 <> 0 AND global_event_id % 89 <> 0 AND sql_date IS NOT NULL AND date_added IS NOT NULL
    """,
)
def parse_events(spark, d):
    return feeds.parse_rows(feeds.columns_of(_event_lines(spark, d)), "events")


@query(
    "parse_mentions",
    "SELECT global_event_id, event_time_date, mention_time_date, mention_type, mention_source_name, trim(mention_identifier) AS mention_identifier, mention_doc_len, mention_doc_tone FROM gdelt_mentions WHERE global_event_id IS NOT NULL",
)
def parse_mentions(spark, d):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    at = {p: n for n, p, _ in feeds.MENTION_COLUMNS}
    line = F.concat_ws("\t", *(text(at[i]) if i in at else F.lit("") for i in range(14)))
    return feeds.parse_rows(feeds.columns_of(load(spark, d, "gdelt_mentions").select(line.alias("line"))), "mentions")


@query(
    "parse_gkg",
    """
    SELECT CAST(id AS VARCHAR) AS gkg_record_id, source_url AS document_identifier,
      array_to_string(list_filter(list_transform(themes, lambda x: trim(x)), lambda x: x <> ''), '|') AS themes, array_to_string(list_filter(list_transform(persons, lambda x: trim(x)), lambda x: x <> ''), '|') AS persons, document_tone_avg AS document_tone
    FROM (SELECT * REPLACE (coalesce(list_filter(themes, lambda x: x IS NOT NULL), []) AS themes, coalesce(list_filter(persons, lambda x: x IS NOT NULL), []) AS persons) FROM story_clusters)
    """,
)
def parse_gkg(spark, d):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    many = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ";")
    cells = {0: text("id"), 4: text("source_url"), 7: many("themes"), 11: many("persons"), 15: F.concat(text("document_tone_avg"), F.lit(",1.2,2.3"))}
    line = F.concat_ws("\t", *(cells.get(i, F.lit("")) for i in range(27)))
    rows = feeds.parse_documents(feeds.columns_of(load(spark, d, "story_clusters").select(line.alias("line"))))
    return rows.select("gkg_record_id", "document_identifier", _joined("themes"), _joined("persons"), "document_tone")


@query("article_extract")
def article_extract(spark, d):
    return articles.extract_articles(load(spark, d, "article_html_payloads").select("page_id", "html"))


@query("window_events", "SELECT global_event_id, date_added, source_url FROM gdelt_events WHERE date_added >= 20260210000000 AND date_added <= 20260212000000 AND source_url IS NOT NULL")
def window_events(spark, d):
    return graph.window_events(_ev(spark, d), 20260210000000, 20260212000000).select("global_event_id", "date_added", "source_url")


@query("mentions_by_events", "SELECT id, global_event_id, mention_identifier FROM gdelt_mentions WHERE global_event_id IN (SELECT global_event_id FROM gdelt_events WHERE date_added BETWEEN 20260210000000 AND 20260212000000 AND source_url IS NOT NULL)")
def mentions_by_events(spark, d):
    return graph.mentions_of(load(spark, d, "gdelt_mentions"), graph.window_events(_ev(spark, d), 20260210000000, 20260212000000)).select("id", "global_event_id", "mention_identifier")


@query("gkg_by_documents", "SELECT id, source_url FROM story_clusters WHERE source_url IN (SELECT source_url FROM gdelt_events WHERE date_added >= 20260215000000)")
def gkg_by_documents(spark, d):
    wanted = graph.window_events(_ev(spark, d), 20260215000000).select("source_url").distinct()
    return load(spark, d, "story_clusters").join(wanted, "source_url", "left_semi").select("id", "source_url")


@query("events_by_urls", "SELECT source_url, string_agg(CAST(global_event_id AS VARCHAR), '|' ORDER BY date_added, global_event_id) AS ids FROM gdelt_events WHERE date_added >= 20260215000000 AND source_url IN (SELECT source_url FROM root_clusters) GROUP BY 1")
def events_by_urls(spark, d):
    ev = graph.window_events(_ev(spark, d), 20260215000000).join(load(spark, d, "root_clusters").select("source_url").distinct(), "source_url", "left_semi")
    rows = F.array_sort(F.collect_list(F.struct("date_added", "global_event_id")))
    return ev.groupBy("source_url").agg(F.array_join(F.transform(rows, lambda x: x["global_event_id"].cast("string")), "|").alias("ids"))


# --- event search ------------------------------------------------------------------------------------------------------------------------

_PAGE = "global_event_id, date_added, source_url"
_ORDER = " ORDER BY date_added DESC NULLS FIRST, global_event_id, source_url NULLS FIRST"
_SEARCHES = {
    "event_search_all": ({}, "TRUE"),
    "event_search_date": ({"date_from": 20260210, "date_to": 20260214}, "sql_date BETWEEN 20260210 AND 20260214"),
    "event_search_actor": ({"actor1": "USA", "actor2": ["GBR", "FRA", "ITA", "DEU", "NLD", "ESP", "SPA"]}, "actor1_country_code = 'USA' AND actor2_country_code IN ('GBR','FRA','ITA','DEU','NLD','ESP','SPA')"),
    "event_search_geo": ({"geo_countries": ["UK", "US"]}, "action_geo_country_code IN ('UK','US')"),
    "event_search_codes": ({"event_codes": ["043", "06", "135"], "root_codes": ["04", "13"]}, "event_code IN ('043','06','135') AND event_root_code IN ('04','13')"),
    "event_search_quad": ({"quad_classes": [3, 4]}, "quad_class IN (3, 4)"),
    "event_search_goldstein_tone": ({"goldstein_min": -5.0, "goldstein_max": 0.5, "tone_min": -4.0, "tone_max": 1.0}, "goldstein_scale BETWEEN -5.0 AND 0.5 AND avg_tone BETWEEN -4.0 AND 1.0"),
    "event_search_impact": ({"min_mentions": 10, "min_sources": 2, "min_articles": 8}, "num_mentions >= 10 AND num_sources >= 2 AND num_articles >= 8"),
    "event_search_strict": ({"base_codes": ["043", "135"], "source_domains": ["newsgrid.example"], "strict": True}, "event_base_code IN ('043','135') AND regexp_replace(lower(regexp_extract(source_url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') = 'newsgrid.example'"),
    "event_search_combined": ({"date_from": 20260201, "date_to": 20260225, "quad_classes": [1, 3], "tone_max": 0.0, "min_mentions": 2}, "sql_date BETWEEN 20260201 AND 20260225 AND quad_class IN (1, 3) AND avg_tone <= 0 AND num_mentions >= 2"),
}


def _search(kw, offset=0):
    return lambda spark, d: search.search_events(_ev(spark, d), search.EventFilters(**kw), 100, offset).select("global_event_id", "date_added", "source_url")


for _name, (_kw, _where) in _SEARCHES.items():
    query(_name, f"SELECT {_PAGE} FROM gdelt_events WHERE {_where}{_ORDER} LIMIT 100")(_search(_kw))
query("event_search_page2", f"SELECT {_PAGE} FROM gdelt_events WHERE quad_class IN (3, 4){_ORDER} LIMIT 100 OFFSET 100")(_search({"quad_classes": [3, 4]}, 100))


@query("event_search_count", "SELECT count(global_event_id) AS total FROM gdelt_events WHERE sql_date BETWEEN 20260201 AND 20260225 AND quad_class IN (1, 3) AND avg_tone <= 0 AND num_mentions >= 2")
def event_search_count(spark, d):
    return search.count_events(_ev(spark, d), search.EventFilters(**_SEARCHES["event_search_combined"][0]))


@query("event_search_request", "SELECT count(global_event_id) AS total FROM gdelt_events WHERE sql_date BETWEEN 20250101 AND 20261231 AND action_geo_country_code IN ('GM','UK') AND actor1_country_code = 'USA'")
def event_search_request(spark, d):
    request = {"countries": ["Germany", "uk", "Nowhere"], "actors": {"actor1_country": "united states"}, "date_range": {"from": 2025, "to": 2026}}
    return search.count_events(_ev(spark, d), search.request_to_filters(request))


@query(
    "event_projection",
    """
    SELECT CAST(global_event_id AS VARCHAR) AS event_id, CASE WHEN length(CAST(sql_date AS VARCHAR)) = 8 THEN substr(CAST(sql_date AS VARCHAR), 1, 4) || '-' || substr(CAST(sql_date AS VARCHAR), 5, 2) || '-' || substr(CAST(sql_date AS VARCHAR), 7, 2) ELSE CAST(sql_date AS VARCHAR) END AS event_date,
      nullif(actor1_country_code, '') AS actor1_country_code, nullif(actor2_country_code, '') AS actor2_country_code, nullif(event_code, '') AS event_code, nullif(event_root_code, '') AS event_root_code, nullif(action_geo_full_name, '') AS action_geo_full_name, nullif(action_geo_country_code, '') AS action_geo_country_code, nullif(source_url, '') AS source_url,
      quad_class, goldstein_scale, avg_tone, num_mentions, num_sources, num_articles, nullif(regexp_replace(lower(regexp_extract(source_url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', ''), '') AS source_name
    FROM gdelt_events WHERE global_event_id IS NOT NULL
    """,
)
def event_projection(spark, d):
    return search.event_view(_ev(spark, d))


# --- cluster search ----------------------------------------------------------------------------------------------------------------------

_CLUSTER_SEARCHES = {
    "cluster_search_score": ({"min_score": 2.0}, "topic_score >= 2.0"),
    "cluster_search_counts": ({"min_events": 5, "min_mentions": 3}, "event_count >= 5 AND mention_count >= 3"),
    "cluster_search_dates": ({"date_from": 20260205, "date_to": 20260215}, "event_date_ref_start BETWEEN 20260205 AND 20260215"),
    "cluster_search_mentions_window": ({"mentioned_from": "2026-02-10 00:00:00", "mentioned_to": "2026-02-20 00:00:00"}, "first_mention_at >= TIMESTAMPTZ '2026-02-10 00:00:00+00' AND last_mention_at <= TIMESTAMPTZ '2026-02-20 00:00:00+00'"),
    "cluster_search_status": ({"status": "success"}, "enrichment_status = 'success'"),
    "cluster_search_contains_country": ({"country": "US"}, "list_contains(dominant_countries, 'US')"),
    "cluster_search_contains_type": ({"event_type": "Protest"}, "list_contains(dominant_event_types, 'Protest')"),
    "cluster_search_contains_quad": ({"quad_class": "Verbal conflict"}, "list_contains(dominant_quad_classes, 'Verbal conflict')"),
    "cluster_search_contains_theme": ({"theme": "GOV_UNION"}, "list_contains(themes, 'GOV_UNION')"),
    "cluster_search_contains_keyword": ({"keyword": "harbour"}, "list_contains(keywords, 'harbour')"),
    "cluster_search_contains_topic": ({"topic": "elections"}, "list_contains(main_topics, 'elections')"),
}


def _cluster_search(table, kw, most=None):
    return lambda spark, d: search.search_clusters(load(spark, d, table), search.ClusterFilters(**kw), 100, 0, most=most).select("cluster_id", "topic_score", "event_count")


for _name, (_kw, _where) in _CLUSTER_SEARCHES.items():
    query(_name, f"SELECT cluster_id, topic_score, event_count FROM story_clusters WHERE {_where} ORDER BY topic_score DESC NULLS FIRST, cluster_id LIMIT 100")(_cluster_search("story_clusters", _kw))
query("root_cluster_search", "SELECT cluster_id, topic_score, event_count FROM root_clusters WHERE topic_score >= 5.0 AND list_contains(dominant_countries, 'US') ORDER BY topic_score DESC NULLS FIRST, cluster_id LIMIT 100")(_cluster_search("root_clusters", {"min_score": 5.0, "country": "US"}, 500))


@query("cluster_search_total", "SELECT count(*) AS total FROM story_clusters WHERE topic_score >= 1.5 AND list_contains(dominant_countries, 'US')")
def cluster_search_total(spark, d):
    return search.count_clusters(load(spark, d, "story_clusters"), search.ClusterFilters(min_score=1.5, country="US"))


@query("cluster_view", "SELECT cluster_id, topic_score, array_to_string(dominant_countries, '|') AS countries, document_tone_avg AS tone FROM story_clusters")
def cluster_view(spark, d):
    v = search.cluster_view(load(spark, d, "story_clusters"))
    return v.select("cluster_id", "score.topic_score", F.array_join("events.dominant_countries", "|").alias("countries"), F.col("documents.document_tone_avg").alias("tone"))


@query("pending_clusters", "SELECT cluster_id, topic_score FROM story_clusters WHERE enrichment_status = 'pending' ORDER BY topic_score DESC NULLS LAST, cluster_id LIMIT 50")
def pending_clusters(spark, d):
    return search.search_clusters(load(spark, d, "story_clusters"), search.ClusterFilters(status="pending"), 50, nulls_first=False).select("cluster_id", "topic_score")


@query("article_urls", "WITH x AS (SELECT cluster_id, unnest(list_append(coalesce(mention_identifiers, []), source_url)) AS url, generate_subscripts(list_append(coalesce(mention_identifiers, []), source_url), 1) AS pos FROM story_clusters), y AS (SELECT *, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)) AS dom FROM x WHERE url IS NOT NULL AND url <> ''), z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, dom ORDER BY pos) AS n FROM y), r AS (SELECT cluster_id, url, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS rank FROM z WHERE n = 1) SELECT cluster_id, url, rank FROM r WHERE rank <= 3")
def article_urls(spark, d):
    return articles.ranked_urls(load(spark, d, "story_clusters"))


# --- sinks -------------------------------------------------------------------------------------------------------------------------------


@query("insert_ignore_events", "WITH a AS (SELECT DISTINCT global_event_id FROM gdelt_events WHERE date_added < 20260215000000), n AS (SELECT global_event_id, date_added, row_number() OVER (PARTITION BY global_event_id ORDER BY date_added, source_url NULLS LAST) AS k FROM gdelt_events WHERE date_added >= 20260215000000) SELECT global_event_id, 0 AS date_added FROM a UNION ALL SELECT global_event_id, date_added FROM n WHERE k = 1 AND global_event_id NOT IN (SELECT global_event_id FROM a)")
def insert_ignore_events(spark, d):
    ev = _ev(spark, d)
    table = ev.filter("date_added < 20260215000000").select("global_event_id", F.lit(0).cast("long").alias("date_added")).distinct()
    batch = ev.filter("date_added >= 20260215000000").select("global_event_id", "date_added", "source_url")
    return store.insert_ignore(table, batch, "global_event_id", ["date_added", "source_url"])


@query("upsert_clusters", "SELECT coalesce(o.cluster_id, n.cluster_id) AS cluster_id, CASE WHEN n.cluster_id IS NOT NULL THEN n.event_count ELSE o.event_count END AS event_count, CASE WHEN o.cluster_id IS NOT NULL THEN o.enrichment_status ELSE n.enrichment_status END AS enrichment_status, o.article_title FROM (SELECT * FROM story_clusters) o FULL OUTER JOIN (SELECT cluster_id, event_count + 1 AS event_count, 'pending' AS enrichment_status FROM story_clusters WHERE event_count > 5 UNION ALL SELECT cluster_id, event_count + 1, 'pending' FROM root_clusters) n ON o.cluster_id = n.cluster_id")
def upsert_clusters(spark, d):
    table = load(spark, d, "story_clusters").select("cluster_id", "event_count", "enrichment_status", "article_title")
    new = table.filter("event_count > 5").select("cluster_id", "event_count").union(load(spark, d, "root_clusters").select("cluster_id", "event_count"))
    batch = new.select("cluster_id", (F.col("event_count") + 1).alias("event_count"), F.lit("pending").alias("enrichment_status"))
    return store.upsert(table, batch, "cluster_id", ["enrichment_status"])


@query("delete_clusters", "SELECT cluster_id FROM story_clusters WHERE source_url NOT IN (SELECT source_url FROM root_clusters)")
def delete_clusters(spark, d):
    return store.delete_keys(load(spark, d, "story_clusters").select("cluster_id", "source_url"), load(spark, d, "root_clusters"), "source_url").select("cluster_id")


for _name, _table, _col, _cut in (("retention_events", "gdelt_events", "sql_date", 20260210), ("retention_mentions", "gdelt_mentions", "mention_time_date", 20260210000000), ("retention_documents", "documents", "date_added", 20260210000000)):

    def _retain(spark, d, table=_table, col=_col, cut=_cut):
        return store.retain(load(spark, d, table), col, cut).groupBy(col).agg(F.count("*").alias("rows"))

    query(_name, f"SELECT {_col}, count(*) AS rows FROM {_table} WHERE {_col} >= {_cut} OR {_col} IS NULL GROUP BY 1")(_retain)


@query("status_change", "SELECT cluster_id, CASE WHEN event_count > 5 AND enrichment_status IN ('pending') THEN 'processing' ELSE enrichment_status END AS enrichment_status FROM story_clusters")
def status_change(spark, d):
    c = load(spark, d, "story_clusters").select("cluster_id", "event_count", "enrichment_status")
    updates = c.filter("event_count > 5").select("cluster_id", F.lit("processing").alias("new_status"))
    return store.change_status(c, "cluster_id", updates, ["pending"]).select("cluster_id", "enrichment_status")


# --- summaries ---------------------------------------------------------------------------------------------------------------------------


@query("latest_timestamps", "SELECT max(sql_date) AS latest_sql_date, max(date_added) AS latest_date_added, count(global_event_id) AS event_count FROM gdelt_events")
def latest_timestamps(spark, d):
    return quality.latest_stamps(_ev(spark, d))


@query("top_countries", "SELECT action_geo_country_code AS code, count(*) AS count FROM gdelt_events WHERE sql_date >= 20260205 AND action_geo_country_code <> '' GROUP BY 1 ORDER BY count DESC, code LIMIT 20")
def top_countries(spark, d):
    return quality.top_since(_ev(spark, d), "action_geo_country_code", 20260205)


_EN = "CASE event_root_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookups.ROOT_LABELS_EN.items()) + " ELSE event_root_code END"


@query("top_root_codes", f"SELECT event_root_code AS code, count(*) AS count, {_EN} AS label FROM gdelt_events WHERE sql_date >= 20260205 AND event_root_code <> '' GROUP BY 1, 3 ORDER BY count DESC, code LIMIT 20")
def top_root_codes(spark, d):
    return quality.top_root_codes(_ev(spark, d), 20260205)


@query("status_counts", "SELECT enrichment_status, count(*) AS count FROM gdelt_events GROUP BY 1")
def status_counts(spark, d):
    return _ev(spark, d).groupBy("enrichment_status").count()


@query("qm_median_score", "SELECT quantile_cont(topic_score, 0.5) AS median FROM story_clusters")
def qm_median_score(spark, d):
    return load(spark, d, "story_clusters").agg(F.percentile("topic_score", 0.5).alias("median"))


@query("qm_score_quintiles", "SELECT quintile, count(*) AS clusters, min(topic_score) AS lowest, max(topic_score) AS highest FROM (SELECT topic_score, ntile(5) OVER (ORDER BY topic_score, cluster_id) AS quintile FROM story_clusters WHERE topic_score IS NOT NULL) GROUP BY 1")
def qm_score_quintiles(spark, d):
    return quality.score_quintiles(load(spark, d, "story_clusters"))


@query("qm_duplicate_ids", "SELECT global_event_id, count(*) AS n FROM gdelt_events GROUP BY 1 HAVING count(*) > 1")
def qm_duplicate_ids(spark, d):
    return quality.duplicate_ids(_ev(spark, d), "global_event_id")


@query("qm_daily_volume", "SELECT sql_date, count(*) AS events, count(DISTINCT global_event_id) AS distinct_events FROM gdelt_events GROUP BY 1")
def qm_daily_volume(spark, d):
    return quality.daily_volume(_ev(spark, d))


@query("qm_theme_counts", "SELECT value, count(*) AS clusters FROM (SELECT DISTINCT cluster_id, unnest(themes) AS value FROM story_clusters) WHERE value IS NOT NULL GROUP BY 1 ORDER BY clusters DESC, value LIMIT 20")
def qm_theme_counts(spark, d):
    return quality.item_counts(load(spark, d, "story_clusters"), "themes")


@query("qm_cluster_shares", "SELECT count(*) AS clusters, count(*) FILTER (WHERE event_count < 2) AS under_two_events, count(*) FILTER (WHERE coalesce(len(themes), 0) = 0) AS without_themes, count(*) FILTER (WHERE coalesce(len(persons), 0) > 0) AS with_persons, min(avg_severity_score) AS severity_min, max(avg_severity_score) AS severity_max, min(document_tone_avg) AS tone_min, max(document_tone_avg) AS tone_max, count(*) FILTER (WHERE first_mention_at IS NULL) AS without_mention, count(*) FILTER (WHERE topic_score < 3.6) AS under_score FROM story_clusters")
def qm_cluster_shares(spark, d):
    n = lambda c, name: F.count_if(c).alias(name)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return load(spark, d, "story_clusters").agg(
        F.count("*").alias("clusters"), n(F.col("event_count") < 2, "under_two_events"), n(size("themes") <= 0, "without_themes"), n(size("persons") > 0, "with_persons"), F.min("avg_severity_score").alias("severity_min"), F.max("avg_severity_score").alias("severity_max"),
        F.min("document_tone_avg").alias("tone_min"), F.max("document_tone_avg").alias("tone_max"), n(F.col("first_mention_at").isNull(), "without_mention"), n(F.col("topic_score") < 3.6, "under_score"),
    )


@query("qm_document_linkage", "SELECT count(*) AS clusters, count(*) FILTER (WHERE source_url IN (SELECT mention_identifier FROM gdelt_mentions)) AS linked FROM story_clusters")
def qm_document_linkage(spark, d):
    seen = load(spark, d, "gdelt_mentions").select(F.col("mention_identifier").alias("source_url"), F.lit(True).alias("seen")).distinct()
    return load(spark, d, "story_clusters").join(seen, "source_url", "left").agg(F.count("*").alias("clusters"), F.count_if(F.coalesce("seen", F.lit(False))).alias("linked"))


@query(
    "scalar_functions",
    f"SELECT global_event_id, date_added, {SEVERITY_SQL} AS severity, coalesce(CASE quad_class "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in lookups.QUAD_LABELS.items()) + f" END, '{lookups.UNKNOWN}') AS quad, coalesce(CASE event_root_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookups.ROOT_LABELS.items())
    + f" END, '{lookups.UNKNOWN}') AS root, lower(split_part(split_part(source_url, '//', 2), '/', 1)) AS domain, try_strptime(CAST(date_added AS VARCHAR), '%Y%m%d%H%M%S') AS at FROM gdelt_events",
)
def scalar_functions(spark, d):
    return _ev(spark, d).select("global_event_id", "date_added", scalars.severity("quad_class", "goldstein_scale", "avg_tone").alias("severity"), lookups.quad_label("quad_class").alias("quad"), lookups.root_label("event_root_code").alias("root"), scalars.domain_plain("source_url").alias("domain"), scalars.stamp("date_added").alias("at"))


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, strptime(CAST(date_added AS VARCHAR), '%Y%m%d%H%M%S')) AS window_start, event_root_code, count(*) AS events FROM gdelt_events WHERE date_added IS NOT NULL GROUP BY 1, 2")
def windowed_counts(spark, d):
    from .streaming.ingest import windowed_counts as counts

    return counts(_ev(spark, d))
