"""Queries of the graph, cluster, merge and reconciliation operators, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import lookups, scalars
from .operators import clusters as cl
from .operators import graph, merge, reconcile, store
from .plans import pipeline
from .queries import query
from .query_search import SEVERITY_SQL
from .runtime import durable, large_side, load
from .settings import BLOCKED_DOMAINS, SECTION_PARTS

WIDE = pipeline.wide()

# --- the latest window and its graph ------------------------------------------------------------------------------------------------------

_BAD = "lower(split_part(split_part(mention_identifier, '//', 2), '/', 1)) IN (" + ", ".join(f"'{x}'" for x in BLOCKED_DOMAINS) + ") OR " + " OR ".join(f"contains(lower(mention_identifier), '{x}')" for x in SECTION_PARTS)
_NET = "lower(regexp_extract(source_url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1))"
_WINDOW = f"""
w AS (SELECT max(date_added) AS hi, CAST(strftime(strptime(CAST(max(date_added) AS VARCHAR), '%Y%m%d%H%M%S') - INTERVAL 36 HOUR, '%Y%m%d%H%M%S') AS BIGINT) AS lo FROM gdelt_events),
ev AS (SELECT e.* FROM gdelt_events e, w WHERE date_added BETWEEN lo AND hi AND source_url IS NOT NULL),
me AS (SELECT * FROM gdelt_mentions WHERE global_event_id IN (SELECT global_event_id FROM ev)),
mn AS (SELECT * FROM me WHERE mention_identifier <> '' AND NOT ({_BAD})),
ed AS (SELECT DISTINCT global_event_id AS event_id, mention_identifier AS mention_url FROM mn)
"""
_COMPONENTS = f"""
{_WINDOW},
reach(a, b) AS (SELECT DISTINCT event_id, event_id FROM ed UNION SELECT r.a, y.event_id FROM reach r JOIN ed x ON x.event_id = r.b JOIN ed y ON y.mention_url = x.mention_url),
lab AS (SELECT a AS event_id, min(b) AS component FROM reach GROUP BY a),
co AS (SELECT component, event_id FROM lab WHERE component IN (SELECT component FROM lab GROUP BY 1 HAVING count(*) >= 2)),
met AS (
  SELECT c.component, count(DISTINCT c.event_id) AS events, count(DISTINCT source_url) AS source_urls, count(DISTINCT nullif({_NET}, '')) AS domains,
    coalesce((epoch(max(strptime(CAST(date_added AS VARCHAR), '%Y%m%d%H%M%S'))) - epoch(min(strptime(CAST(date_added AS VARCHAR), '%Y%m%d%H%M%S')))) / 3600e0, 0e0) AS span_hours
  FROM co c JOIN ev e ON e.global_event_id = c.event_id GROUP BY 1),
met2 AS (SELECT m.*, x.mention_urls, x.edges, x.edges / (CAST(m.events AS DOUBLE) * x.mention_urls) AS density FROM met m JOIN (SELECT component, count(DISTINCT mention_url) AS mention_urls, count(*) AS edges FROM co JOIN ed USING (event_id) GROUP BY 1) x USING (component))
"""
_FIRST = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY global_event_id ORDER BY date_added, source_url NULLS LAST, num_mentions NULLS LAST, num_articles NULLS LAST) AS k FROM ev) WHERE k = 1)"
_MEMBERS = f"{_COMPONENTS}, {_FIRST}, ad AS (SELECT component FROM met2 WHERE events >= 2 AND source_urls >= 2 AND domains >= 2 AND span_hours <= 336), mem AS (SELECT c.component, o.* FROM co c JOIN ad USING (component) JOIN one o ON o.global_event_id = c.event_id)"


def _t(spark, d, name):
    return load(spark, d, name)


def _window(spark, d):
    ev = _t(spark, d, "gdelt_events")
    return graph.window_events(ev, *(graph.latest_window(ev) or (0, 0)))


def _edges(spark, d):
    return graph.component_edges(_window(spark, d), _t(spark, d, "gdelt_mentions"))


def _components(spark, d):
    edges = durable(_edges(spark, d))
    return durable(graph.event_components(edges)), edges


def _documents(spark, d):
    """The stories as a document layer: their mention addresses with their lists."""
    s = _t(spark, d, "story_clusters")
    return s.select(F.explode("mention_identifiers").alias("document_identifier"), "themes", "persons", "organizations", F.col("gkg_locations").alias("locations"), F.col("document_tone_avg").alias("document_tone"))


def _built(spark, d):
    ev, (components, edges) = _window(spark, d), _components(spark, d)
    ok = graph.gates(graph.component_metrics(components, edges, ev), WIDE).filter("admitted").select("component")
    spoken = graph.mention_nodes(graph.mentions_of(_t(spark, d, "gdelt_mentions"), ev))
    return cl.build_clusters(components.join(ok, "component", "left_semi"), ev, spoken, _documents(spark, d), "component", WIDE)


@query("mention_filter", f"WITH {_WINDOW} SELECT id, mention_identifier FROM mn")
def mention_filter(spark, d):
    return graph.mention_nodes(graph.mentions_of(_t(spark, d, "gdelt_mentions"), _window(spark, d))).select("id", "mention_identifier")


@query("component_edges", f"WITH {_WINDOW} SELECT event_id, mention_url FROM ed")
def component_edges(spark, d):
    return _edges(spark, d)


@query("connected_components", f"WITH RECURSIVE {_COMPONENTS} SELECT component, event_id FROM co")
def connected_components(spark, d):
    return _components(spark, d)[0]


@query("component_metrics", f"WITH RECURSIVE {_COMPONENTS} SELECT component, events, mention_urls, edges, source_urls, domains, density, span_hours FROM met2")
def component_metrics(spark, d):
    components, edges = _components(spark, d)
    return graph.component_metrics(components, edges, _window(spark, d))


@query("component_gates", f"WITH RECURSIVE {_COMPONENTS} SELECT component, concat_ws('|', CASE WHEN events < 2 THEN 'min_event_ids' END, CASE WHEN source_urls < 2 THEN 'min_source_urls' END, CASE WHEN domains < 2 THEN 'min_domains' END, CASE WHEN span_hours > 24 THEN 'max_event_span_hours' END) AS failed_gates FROM met2")
def component_gates(spark, d):
    return graph.gates(component_metrics(spark, d)).select("component", F.array_join("failed_gates", "|").alias("failed_gates"))


@query("admitted_components", f"WITH RECURSIVE {_COMPONENTS} SELECT component FROM met2 WHERE events >= 2 AND source_urls >= 2 AND domains >= 2 AND span_hours <= 336")
def admitted_components(spark, d):
    return graph.gates(component_metrics(spark, d), WIDE).filter("admitted").select("component")


@query(
    "cluster_build",
    f"""
    WITH RECURSIVE {_MEMBERS},
    sp AS (SELECT c.component, count(DISTINCT mention_identifier) AS mention_count, min(strptime(CAST(mention_time_date AS VARCHAR), '%Y%m%d%H%M%S')) AS first_mention_at, max(strptime(CAST(mention_time_date AS VARCHAR), '%Y%m%d%H%M%S')) AS last_mention_at FROM co c JOIN mn ON mn.global_event_id = c.event_id GROUP BY 1)
    SELECT component, substr(sha256(string_agg(CAST(global_event_id AS VARCHAR), ',' ORDER BY global_event_id)), 1, 24) AS cluster_id, min(source_url) AS source_url, count(*) AS event_count, CAST(sum(coalesce(num_articles, 0)) AS BIGINT) AS num_articles, CAST(sum(coalesce(num_mentions, 0)) AS BIGINT) AS num_mentions,
      CAST(sum(coalesce(num_sources, 0)) AS BIGINT) AS num_sources, string_agg(CAST(global_event_id AS VARCHAR), '|' ORDER BY global_event_id) AS event_ids, min(sql_date) AS event_date_ref_start, max(sql_date) AS event_date_ref_end,
      round(CAST(sum(CAST({SEVERITY_SQL} AS DECIMAL(20,2))) AS DOUBLE) / count(*), 2) AS avg_severity_score, round(0.5 * ln(count(*) + 1.0) + 0.3 * ln(count(DISTINCT source_url) + 1.0) + 0.2 * ln(count(DISTINCT nullif({_NET}, '')) + 1.0), 4) AS topic_score,
      any_value(sp.mention_count) AS mention_count, any_value(sp.first_mention_at) AS first_mention_at, any_value(sp.last_mention_at) AS last_mention_at
    FROM mem LEFT JOIN sp USING (component) GROUP BY component
    """,
)
def cluster_build(spark, d):
    names = ("component", "cluster_id", "source_url", "event_count", "num_articles", "num_mentions", "num_sources", "event_date_ref_start", "event_date_ref_end", "avg_severity_score", "topic_score", "mention_count", "first_mention_at", "last_mention_at")
    return _built(spark, d).select(*names, F.array_join("event_ids", "|").alias("event_ids"))


_ROOT = "CASE event_root_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookups.ROOT_LABELS.items()) + " END"


def _top_sql(source: str, k: str) -> str:
    return f"SELECT g, string_agg(v, '|' ORDER BY n DESC, v) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, v) AS r FROM (SELECT g, v, count(*) AS n FROM ({source}) WHERE v IS NOT NULL AND v <> '' GROUP BY 1, 2)) {k} GROUP BY g"


@query("dominant_values", "WITH a AS (" + _top_sql(f"SELECT source_url AS g, {_ROOT} AS v FROM gdelt_events WHERE source_url IS NOT NULL", "WHERE r <= 5") + "), b AS (" + _top_sql("SELECT source_url AS g, action_geo_country_code AS v FROM gdelt_events WHERE source_url IS NOT NULL", "WHERE r <= 5") + ") SELECT coalesce(a.g, b.g) AS source_url, a.vals AS types, b.vals AS countries FROM a FULL OUTER JOIN b ON a.g = b.g")
def dominant_values(spark, d):
    ev = _t(spark, d, "gdelt_events").filter("source_url is not null").select("source_url", lookups.root_label("event_root_code").alias("type"), "action_geo_country_code")
    types = cl.top_values(ev, "source_url", "type", "types", 5, (lookups.UNKNOWN,))
    both = types.join(cl.top_values(ev, "source_url", "action_geo_country_code", "countries"), "source_url", "full_outer")
    return both.select("source_url", F.array_join("types", "|").alias("types"), F.array_join("countries", "|").alias("countries"))


@query("gkg_top_values", _top_sql("SELECT source_url AS g, unnest(themes) AS v FROM story_clusters", "WHERE r <= 20").replace("g,", "g AS source_url,", 1))
def gkg_top_values(spark, d):
    s = _t(spark, d, "story_clusters")
    return cl.top_values(cl.exploded(s, "source_url", "themes"), "source_url", "value", "vals", 20).withColumn("vals", F.array_join("vals", "|"))


@query("mention_ranking", _top_sql("SELECT global_event_id AS g, mention_identifier AS v FROM gdelt_mentions", "").replace("g,", "g AS global_event_id,", 1))
def mention_ranking(spark, d):
    return cl.top_values(_t(spark, d, "gdelt_mentions").filter("global_event_id is not null"), "global_event_id", "mention_identifier", "vals", None).withColumn("vals", F.array_join("vals", "|"))


@query("distinct_sources", "SELECT global_event_id, string_agg(DISTINCT mention_source_name, '|' ORDER BY mention_source_name) AS sources FROM gdelt_mentions WHERE mention_source_name IS NOT NULL GROUP BY 1")
def distinct_sources(spark, d):
    m = _t(spark, d, "gdelt_mentions").filter("mention_source_name is not null")
    return m.groupBy("global_event_id").agg(F.array_join(F.array_sort(F.collect_set("mention_source_name")), "|").alias("sources"))


_URL_BAD = _BAD.replace("mention_identifier", "source_url")


@query("source_url_scores", f"SELECT * FROM (SELECT source_url, count(DISTINCT global_event_id) AS event_count, CAST(coalesce(sum(num_articles), 0) AS BIGINT) AS num_articles, CAST(coalesce(sum(num_mentions), 0) AS BIGINT) AS num_mentions, CAST(coalesce(sum(num_sources), 0) AS BIGINT) AS num_sources, round(0.4 * ln(count(DISTINCT global_event_id) + 1.0) + 0.3 * ln(coalesce(sum(num_articles), 0) + 1.0) + 0.2 * ln(coalesce(sum(num_mentions), 0) + 1.0) + 0.1 * ln(coalesce(sum(num_sources), 0) + 1.0), 4) AS topic_score FROM gdelt_events WHERE source_url <> '' AND NOT ({_URL_BAD}) GROUP BY 1) WHERE num_mentions <> 0 AND topic_score >= 3.6")
def source_url_scores(spark, d):
    return cl.source_url_scores(_t(spark, d, "gdelt_events"))


@query("fallback_clusters")
def fallback_clusters(spark, d):
    ev = _t(spark, d, "gdelt_events")
    out = pipeline.fallback_clusters(ev, _t(spark, d, "gdelt_mentions"), _documents(spark, d), *(graph.latest_window(ev) or (0, 0)))
    return out.select("cluster_id", "source_url", "event_count", "topic_score", "mention_count", "document_tone_avg")


# --- joins over materialised clusters -----------------------------------------------------------------------------------------------------

_CC = """
cc AS (SELECT component_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, count(*) FILTER (WHERE is_active) AS n_active FROM cluster_component_events WHERE component_id IS NOT NULL GROUP BY 1)
"""


def _cc(spark, d):
    """Components as their memberships tell of them: seen first and last, active while a membership is."""
    m = _t(spark, d, "cluster_component_events").filter("component_id is not null")
    g = m.groupBy("component_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.count_if("is_active").alias("n_active"))
    return g.withColumn("status", F.when(F.col("n_active") > 0, "active").otherwise("stale")).withColumn("missing_run_count", F.lit(2))


@query("join_membership", f"WITH {_CC} SELECT m.id, m.component_id, m.event_id, c.first_seen_at FROM cluster_component_events m JOIN cc c USING (component_id) WHERE m.is_active AND c.n_active > 0")
def join_membership(spark, d):
    m = _t(spark, d, "cluster_component_events").filter("is_active").select("id", "component_id", "event_id")
    return m.join(_cc(spark, d).filter("status = 'active'").select("component_id", "first_seen_at"), "component_id")


@query("component_gkg", "SELECT e.source_url, count(*) AS documents, round(avg(s.document_tone_avg), 2) AS tone FROM (SELECT DISTINCT source_url FROM gdelt_events WHERE source_url IS NOT NULL) e JOIN (SELECT unnest(mention_identifiers) AS u, document_tone_avg FROM story_clusters) s ON s.u = e.source_url GROUP BY 1")
def component_gkg(spark, d):
    urls = _t(spark, d, "gdelt_events").filter("source_url is not null").select(F.col("source_url").alias("document_identifier")).distinct()
    return urls.join(_documents(spark, d), "document_identifier").groupBy(F.col("document_identifier").alias("source_url")).agg(F.count("*").alias("documents"), F.round(F.avg("document_tone"), 2).alias("tone"))


@query("pair_mention_overlap", "WITH x AS (SELECT DISTINCT cluster_id, unnest(mention_identifiers) AS v FROM story_clusters) SELECT a.cluster_id AS a, b.cluster_id AS b, count(*) AS overlap FROM x a JOIN x b ON a.v = b.v AND a.cluster_id < b.cluster_id GROUP BY 1, 2 HAVING count(*) >= 2")
def pair_mention_overlap(spark, d):
    return merge.mention_pairs(_t(spark, d, "story_clusters"))


@query("pair_theme_jaccard", "WITH s AS (SELECT cluster_id, list_distinct(coalesce(themes[1:80], [])) AS s FROM story_clusters), x AS (SELECT cluster_id, unnest(s) AS v FROM s), r AS (SELECT v FROM x GROUP BY 1 HAVING count(*) <= greatest(2, floor((SELECT count(*) FROM story_clusters) * 0.2))), p AS (SELECT DISTINCT a.cluster_id AS a, b.cluster_id AS b FROM x a JOIN x b ON a.v = b.v AND a.cluster_id < b.cluster_id WHERE a.v IN (SELECT v FROM r)) SELECT p.a, p.b, len(list_intersect(m.s, n.s)) / len(list_distinct(list_concat(m.s, n.s))) AS jaccard FROM p JOIN s m ON m.cluster_id = p.a JOIN s n ON n.cluster_id = p.b WHERE len(list_intersect(m.s, n.s)) / len(list_distinct(list_concat(m.s, n.s))) > 0.4")
def pair_theme_jaccard(spark, d):
    c = _t(spark, d, "story_clusters").withColumn("themes", F.filter(F.coalesce("themes", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return merge.theme_pairs(c)


def _gated(spark, d):
    c = _t(spark, d, "story_clusters").select("cluster_id", "event_date_ref_start", "event_date_ref_end", "dominant_event_types")
    p = merge.mention_pairs(_t(spark, d, "story_clusters"), pipeline.replace(WIDE, mention_overlap_min=1))
    return p.join(c.alias("x"), F.col("a") == F.col("x.cluster_id")).join(c.alias("y"), F.col("b") == F.col("y.cluster_id"))


_PAIRS = "WITH v AS (SELECT DISTINCT cluster_id, unnest(mention_identifiers) AS v FROM story_clusters), p AS (SELECT DISTINCT a.cluster_id AS a, b.cluster_id AS b FROM v a JOIN v b ON a.v = b.v AND a.cluster_id < b.cluster_id), g AS (SELECT p.*, x.event_date_ref_start AS s0, x.event_date_ref_end AS e0, y.event_date_ref_start AS s1, y.event_date_ref_end AS e1, coalesce(x.dominant_event_types, []) AS t0, coalesce(y.dominant_event_types, []) AS t1 FROM p JOIN story_clusters x ON x.cluster_id = p.a JOIN story_clusters y ON y.cluster_id = p.b)"
_DAY = "CAST(try_strptime(CAST({} AS VARCHAR), '%Y%m%d') AS DATE)"


@query("date_gap_gate", f"{_PAIRS} SELECT a, b, CASE WHEN s0 IS NULL OR e0 IS NULL OR s1 IS NULL OR e1 IS NULL THEN TRUE ELSE greatest(0, date_diff('day', {_DAY.format('e0')}, {_DAY.format('s1')}), date_diff('day', {_DAY.format('e1')}, {_DAY.format('s0')})) <= 2 END AS passes FROM g")
def date_gap_gate(spark, d):
    return _gated(spark, d).select("a", "b", merge.gap_gate("x", "y").alias("passes"))


@query("action_gate", f"{_PAIRS} SELECT a, b, len(t0) = 0 OR len(t1) = 0 OR len(list_intersect(t0, t1)) > 0 AS passes FROM g")
def action_gate(spark, d):
    return _gated(spark, d).select("a", "b", merge.type_gate("x", "y").alias("passes"))


@query("merge_pairs")
def merge_pairs(spark, d):
    r = merge.merge_roots(_t(spark, d, "story_clusters"))
    return r.select("cluster_id", "root", F.to_json("evidence").alias("evidence"))


@query("merged_roots")
def merged_roots(spark, d):
    r = merge.merge_roots(_t(spark, d, "story_clusters"))
    return r.groupBy("root").agg(F.count("*").alias("clusters"))


_FUSE = "f AS (SELECT source_url AS root, * FROM story_clusters WHERE source_url IS NOT NULL)"


@query(
    "cluster_fuse",
    f"WITH {_FUSE} SELECT root, count(*) AS members, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(num_articles) AS BIGINT) AS num_articles, round(CAST(sum(CAST(avg_severity_score AS DECIMAL(20,2))) AS DOUBLE) / count(avg_severity_score), 2) AS avg_severity_score, min(event_date_ref_start) AS event_date_ref_start, max(event_date_ref_end) AS event_date_ref_end, min(first_mention_at) AS first_mention_at FROM f GROUP BY 1",
)
def cluster_fuse(spark, d):
    c = _t(spark, d, "story_clusters").filter("source_url is not null").withColumns({"component_source_urls": F.array("source_url"), "component_domains": F.array(scalars.domain("source_url")), "gkg_doc_count": F.lit(1)})
    out = cl.fuse(c, c.select("cluster_id", F.col("source_url").alias("root")))
    return out.select("root", "members", "event_count", "num_articles", "avg_severity_score", "event_date_ref_start", "event_date_ref_end", "first_mention_at")


@query("weighted_tone", "SELECT source_url, CASE WHEN sum(CASE WHEN document_tone_avg IS NOT NULL THEN mention_count END) > 0 THEN sum(document_tone_avg * mention_count) / sum(CASE WHEN document_tone_avg IS NOT NULL THEN mention_count END) ELSE avg(document_tone_avg) END AS tone FROM story_clusters GROUP BY 1")
def weighted_tone(spark, d):
    w = F.sum(F.when(F.col("document_tone_avg").isNotNull(), F.col("mention_count")))
    return _t(spark, d, "story_clusters").groupBy("source_url").agg(F.when(w > 0, F.sum(F.col("document_tone_avg") * F.col("mention_count")) / w).otherwise(F.avg("document_tone_avg")).alias("tone"))


@query("cluster_anchor", "SELECT source_url, arg_min(cluster_id, -topic_score) AS anchor FROM (SELECT * FROM story_clusters ORDER BY cluster_id) WHERE topic_score IS NOT NULL GROUP BY 1")
def cluster_anchor(spark, d):
    c = _t(spark, d, "story_clusters").filter("topic_score is not null")
    return c.groupBy("source_url").agg(F.min_by("cluster_id", F.struct((-F.col("topic_score")).alias("s"), "cluster_id")).alias("anchor"))


@query("story_root_partition", "SELECT cluster_id, event_count > 5000 AS is_root FROM (SELECT cluster_id, event_count FROM story_clusters UNION ALL SELECT cluster_id, event_count FROM root_clusters)")
def story_root_partition(spark, d):
    both = _t(spark, d, "story_clusters").select("cluster_id", "event_count").union(_t(spark, d, "root_clusters").select("cluster_id", "event_count"))
    return cl.partition_roots(both).select("cluster_id", "is_root")


# --- reconciliation -----------------------------------------------------------------------------------------------------------------------

_OVER = "now AS (SELECT DISTINCT cluster_id, unnest(event_ids) AS event_id FROM story_clusters), past AS (SELECT DISTINCT component_id, event_id FROM cluster_component_events WHERE is_active), nn AS (SELECT cluster_id, count(*) AS n_now FROM now GROUP BY 1), np AS (SELECT component_id, count(*) AS n_past FROM past GROUP BY 1), o AS (SELECT cluster_id, component_id, count(*) AS overlap FROM now JOIN past USING (event_id) GROUP BY 1, 2), ov AS (SELECT cluster_id, component_id, overlap, overlap / n_past AS historical_ratio, overlap / n_now AS current_ratio FROM o JOIN nn USING (cluster_id) JOIN np USING (component_id))"


def _over(spark, d):
    return reconcile.overlaps(_t(spark, d, "story_clusters"), _t(spark, d, "cluster_component_events").filter("is_active"))


@query("component_overlap", f"WITH {_OVER} SELECT * FROM ov")
def component_overlap(spark, d):
    return _over(spark, d)


@query("split_flags", f"WITH {_OVER} SELECT component_id, count(*) FILTER (WHERE overlap >= 2) AS parts, max(historical_ratio) AS best, count(*) FILTER (WHERE overlap >= 2) >= 2 AND max(historical_ratio) < 0.6 AS is_split FROM ov GROUP BY 1")
def split_flags(spark, d):
    return reconcile.split_flags(_over(spark, d))


@query("component_matches", f"WITH {_CC}, {_OVER} SELECT cluster_id, component_id, overlap, row_number() OVER (PARTITION BY cluster_id ORDER BY overlap DESC, first_seen_at, component_id) AS rank FROM ov JOIN cc USING (component_id)")
def component_matches(spark, d):
    return reconcile.rank_matches(_over(spark, d), _cc(spark, d)).select("cluster_id", "component_id", "overlap", "rank")


@query("canonical_component", f"WITH {_CC}, {_OVER} SELECT cluster_id, component_id AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first_seen_at, component_id) AS k FROM ov JOIN cc USING (component_id)) WHERE k = 1")
def canonical_component(spark, d):
    return reconcile.canonical(reconcile.rank_matches(_over(spark, d), _cc(spark, d)))


def _anchored(spark, d):
    """Root clusters of the table as earlier components with an anchor address."""
    r = _t(spark, d, "root_clusters")
    return r.select(F.col("cluster_id").alias("component_id"), F.col("source_url").alias("anchor_source_url"), F.col("mention_identifiers").alias("component_source_urls"), F.col("cluster_id").alias("current_cluster_id"), F.lit("active").alias("status"))


@query("url_fallback_match", f"WITH {_OVER}, u AS (SELECT cluster_id AS component_id, unnest(list_append(coalesce(mention_identifiers, []), source_url)) AS url FROM root_clusters) SELECT DISTINCT s.cluster_id, u.component_id FROM story_clusters s JOIN u ON u.url = s.source_url WHERE s.cluster_id NOT IN (SELECT cluster_id FROM ov)")
def url_fallback_match(spark, d):
    return reconcile.url_matches(_t(spark, d, "story_clusters").select("cluster_id", "source_url"), _anchored(spark, d), _over(spark, d))


@query("ageing", f"WITH {_CC}, {_OVER} SELECT component_id, CASE WHEN component_id IN (SELECT component_id FROM ov) THEN 2 ELSE 3 END AS missing_run_count, CASE WHEN component_id IN (SELECT component_id FROM ov) AND n_active > 0 THEN 'active' ELSE 'stale' END AS status FROM cc")
def ageing(spark, d):
    return reconcile.age(_cc(spark, d), _over(spark, d)).select("component_id", "missing_run_count", "status")


@query(
    "membership_replace",
    """
    WITH h AS (SELECT component_id, event_id, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, bool_or(is_active) AS is_active FROM cluster_component_events WHERE component_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT component_id, event_id FROM h WHERE CAST(right(trim(event_id), 1) AS VARCHAR) IN ('1', '2', '3') UNION SELECT component_id, 'new-' || component_id FROM h WHERE component_id < '8'),
    t AS (SELECT DISTINCT component_id FROM n)
    SELECT coalesce(h.component_id, n.component_id) AS component_id, coalesce(h.event_id, n.event_id) AS event_id, coalesce(h.first_seen_at, TIMESTAMPTZ '2026-04-01 00:00:00+00') AS first_seen_at,
      CASE WHEN n.event_id IS NOT NULL OR (h.component_id IN (SELECT component_id FROM t) AND h.is_active) THEN TIMESTAMPTZ '2026-04-01 00:00:00+00' ELSE h.last_seen_at END AS last_seen_at, CASE WHEN n.event_id IS NOT NULL THEN TRUE WHEN h.component_id IN (SELECT component_id FROM t) THEN FALSE ELSE h.is_active END AS is_active
    FROM h FULL OUTER JOIN n ON h.component_id = n.component_id AND h.event_id = n.event_id
    """,
)
def membership_replace(spark, d):
    m = _t(spark, d, "cluster_component_events").filter("component_id is not null and event_id is not null")
    h = m.groupBy("component_id", "event_id").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.bool_or("is_active").alias("is_active"))
    kept = h.filter(F.right(F.trim("event_id"), F.lit(1)).isin("1", "2", "3")).select("component_id", "event_id")
    new = h.filter("component_id < '8'").select("component_id", F.concat(F.lit("new-"), "component_id")).distinct()
    return reconcile.replace_membership(h, kept.union(new), "2026-04-01 00:00:00")


@query("double_ids", "SELECT cluster_id FROM story_clusters INTERSECT SELECT cluster_id FROM root_clusters")
def double_ids(spark, d):
    return reconcile.double_ids(_t(spark, d, "story_clusters"), _t(spark, d, "root_clusters"))


@query("dangling_links", "SELECT DISTINCT cluster_id AS component_id FROM root_clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM root_clusters WHERE event_count > 6000) AND cluster_id NOT IN (SELECT cluster_id FROM story_clusters)")
def dangling_links(spark, d):
    roots = _t(spark, d, "root_clusters").filter("event_count > 6000")
    return reconcile.dangling(_anchored(spark, d), _t(spark, d, "story_clusters"), roots).select("component_id").distinct()


def _payloads(spark, d):
    """All clusters of both tables as the payloads of a run."""
    both = None
    for t in ("story_clusters", "root_clusters"):
        x = _t(spark, d, t).select("cluster_id", "source_url", "event_ids", "themes", "computed_at", F.lit(t == "root_clusters").alias("is_root"), F.array("source_url").alias("component_source_urls"), F.lit(0).alias("gkg_doc_count"))
        both = x if both is None else both.union(x)
    return reconcile.payloads(both)


def _persisted(spark, d):
    """Components with the addresses of the clusters that hold their active events."""
    m = _t(spark, d, "cluster_component_events").filter("is_active").select("component_id", "event_id").distinct()
    at = _t(spark, d, "story_clusters").select(F.explode("event_ids").alias("event_id"), "source_url").distinct()
    urls = m.join(large_side(at), "event_id").groupBy("component_id").agg(F.min("source_url").alias("anchor_source_url"), F.array_sort(F.collect_set("source_url")).alias("component_source_urls"))
    return _cc(spark, d).join(large_side(urls), "component_id", "left")


@query("reconcile_payloads", "SELECT cluster_id, table_name, len(list_distinct(coalesce(list_filter(event_ids, lambda x: x IS NOT NULL), []))) AS events, coalesce(len(themes), 0) > 0 AS has_gkg FROM (SELECT cluster_id, 'story_clusters' AS table_name, event_ids, themes FROM story_clusters UNION ALL SELECT cluster_id, 'root_clusters', event_ids, themes FROM root_clusters)")
def reconcile_payloads(spark, d):
    return _payloads(spark, d).select("cluster_id", "table_name", F.size(F.filter(F.coalesce("event_ids", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("events"), "has_gkg")


@query("reconcile_run")
def reconcile_run(spark, d):
    return reconcile.reconcile(_payloads(spark, d), _persisted(spark, d), _t(spark, d, "cluster_component_events").filter("component_id is not null"))


@query("split_ranking", f"WITH {_OVER} SELECT component_id, cluster_id, row_number() OVER (PARTITION BY component_id ORDER BY historical_ratio DESC, overlap DESC, cluster_id) AS rank FROM ov WHERE overlap >= 2 AND historical_ratio >= 0.6")
def split_ranking(spark, d):
    return reconcile.split_candidates(_over(spark, d))


@query("terminal_cleanup", f"WITH {_CC} SELECT (SELECT count(*) FROM cc WHERE NOT (n_active = 0 AND last_seen_at < TIMESTAMPTZ '2026-02-20 00:00:00+00')) AS components, (SELECT count(*) FROM cluster_component_events WHERE component_id IS NOT NULL AND component_id NOT IN (SELECT component_id FROM cc WHERE n_active = 0 AND last_seen_at < TIMESTAMPTZ '2026-02-20 00:00:00+00')) AS memberships")
def terminal_cleanup(spark, d):
    c = _cc(spark, d).withColumn("status", F.when(F.col("n_active") > 0, "active").otherwise("merged"))
    kept, members = store.drop_terminal(c, _t(spark, d, "cluster_component_events").filter("component_id is not null"), "2026-02-20 00:00:00")
    return kept.agg(F.count("*").alias("components")).join(F.broadcast(members.agg(F.count("*").alias("memberships"))))  # one row each


@query("heal_links", f"WITH {_CC} SELECT cluster_id AS component_id, CASE WHEN event_count > 6000 THEN 'active' ELSE 'stale' END AS status, CASE WHEN event_count > 6000 THEN cluster_id END AS current_cluster_id FROM root_clusters")
def heal_links(spark, d):
    r = _anchored(spark, d)
    broken = reconcile.dangling(r, _t(spark, d, "story_clusters"), _t(spark, d, "root_clusters").filter("event_count > 6000"))
    return reconcile.heal(r, broken).select("component_id", "status", "current_cluster_id")


@query("release_stale", "SELECT cluster_id, CASE WHEN enrichment_status = 'processing' AND enriched_at IS NULL AND computed_at < TIMESTAMPTZ '2026-04-01 00:00:00+00' - INTERVAL 15 MINUTE THEN 'pending' ELSE enrichment_status END AS enrichment_status FROM story_clusters")
def release_stale(spark, d):
    return store.release_stale(_t(spark, d, "story_clusters"), "2026-04-01 00:00:00").select("cluster_id", "enrichment_status")


@query("cluster_pipeline")
def cluster_pipeline(spark, d):
    out = pipeline.build(_t(spark, d, "gdelt_events"), _t(spark, d, "gdelt_mentions"), _documents(spark, d), WIDE)
    return out.select("cluster_id", "source_url", "event_count", "mention_count", "topic_score", "avg_severity_score", "document_tone_avg", "is_root")
