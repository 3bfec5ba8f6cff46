"""The cluster build from window to materialised clusters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import graph, merge
from ..runtime import durable
from ..settings import DEFAULTS, Settings


def component_clusters(events: DataFrame, mentions: DataFrame, documents: DataFrame, since: int, until: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """Clusters of the admitted components of a window; if none is admitted, of its source URLs (``fallback_clusters``)."""
    ev = graph.window_events(events, since, until)
    edges = durable(graph.component_edges(ev, mentions))
    components = durable(graph.event_components(edges, s.min_events))
    admitted = graph.gates(graph.component_metrics(components, edges, ev), s).filter("admitted").select("component")
    members = durable(components.join(admitted, "component", "left_semi"))
    if members.limit(1).count() == 0:
        return fallback_clusters(events, mentions, documents, since, until, s)
    spoken = graph.mention_nodes(graph.mentions_of(mentions, ev))
    return cl.build_clusters(members, ev, spoken, documents, "component", s).drop("component")


def fallback_clusters(events: DataFrame, mentions: DataFrame, documents: DataFrame, since: int, until: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """One cluster per source URL that scores enough, with all its mentions (not filtered) and the score of the URL."""
    ev = graph.window_events(events, since, until)
    scores = cl.source_url_scores(ev, s).select("source_url", F.col("topic_score").alias("url_score"))
    members = cl.first_rows(ev).select(F.col("source_url").alias("component"), F.col("global_event_id").alias("event_id"))
    members = members.join(scores.withColumnRenamed("source_url", "component"), "component", "left_semi")
    built = cl.build_clusters(members, ev, graph.mentions_of(mentions, ev), documents, "component", s)
    return built.join(scores.withColumnRenamed("source_url", "component"), "component").withColumn("topic_score", F.col("url_score")).drop("component", "url_score")


def merged_clusters(clusters: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Clusters after the similarity merge, marked as story or root. Unmerged clusters stay as they are."""
    clusters = durable(clusters)
    roots = durable(merge.merge_roots(clusters, s))
    joined = roots.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    groups = roots.join(joined, "root", "left_semi")
    fused = cl.fuse(clusters, groups.select("cluster_id", "root"), s)
    evidence = groups.groupBy("root").agg(F.max_by("evidence", F.size("evidence")).alias("merge_evidence"))
    fused = fused.join(evidence, "root").drop("root", "members")
    alone = clusters.join(groups.select("cluster_id"), "cluster_id", "left_anti")
    return cl.partition_roots(alone.unionByName(fused, allowMissingColumns=True), s)


def build(events: DataFrame, mentions: DataFrame, documents: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The clusters of the latest window of events. An empty table of events gives no clusters."""
    window = graph.latest_window(events, s.window_hours)
    since, until = window or (0, 0)
    return merged_clusters(component_clusters(events, mentions, documents, since, until, s), s)


def wide(s: Settings = DEFAULTS, hours: float = 336.0) -> Settings:
    """Settings that admit components spread over a longer time."""
    return replace(s, max_span_hours=hours)
