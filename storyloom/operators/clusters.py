"""Aggregations that turn components or source URLs into cluster rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lookups, scalars
from ..runtime import durable
from ..settings import DEFAULTS, Settings


def source_url_scores(events: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Scores of source URLs: counters per URL, without blocked domains, section pages, URLs nobody mentions (if required) and scores below
    the least."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    g = events.filter(F.col("source_url").isNotNull() & (F.col("source_url") != "")).groupBy("source_url").agg(F.countDistinct("global_event_id").alias("event_count"), total("num_articles"), total("num_mentions"), total("num_sources"))
    g = g.filter(~scalars.is_blocked("source_url") & ~scalars.is_section("source_url"))
    if s.require_mentions:
        g = g.filter(F.col("num_mentions") != 0)
    return g.withColumn("topic_score", scalars.topic_score("event_count", "num_articles", "num_mentions", "num_sources")).filter(F.col("topic_score") >= s.fallback_score)


def top_values(df: DataFrame, group: str, value: str, name: str, k: int | None = DEFAULTS.top_values, drop: tuple[str, ...] = ()) -> DataFrame:
    """(group, name): the k most frequent values of a group as a list, most frequent first, ties by value. Null, empty and ``drop`` values are
    left out. Rows are counted per (group, value) first, so a large group reaches its task only as distinct values; those beyond the
    k-th are cut before the list is made."""
    kept = df.filter(F.col(value).isNotNull() & (F.col(value) != "") & ~F.col(value).isin(*drop) if drop else F.col(value).isNotNull() & (F.col(value) != ""))
    counts = kept.groupBy(group, value).agg(F.count("*").alias("n"))
    if k is not None:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc(value)))
        counts = counts.withColumn("rank", rank).filter(F.col("rank") <= k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))), lambda x: x["v"])
    return counts.groupBy(group).agg(ordered.alias(name))


def top_lists(df: DataFrame, group: str, fields: dict[str, tuple[Column, int | None]]) -> DataFrame:
    """(group, one list a field): like ``top_values`` for several fields in one pass. ``fields`` gives, by the name of the list, a column of
    values (an array) and how many are kept. Rows are counted per (group, field, value) first."""
    def tagged(name: str):
        return lambda v: F.struct(F.lit(name).alias("f"), v.alias("v"))

    named = [F.transform(F.coalesce(values, F.array().cast("array<string>")), tagged(name)) for name, (values, _) in fields.items()]
    items = df.select(group, F.explode(F.concat(*named)).alias("x")).select(group, "x.f", "x.v").filter("v is not null and v <> ''")
    counts = items.groupBy(group, "f", "v").agg(F.count("*").alias("n"))
    most = F.create_map(*(F.lit(x) for name, (_, k) in fields.items() for x in (name, k or 2**31 - 1)))
    rank = F.row_number().over(Window.partitionBy(group, "f").orderBy(F.desc("n"), F.asc("v")))
    kept = counts.withColumn("r", rank).filter(F.col("r") <= F.element_at(most, F.col("f")))
    ranked = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == name, F.struct("r", "v")))), lambda x: x["v"]).alias(name)
    return kept.groupBy(group).agg(*(ranked(name) for name in fields))


def exploded(df: DataFrame, group: str, values: str) -> DataFrame:
    """(group, value) of every item of a list column; an item repeated in a list counts as often as it stands there."""
    return df.select(group, F.explode(values).alias("value"))


def first_rows(events: DataFrame) -> DataFrame:
    """One row per event id: the one added first (ties: the smallest source URL)."""
    w = Window.partitionBy("global_event_id").orderBy("date_added", F.col("source_url").asc_nulls_last(), F.col("num_mentions").asc_nulls_last(), F.col("num_articles").asc_nulls_last())
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def build_clusters(members: DataFrame, events: DataFrame, mentions: DataFrame, documents: DataFrame, group: str = "component", s: Settings = DEFAULTS) -> DataFrame:
    """Cluster rows of the groups (group, event_id): event, mention and document layers.

    ``documents`` has document_identifier, themes, persons, organizations, locations (lists) and document_tone. Groups without mentions or
    documents keep empty lists and null figures."""
    read = ["event_id", "sql_date", "source_url", "event_root_code", "quad_class", "goldstein_scale", "avg_tone", "num_articles", "num_mentions", "num_sources", "action_geo_country_code", "action_geo_full_name"]
    ev = durable(members.join(first_rows(events).withColumnRenamed("global_event_id", "event_id"), "event_id").select(group, *read))
    total = lambda c: F.sum(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(c)
    base = ev.groupBy(group).agg(
        F.array_sort(F.collect_list("event_id")).alias("ids"), F.count("*").alias("event_count"), total("num_articles"), total("num_mentions"), total("num_sources"),
        F.min("sql_date").alias("event_date_ref_start"), F.max("sql_date").alias("event_date_ref_end"),
        scalars.mean2(scalars.severity("quad_class", "goldstein_scale", "avg_tone")).alias("avg_severity_score"),
        F.min("source_url").alias("source_url"), F.array_sort(F.collect_set("source_url")).alias("component_source_urls"),
        F.array_sort(F.collect_set(F.when(scalars.domain("source_url") != "", scalars.domain("source_url")))).alias("component_domains"),
    )
    known = lambda c: F.array(F.when(c != lookups.UNKNOWN, c))
    labels = {
        "dominant_event_types": (known(lookups.root_label("event_root_code")), s.top_values), "dominant_quad_classes": (known(lookups.quad_label("quad_class")), s.top_values),
        "dominant_countries": (F.array("action_geo_country_code"), s.top_values), "dominant_locations": (F.array("action_geo_full_name"), s.top_values),
    }
    tops = [top_lists(ev, group, labels)]
    me = durable(mentions.join(members.withColumnRenamed("event_id", "global_event_id"), "global_event_id").select(group, "mention_identifier", "mention_source_name", "mention_time_date"))
    spoken = me.groupBy(group).agg(
        F.countDistinct("mention_identifier").alias("mention_count"), F.array_sort(F.collect_set("mention_source_name")).alias("distinct_mention_sources"),
        F.min(scalars.stamp("mention_time_date")).alias("first_mention_at"), F.max(scalars.stamp("mention_time_date")).alias("last_mention_at"),
    )
    ranked = top_values(me, group, "mention_identifier", "mention_identifiers", None)
    docs = durable(ev.select(group, F.col("source_url").alias("document_identifier")).distinct().join(documents, "document_identifier").select(group, "themes", "persons", "organizations", "locations", "document_tone"))
    tone = docs.groupBy(group).agg(F.round(F.avg("document_tone"), 2).alias("document_tone_avg"), F.count("document_tone").alias("gkg_doc_count"))
    lists = [top_lists(docs, group, {"themes": (F.col("themes"), s.themes_cap), "persons": (F.col("persons"), s.persons_cap), "organizations": (F.col("organizations"), s.organizations_cap), "gkg_locations": (F.col("locations"), s.locations_cap)})]
    out = reduce(lambda a, b: a.join(b, group, "left"), [*tops, spoken, ranked, tone, *lists], base)
    empty = F.array().cast("array<string>")
    listed = ["dominant_event_types", "dominant_quad_classes", "dominant_countries", "dominant_locations", "distinct_mention_sources", "mention_identifiers", "themes", "persons", "organizations", "gkg_locations"]
    out = out.withColumns({c: F.coalesce(c, empty) for c in listed} | {c: F.coalesce(c, F.lit(0)) for c in ("mention_count", "gkg_doc_count")})
    out = out.withColumn("topic_score", scalars.component_score("event_count", F.size("component_source_urls"), F.size("component_domains")))
    return out.withColumn("cluster_id", scalars.cluster_id("ids")).withColumn("event_ids", F.transform("ids", lambda x: x.cast("string"))).drop("ids")


def fuse(clusters: DataFrame, roots: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Clusters of one root (cluster_id -> root) fused into one row: counters summed, lists united and sorted (ids as text), capped lists by
    frequency, the anchor's address from the best score (ties: the least cluster id), mean severity, tone weighted by documents,
    envelope of dates."""
    c = durable(clusters.join(roots, "cluster_id"))
    union = lambda x, name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(x), F.array().cast("array<string>")))))).alias(name)
    weight, toned = F.coalesce("gkg_doc_count", F.lit(0)), F.col("document_tone_avg")
    base = c.groupBy("root").agg(
        F.count("*").alias("members"),
        *(F.sum(x).alias(x) for x in ("event_count", "num_articles", "num_mentions", "num_sources")),
        union("event_ids", "event_ids"), union("mention_identifiers", "mention_identifiers"), union("distinct_mention_sources", "distinct_mention_sources"), union("component_source_urls", "component_source_urls"), union("component_domains", "component_domains"),
        scalars.mean2("avg_severity_score").alias("avg_severity_score"),
        F.round(F.when(F.sum(F.when(toned.isNotNull(), weight)) > 0, F.sum(toned * weight) / F.sum(F.when(toned.isNotNull(), weight))).otherwise(F.avg(toned)), 2).alias("document_tone_avg"),
        F.min("event_date_ref_start").alias("event_date_ref_start"), F.max("event_date_ref_end").alias("event_date_ref_end"), F.min("first_mention_at").alias("first_mention_at"), F.max("last_mention_at").alias("last_mention_at"),
        F.min_by("source_url", F.struct((-F.col("topic_score")).alias("s"), "cluster_id")).alias("source_url"),
    )
    caps = (("themes", s.themes_cap), ("persons", s.persons_cap), ("organizations", s.organizations_cap), ("gkg_locations", s.locations_cap), ("dominant_event_types", s.top_values), ("dominant_quad_classes", s.top_values), ("dominant_countries", s.top_values), ("dominant_locations", s.top_values))
    out = base.join(top_lists(c, "root", {x: (F.col(x), cap) for x, cap in caps}), "root", "left")
    out = out.withColumns({x: F.coalesce(x, F.array().cast("array<string>")) for x, _ in caps})
    urls = F.when(F.size("component_source_urls") > 0, F.col("component_source_urls")).otherwise(F.array("source_url"))
    out = out.withColumn("component_source_urls", urls).withColumn("mention_count", F.size("mention_identifiers").cast("long"))
    out = out.withColumn("topic_score", scalars.component_score("event_count", F.size("component_source_urls"), F.size("component_domains")))
    return out.withColumn("cluster_id", scalars.cluster_id(F.transform("event_ids", lambda x: x.cast("long"))))


def partition_roots(clusters: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Clusters with the mark of those that are roots (strictly more events than the threshold)."""
    return clusters.withColumn("is_root", F.coalesce(F.col("event_count") > s.root_event_count, F.lit(False)))
