"""The event–mention graph: node filter, components, their metrics and admission gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..runtime import HOT, durable, large_side, salted_join, spread_join
from ..settings import DEFAULTS, Settings


def window_events(events: DataFrame, since: int, until: int | None = None) -> DataFrame:
    """Events added in [since, until] that have a source URL."""
    out = events.filter((F.col("date_added") >= since) & F.col("source_url").isNotNull())
    return out.filter(F.col("date_added") <= until) if until is not None else out


def latest_window(events: DataFrame, hours: int = DEFAULTS.window_hours) -> tuple[int, int] | None:
    """[latest date_added - hours, latest date_added] as YYYYMMDDHHMMSS; None for an empty table. One row comes to the driver."""
    r = events.agg(F.max("date_added").alias("m")).select("m", F.date_format(scalars.stamp("m") - F.expr(f"INTERVAL {hours} HOURS"), "yyyyMMddHHmmss").alias("s")).first()
    return (int(r.s), int(r.m)) if r and r.m is not None and r.s is not None else None


def mentions_of(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Mention rows of the given events (a semi-join; rows keep their number)."""
    return mentions.join(events.select("global_event_id").distinct(), "global_event_id", "left_semi")


def mention_nodes(mentions: DataFrame) -> DataFrame:
    """Mentions whose address may be a node: not blank, no aggregator, no section page."""
    return mentions.filter(F.col("mention_identifier").isNotNull() & (F.col("mention_identifier") != "") & ~scalars.is_blocked("mention_identifier") & ~scalars.is_section("mention_identifier"))


def component_edges(events: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct (event_id, mention_url) of windowed events and admissible mentions."""
    return mention_nodes(mentions_of(mentions, events)).select(F.col("global_event_id").alias("event_id"), F.col("mention_identifier").alias("mention_url")).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of a partition as stars: every node of it linked to the least node that it reaches there."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y, up = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        low = np.minimum(up[x], up[y])
        before = up.copy()
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        up = up[up]
        if np.array_equal(up, before):
            break
    moved = up != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[up[moved]])], ["u", "v"])


def _least(links: DataFrame, m: Column) -> tuple[DataFrame, DataFrame]:
    """(u, m) of each node, and the hubs (u)."""
    least = durable(links.groupBy("u").agg(m.alias("m"), F.count("*").alias("n")))
    return large_side(least.select("u", "m")), least.filter(F.col("n") > HOT).select("u")


def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an undirected graph with long ids; the root is the least node of the component.

    Links are contracted to stars within each partition, which leaves fewer links than nodes there. Then two kinds of star alternate: each
    node's larger neighbours go to its least neighbour, then each node's smaller neighbours do, until nothing moves. Every round is
    one aggregation and one join in which hubs are salted, written to the shared folder, so hubs don't gather in a task and lost executors cost one round
    at most. Null ends and self loops are left out; a graph of any size takes this way."""
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).filter("node is not null").distinct()
    links = durable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_contracted, "u long, v long").distinct())
    while True:
        # settled: every node has one parent and no parent has one
        parents = large_side(links.groupBy("u").agg(F.count("*").alias("n")))
        open_ = parents.filter("n > 1").select("u").union(links.select("v").distinct().join(parents, F.col("v") == F.col("u"), "left_semi"))
        if open_.limit(1).count() == 0:
            break
        both = links.union(links.select("v", "u"))
        least, hot = _least(both, F.least(F.min("v"), F.col("u")))
        large = durable(spread_join(both, least, "u", hot).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least, hot = _least(large, F.min("v"))
        small = spread_join(large, least, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return nodes.join(large_side(links.toDF("node", "root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def event_components(edges: DataFrame, least_events: int = 2) -> DataFrame:
    """(component, event_id) of the components of the event–mention graph with at least ``least_events`` events; the component's name is
    its least event id. Mention nodes are negative hashes, events their ids (ids are not negative)."""
    url = -F.abs(F.xxhash64("mention_url")) - F.lit(1)
    coded = edges.select("event_id", url.alias("url"))
    roots = star_components(coded, "event_id", "url").filter("node >= 0")
    named = roots.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).filter(F.col("n") >= least_events)
    return salted_join(roots, named.select("root", "component"), "root").select("component", F.col("node").alias("event_id"))


def component_metrics(components: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """Per component: events, mention URLs, edges, source URLs, domains, density and the span in hours between the first and last
    date_added (0 with fewer than two readable stamps). An event id that occurs on several rows counts once."""
    e = salted_join(edges, components.select("event_id", "component"), "event_id", salts=4).groupBy("component").agg(F.countDistinct("mention_url").alias("mention_urls"), F.count("*").alias("edges"))
    rows = components.join(events.select(F.col("global_event_id").alias("event_id"), "source_url", "date_added"), "event_id")
    m = rows.groupBy("component").agg(
        F.countDistinct("event_id").alias("events"), F.countDistinct("source_url").alias("source_urls"),
        F.countDistinct(F.when(scalars.domain("source_url") != "", scalars.domain("source_url"))).alias("domains"),
        F.min(scalars.stamp("date_added")).alias("first"), F.max(scalars.stamp("date_added")).alias("last"),
    )
    span = F.coalesce((F.unix_timestamp("last") - F.unix_timestamp("first")) / 3600.0, F.lit(0.0))
    density = F.when((F.col("events") > 0) & (F.col("mention_urls") > 0), F.col("edges") / (F.col("events") * F.col("mention_urls"))).otherwise(0.0)
    return m.join(e, "component").select("component", "events", "mention_urls", "edges", "source_urls", "domains", density.alias("density"), span.alias("span_hours"))


def gates(metrics: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Metrics with the list of failed gates, in fixed order, and whether the component is admitted (none failed)."""
    failed = F.array_compact(F.array(
        F.when(F.col("events") < s.min_events, "min_event_ids"), F.when(F.col("source_urls") < s.min_source_urls, "min_source_urls"), F.when(F.col("domains") < s.min_domains, "min_domains"),
        F.when(F.col("span_hours") > s.max_span_hours, "max_event_span_hours"), F.when(F.col("density") < s.min_density, "min_density"),
    ))
    return metrics.withColumn("failed_gates", failed).withColumn("admitted", F.size("failed_gates") == 0)
