"""Persistent identities: this run's clusters against the components of earlier runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import durable, large_side, salted_join
from ..settings import DEFAULTS, Settings
from .graph import star_components


def payloads(clusters: DataFrame) -> DataFrame:
    """What a cluster brings to reconciliation: table, ids, addresses (its own if none) and whether documents stand behind it."""
    urls = F.when(F.size(F.coalesce("component_source_urls", F.array().cast("array<string>"))) > 0, F.col("component_source_urls")).otherwise(F.array("source_url"))
    documents = F.coalesce(F.col("gkg_doc_count") > 0, F.lit(False)) | (F.size(F.coalesce("themes", F.array().cast("array<string>"))) > 0)
    table = F.when(F.col("is_root"), "root_clusters").otherwise("story_clusters")
    return clusters.select("cluster_id", "source_url", table.alias("table_name"), F.array_distinct("event_ids").alias("event_ids"), urls.alias("urls"), documents.alias("has_gkg"), "computed_at")


def overlaps(current: DataFrame, memberships: DataFrame) -> DataFrame:
    """(cluster_id, component_id, overlap, historical_ratio, current_ratio) of clusters and components that share event ids: an equi-join on
    the exploded ids instead of a loop over all pairs."""
    now = large_side(current.select("cluster_id", F.explode("event_ids").alias("event_id")).distinct())
    past = large_side(memberships.select("component_id", "event_id").distinct())
    n_now, n_past = now.groupBy("cluster_id").agg(F.count("*").alias("n_now")), past.groupBy("component_id").agg(F.count("*").alias("n_past"))
    o = now.join(past, "event_id").groupBy("cluster_id", "component_id").agg(F.count("*").alias("overlap"))
    o = o.join(n_now, "cluster_id").join(n_past, "component_id")
    return o.select("cluster_id", "component_id", "overlap", (F.col("overlap") / F.col("n_past")).alias("historical_ratio"), (F.col("overlap") / F.col("n_now")).alias("current_ratio"))


def split_flags(over: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(component_id, parts, best, is_split): split if at least two clusters take enough of its events and none takes the ratio of them."""
    g = over.groupBy("component_id").agg(F.count_if(F.col("overlap") >= s.split_overlap).alias("parts"), F.max("historical_ratio").alias("best"))
    return g.withColumn("is_split", (F.col("parts") >= 2) & (F.col("best") < s.split_ratio))


def split_candidates(over: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(component_id, cluster_id, rank): clusters that take enough of a component's events, most of its history first (ties: most events, then the
    cluster's id)."""
    w = Window.partitionBy("component_id").orderBy(F.desc("historical_ratio"), F.desc("overlap"), "cluster_id")
    kept = over.filter((F.col("overlap") >= s.split_overlap) & (F.col("historical_ratio") >= s.split_ratio))
    return kept.select("component_id", "cluster_id", F.row_number().over(w).alias("rank"))


def rank_matches(over: DataFrame, components: DataFrame) -> DataFrame:
    """Matches of each cluster: most overlap first, then the component seen first, then its id."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc("overlap"), "first_seen_at", "component_id")
    return over.join(components.select("component_id", "first_seen_at"), "component_id").withColumn("rank", F.row_number().over(w))


def canonical(matches: DataFrame) -> DataFrame:
    """(cluster_id, canonical): the match seen first (ties: the smaller id)."""
    return matches.groupBy("cluster_id").agg(F.min(F.struct("first_seen_at", "component_id")).alias("x")).select("cluster_id", F.col("x.component_id").alias("canonical"))


def url_matches(current: DataFrame, components: DataFrame, over: DataFrame) -> DataFrame:
    """(cluster_id, component_id) of clusters without any shared event whose address is an anchor or one of a component's addresses."""
    alone = current.join(over.select("cluster_id").distinct(), "cluster_id", "left_anti").select("cluster_id", F.col("source_url").alias("url"))
    urls = components.select("component_id", F.explode(F.array_distinct(F.concat(F.array("anchor_source_url"), F.coalesce("component_source_urls", F.array().cast("array<string>"))))).alias("url")).filter("url is not null")
    return alone.join(urls, "url").select("cluster_id", "component_id").distinct()


def age(components: DataFrame, matched: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Unmatched active or stale components miss one more run; from the limit on they are stale. Matched and terminal ones stay."""
    m = components.join(matched.select("component_id").distinct().withColumn("__m", F.lit(True)), "component_id", "left")
    old = F.col("__m").isNull() & F.col("status").isin("active", "stale")
    missing = F.when(old, F.col("missing_run_count") + 1).otherwise(F.col("missing_run_count"))
    status = F.when(old & (missing >= s.stale_after), "stale").otherwise(F.col("status"))
    return m.withColumn("status", status).withColumn("missing_run_count", missing).drop("__m")


def replace_membership(history: DataFrame, now: DataFrame, stamp: str) -> DataFrame:
    """Membership history (component_id, event_id, first_seen_at, last_seen_at, is_active) after the components in ``now`` (component_id,
    event_id) got new events: those present are active and seen now, those gone become inactive, new ones begin. Other components
    stay as they are; rows already inactive and still gone too."""
    t = F.lit(stamp).cast("timestamp")
    touched = now.select("component_id").distinct().withColumn("__t", F.lit(True))
    new = now.select("component_id", "event_id").distinct().withColumn("__n", F.lit(True))
    h = history.join(new, ["component_id", "event_id"], "full_outer").join(touched, "component_id", "left")
    gone = F.col("__t").isNotNull() & F.col("__n").isNull() & F.col("is_active")
    return h.select(
        "component_id", "event_id", F.when(F.col("first_seen_at").isNull() & F.col("__n"), t).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(F.col("__n") | gone, t).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(F.col("__n"), True).when(gone, False).otherwise(F.col("is_active")).alias("is_active"),
    )


def double_ids(stories: DataFrame, roots: DataFrame) -> DataFrame:
    """Cluster ids that stand in both tables (there must be none)."""
    return stories.select("cluster_id").intersect(roots.select("cluster_id"))


def dangling(components: DataFrame, stories: DataFrame, roots: DataFrame) -> DataFrame:
    """Active components whose linked cluster is in neither table."""
    there = stories.select("cluster_id").union(roots.select("cluster_id")).distinct().toDF("current_cluster_id")
    return components.filter("status = 'active' and current_cluster_id is not null").join(there, "current_cluster_id", "left_anti")


def heal(components: DataFrame, broken: DataFrame) -> DataFrame:
    b = broken.select("component_id").distinct().withColumn("__b", F.lit(True))
    c = components.join(b, "component_id", "left")
    return c.withColumn("status", F.when(F.col("__b"), "stale").otherwise(F.col("status"))).withColumn("current_cluster_id", F.when(F.col("__b"), None).otherwise(F.col("current_cluster_id"))).drop("__b")


_TOUCHED = "component_id string, cluster_id string, table_name string, status string, merged_into string, is_new boolean"


def _decided(new_id):
    """Decisions for the groups of a partition, which stand one after the other: first a group's components, then its clusters in order. What is
    held is the components of one group and the addresses by which they are found."""
    names = [x.split()[0] for x in _TOUCHED.split(", ")]
    kind = pa.schema(list(zip(names, [pa.string()] * 5 + [pa.bool_()])))

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, at, taken, merged = None, {}, {}, set(), set()
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["group"] != group:
                    group, seen, at, taken, merged = r["group"], {}, {}, set(), set()
                if r["phase"] == 0:
                    seen[r["id"]] = (r["first_seen_at"], r["id"])
                    for u in r["urls"] or ():
                        at.setdefault(u, set()).add(r["id"])
                    continue
                match = {c for c in r["matches"] or () if c not in taken and c not in merged}
                match = match or {c for c in at.get(r["url"], ()) if c not in merged}
                if not match:
                    new = new_id(r["id"])
                    seen[new] = (r["first_seen_at"], new)
                    for u in {r["url"], *(r["urls"] or ())} - {None}:
                        at.setdefault(u, set()).add(new)
                    taken.add(new)
                    out.append((new, r["id"], r["table_name"], "active", None, True))
                    continue
                keep = min(match, key=seen.get)
                taken.add(keep)
                out.append((keep, r["id"], r["table_name"], "active", None, False))
                for c in sorted(match - {keep}):
                    merged.add(c)
                    out.append((c, None, None, "merged", keep, False))
            if out:
                yield told(out)

    return run


def reconcile(current: DataFrame, components: DataFrame, memberships: DataFrame, s: Settings = DEFAULTS, new_id=lambda p: str(uuid.uuid5(uuid.NAMESPACE_URL, p))) -> DataFrame:
    """(component_id, cluster_id, table_name, status, merged_into, is_new): what this run does to each component that it touches.

    ``current`` is the run's clusters (cluster_id, table_name, source_url, event_ids, urls, computed_at; see ``payloads``), taken in the order
    stories before roots, each by cluster id. A split component is told and matches none. A cluster takes the components with which it
    shares an active event and that no cluster before it has taken (whose events they then hold; clusters of one run share none), else
    those one of whose addresses is its own, those made earlier in the run included (a missing ``urls`` or ``computed_at`` is no
    further address and now); the one seen first lives on, the others are merged
    into it. One merged earlier in the run isn't revived. Without a match a component is made.

    Decisions never leave a group that is connected by shared events and addresses, so groups are decided independently, each by one
    task; nothing comes to the driver, and no table is broadcast. An empty table of clusters touches nothing but what is split, which then is nothing."""
    if "urls" not in current.columns:
        current = current.withColumn("urls", F.lit(None).cast("array<string>"))
    seen_at = F.coalesce("computed_at", F.current_timestamp()) if "computed_at" in current.columns else F.current_timestamp()
    live = large_side(durable(components.filter(F.col("status").isin("active", "stale"))))
    active = memberships.filter("is_active").join(live.select("component_id"), "component_id", "left_semi")
    over = large_side(durable(overlaps(current, active)))
    split = durable(split_flags(over, s).filter("is_split").select("component_id"))
    over = over.join(split, "component_id", "left_anti")
    none = F.array().cast("array<string>")
    own = large_side(durable(current.select("cluster_id", "table_name", F.col("source_url").alias("url"), F.array_distinct(F.concat(F.coalesce("urls", none), F.array("source_url"))).alias("urls"), seen_at.alias("computed_at"))))
    asked = own.select("url").filter("url is not null").distinct()
    held = live.join(split, "component_id", "left_anti").select("component_id", "first_seen_at", F.array_distinct(F.concat(F.array("anchor_source_url"), F.coalesce("component_source_urls", none))).alias("urls"))
    node = lambda kind, c: F.xxhash64(F.lit(kind), c)
    by_url = held.select("component_id", F.explode("urls").alias("url")).join(asked, "url", "left_semi")
    offered = own.select("cluster_id", F.explode("urls").alias("url")).join(asked, "url", "left_semi")
    edges = over.select(node("p", "cluster_id").alias("u"), node("c", "component_id").alias("v"))
    edges = edges.union(by_url.select(node("u", "url"), node("c", "component_id"))).union(offered.select(node("p", "cluster_id"), node("u", "url")))
    groups = large_side(durable(star_components(durable(edges), "u", "v")))
    matches = over.groupBy("cluster_id").agg(F.collect_set("component_id").alias("matches"))
    met = large_side(by_url.select("component_id").union(over.select("component_id")).distinct())
    first = held.join(met, "component_id", "left_semi").select(F.lit(0).alias("phase"), F.lit("").alias("rank"), F.col("component_id").alias("id"), "first_seen_at", "urls", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("array<string>").alias("matches"), node("c", "component_id").alias("node"))
    rank = F.when(F.col("table_name") == "story_clusters", "0").otherwise("1")
    then = own.join(matches, "cluster_id", "left").select(F.lit(1), rank, "cluster_id", "computed_at", "urls", "url", "table_name", "matches", node("p", "cluster_id"))
    rows = salted_join(first.union(then), groups, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("node", "root")
    decided = rows.repartition("group").sortWithinPartitions("group", "phase", "rank", "id").mapInArrow(_decided(new_id), _TOUCHED)
    null = F.lit(None).cast("string")
    return decided.union(split.select("component_id", null, null, F.lit("split"), null, F.lit(False)))


def outdated(touched: DataFrame, components: DataFrame) -> DataFrame:
    """(table_name, cluster_id) of materialised rows to delete: those that a touched component points to and that are not what it is now."""
    now = touched.select("component_id", F.col("cluster_id").alias("now_id"), F.col("table_name").alias("now_table"))
    was = components.filter("current_cluster_id is not null and current_table is not null").join(now, "component_id")
    same = F.col("current_cluster_id").eqNullSafe(F.col("now_id")) & F.col("current_table").eqNullSafe(F.col("now_table"))
    return was.filter(~same).select(F.col("current_table").alias("table_name"), F.col("current_cluster_id").alias("cluster_id")).distinct()


def next_components(components: DataFrame, touched: DataFrame, current: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The components after a run: touched ones take status, link, addresses and the time of the run, new ones begin, untouched ones age. A
    component that several clusters took by address is the last one's. Columns: component_id, status, anchor_source_url,
    component_source_urls, first_seen_at, last_seen_at, missing_run_count, merged_into, current_cluster_id, current_table, has_gkg."""
    rank = F.struct(F.when(F.col("status") == "active", 1).otherwise(2).alias("k"), F.coalesce("table_name", F.lit("")).alias("t"), F.coalesce("cluster_id", F.lit("")).alias("c"))
    last = touched.groupBy("component_id").agg(F.max_by(F.struct("cluster_id", "table_name", "status", "merged_into"), F.struct((F.col("status") == "active").alias("live"), F.when(F.col("table_name") == "root_clusters", 1).otherwise(0).alias("t"), rank.alias("r"))).alias("x"), F.max("is_new").alias("is_new"))
    told = last.select("component_id", "x.*", "is_new").withColumnRenamed("status", "new_status").withColumnRenamed("merged_into", "to")
    run_at = current.agg(F.max("computed_at").alias("run_at"))
    told = told.join(current.select("cluster_id", "source_url", "urls", F.col("has_gkg").alias("t_gkg"), "computed_at"), "cluster_id", "left").join(F.broadcast(run_at))  # one row
    at = F.coalesce("computed_at", "run_at")
    out = age(components, touched, s).join(told, "component_id", "full_outer")
    hit, live = F.col("new_status").isNotNull(), F.col("new_status") == "active"
    return out.select(
        "component_id", F.coalesce("new_status", "status").alias("status"), F.coalesce("anchor_source_url", F.when(F.col("is_new"), F.col("source_url"))).alias("anchor_source_url"),
        F.when(live, F.col("urls")).otherwise(F.col("component_source_urls")).alias("component_source_urls"), F.coalesce("first_seen_at", at).alias("first_seen_at"), F.when(hit, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(hit, 0).otherwise(F.col("missing_run_count")).alias("missing_run_count"), F.when(hit, F.col("to")).otherwise(F.col("merged_into")).alias("merged_into"),
        F.when(hit, F.col("cluster_id")).otherwise(F.col("current_cluster_id")).alias("current_cluster_id"), F.when(hit, F.col("table_name")).otherwise(F.col("current_table")).alias("current_table"),
        F.when(live, F.col("t_gkg")).otherwise(F.col("has_gkg")).alias("has_gkg"),
    )
