"""Consolidating pairwise matches into groups: partitioned union-find whose spanning forests are merged level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, partitions_for, salted_join

_FOREST = "node long, root long"


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges (a[i], b[i]) with batched unions and full path compression.

    Returns (node, root) for every node that is not its own root; a root is the least id of its component."""
    ids, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = pos[: len(a)], pos[len(a) :]
    parent = np.arange(len(ids))
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        if not open_.any():
            break
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    own = parent != np.arange(len(ids))
    return ids[own], ids[parent[own]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a partition by its spanning forest. What is held at a time is the forest so far plus one batch."""
    node, root = np.empty(0, "int64"), np.empty(0, "int64")
    wait: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def fold() -> None:
        nonlocal node, root, wait, held
        node, root = union_find(np.concatenate([node, *(x for x, _ in wait)]), np.concatenate([root, *(y for _, y in wait)]))
        wait, held = [], 0

    for batch in batches:
        wait.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        held += batch.num_rows
        if held > max(200_000, len(node)):
            fold()
    fold()
    for at in range(0, len(node), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 100_000]), pa.array(root[at : at + 100_000])], ["node", "root"])


def connected_components(edges: DataFrame, max_edges: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of ``edges`` that is not the least of its component; the least node is the root.

    ``edges`` has two long columns; rows with a null are left out, self loops and repeated edges are harmless, an empty input
    gives an empty result. ``max_edges`` bounds the edges that one task takes: each level keeps only spanning forests and
    repartitions them into fewer, still bounded partitions. When a single bounded partition is left, it finishes; when the forest
    of the whole graph is larger than that, the levels stop shrinking and alternate local union-find (by child) with a
    pointer jump until every child points to a root."""
    a, b = edges.columns[:2]
    level = edges.select(F.col(a).alias("node"), F.col(b).alias("root")).filter("node is not null and root is not null and node <> root")
    forest = durable(level.mapInArrow(_forest, _FOREST))
    rows, parts = forest.count(), None
    while True:
        wanted = partitions_for(rows, max_edges)
        if parts is not None and wanted > 1 and wanted * 2 > parts:
            return _settle(forest, wanted)
        parts = wanted
        spread = forest.coalesce(1) if parts == 1 else forest.repartition(parts, "node")
        forest = durable(spread.mapInArrow(_forest, _FOREST))
        if parts == 1:
            return forest
        rows = forest.count()


def _settle(forest: DataFrame, parts: int) -> DataFrame:
    """Rounds of local union-find and a pointer jump, until every child points to a root. A child may stand in several partitions with
    other parents; the least of them is the one that is jumped to, which keeps all links, as each row moves up a chain that ends in the
    same root. All children of a giant component have one parent, so the jump is a salted join."""
    while True:
        forest = durable(forest.repartition(parts, "node").mapInArrow(_forest, _FOREST))
        twice = forest.groupBy("node").count().filter("count > 1").limit(1).count()
        parents = forest.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("up"))
        chained = forest.select("root").distinct().join(parents, "root", "left_semi").limit(1).count()
        if not twice and not chained:
            return forest
        forest = salted_join(forest, parents, "root", "left").select("node", F.coalesce("up", "root").alias("root"))


def group_records(links: DataFrame, max_edges: int = 1_000_000) -> DataFrame:
    """Groups of the records that share a value, directly or through others.

    ``links`` has ``kind``, ``record_id`` and ``value`` (strings); records of different kinds are never linked. Gives
    (kind, record_id, group_id, members) for every record that has a value, where group_id is the smallest record_id of the group
    by code point. Rows with a null in any of the three link nothing and are left out; repeats are harmless."""
    links = links.select("kind", "record_id", "value").dropna()
    for seed in range(4):
        rec = F.xxhash64(F.lit(seed), F.lit("r"), "kind", "record_id")
        val = F.xxhash64(F.lit(seed), F.lit("v"), "kind", "value")
        edges = durable(links.select(rec.alias("r"), val.alias("v"), "kind", "record_id", "value"))
        clash = (
            edges.select(F.col("r").alias("h"), F.struct(F.lit("r"), "kind", "record_id").alias("x"))
            .union(edges.select("v", F.struct(F.lit("v"), "kind", "value")))
            .groupBy("h")
            .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
            .filter("lo <> hi")
        )
        if clash.limit(1).count() == 0:
            break
    else:
        raise RuntimeError("64-bit ids clash under four seeds")
    roots = connected_components(edges.select("r", "v"), max_edges)
    records = edges.select("r", "kind", "record_id").distinct()
    rooted = durable(records.join(roots.withColumnRenamed("node", "r"), "r", "left").withColumn("root", F.coalesce("root", "r")).drop("r"))
    groups = rooted.groupBy("root").agg(F.min("record_id").alias("group_id"), F.count("*").alias("members"))
    return salted_join(rooted, groups, "root").select("kind", "record_id", "group_id", "members")


def component_links(component_events: DataFrame) -> DataFrame:
    """A component holds an event id: trimmed, compared as a whole number of any length; what is no whole number gives no link."""
    text = F.regexp_replace("event_id", r"^\s+|\s+$", "")
    number = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    number = F.when(number == "-0", "0").otherwise(number)
    return component_events.filter(text.rlike(r"^[+-]?[0-9]+$")).select(F.lit("component").alias("kind"), F.col("component_id").alias("record_id"), number.alias("value"))


def story_links(clusters: DataFrame) -> DataFrame:
    """A story holds its mention identifiers: trimmed, case ignored, null and blank left out."""
    value = F.lower(F.regexp_replace("v", r"^\s+|\s+$", ""))
    return clusters.select(F.lit("story").alias("kind"), F.col("cluster_id").alias("record_id"), F.explode("mention_identifiers").alias("v")).select("kind", "record_id", value.alias("value")).filter("value <> ''")
