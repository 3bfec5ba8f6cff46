"""Summaries and data-quality metrics over events and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lookups
from ..settings import DEFAULTS


def latest_stamps(events: DataFrame) -> DataFrame:
    return events.agg(F.max("sql_date").alias("latest_sql_date"), F.max("date_added").alias("latest_date_added"), F.count("global_event_id").alias("event_count"))


def top_since(events: DataFrame, column: str, since: int, n: int = DEFAULTS.top_n) -> DataFrame:
    """(code, count): the most frequent non-empty values since a day, ties by value."""
    kept = events.filter((F.col("sql_date") >= since) & F.col(column).isNotNull() & (F.col(column) != ""))
    return kept.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "code").limit(n)


def top_root_codes(events: DataFrame, since: int, n: int = DEFAULTS.top_n) -> DataFrame:
    return top_since(events, "event_root_code", since, n).withColumn("label", lookups.root_label_en("code"))


def score_quintiles(clusters: DataFrame) -> DataFrame:
    """(quintile, clusters, lowest, highest) of the topic score, ties by cluster_id. The rank of a score is found from counts per score, so no
    task orders all clusters: ranks inside a score go by id within that score only."""
    sizes = clusters.filter("topic_score is not null").groupBy("topic_score").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("t")).scalar()
    upto = sizes.withColumn("before", F.sum("n").over(Window.orderBy("topic_score").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = clusters.join(upto, "topic_score").withColumn("r", F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("topic_score").orderBy("cluster_id")))
    big, rest = F.floor(total / 5) + 1, total % 5
    tile = F.when(F.col("r") <= rest * big, F.ceil(F.col("r") / big)).otherwise(rest + F.ceil((F.col("r") - rest * big) / F.greatest(F.floor(total / 5), F.lit(1))))
    return ranked.withColumn("quintile", tile.cast("int")).groupBy("quintile").agg(F.count("*").alias("clusters"), F.min("topic_score").alias("lowest"), F.max("topic_score").alias("highest"))


def duplicate_ids(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def daily_volume(events: DataFrame) -> DataFrame:
    return events.groupBy("sql_date").agg(F.count("*").alias("events"), F.countDistinct("global_event_id").alias("distinct_events"))


def item_counts(clusters: DataFrame, column: str, n: int = DEFAULTS.top_n) -> DataFrame:
    """(value, clusters): how many clusters have a value in a list column, most first, ties by value."""
    x = clusters.select("cluster_id", F.explode(column).alias("value")).filter("value is not null").distinct()
    return x.groupBy("value").agg(F.count("*").alias("clusters")).orderBy(F.desc("clusters"), "value").limit(n)
