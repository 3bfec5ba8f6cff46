"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are first grouped by (key, value), which map-side aggregation shrinks to one weighted row per pair and spreads a hot key
over as many reducers as it has values; per-key results then come from the weights. No task ever sees the raw rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import salted_join


def value_frequencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): how often each value occurs with each key. Null keys are left out; a null value is a value."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("n"))


def per_key_profile(df: DataFrame, key: str, value: str, quantiles: dict[str, float] | None = None, buckets: int = 256) -> DataFrame:
    """Exact per-key figures of a numeric ``value``: rows, non-null values, distinct values, the mode with its count (ties: the
    smallest value) and lower percentiles (the least value whose cumulative count reaches q * count), all from weighted values.

    A percentile is found in two steps so that even a key with very many distinct values is never in one task: weights are
    summed per (key, bucket of the key's value range), the bucket that holds the percentile is read from at most ``buckets`` sums,
    and only that bucket's values are ordered. Keys whose values are all null have 0 distinct values and null figures. An empty
    table gives an empty result; null keys are left out."""
    quantiles = quantiles or {"p50": 0.5, "p90": 0.9}
    freq = value_frequencies(df, key, value)
    totals = freq.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("n", (-F.col("value")).alias("least")))).alias("top"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    span = F.col("hi").cast("double") - F.col("lo").cast("double")
    at = F.when(span > 0, F.least(F.lit(buckets - 1), F.floor((F.col("value").cast("double") - F.col("lo").cast("double")) / span * buckets))).otherwise(0)
    known = salted_join(freq.filter("value is not null"), totals.select("key", "lo", "hi", "n_values"), "key").withColumn("bucket", at.cast("int"))
    sums = known.groupBy("key", "bucket").agg(F.sum("n").alias("held"), F.first("n_values").alias("n_values"))
    upto = F.sum("held").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in quantiles.items())))
    target = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("held")).withColumn("want", wanted)
    need = F.greatest(F.lit(1e-9), F.col("n_values") * F.col("want.q"))
    target = target.filter((F.col("before") < need) & (F.col("upto") >= need)).select("key", "bucket", "before", F.col("want.name").alias("name"), need.alias("need"))
    inside = known.select("key", "bucket", "value", "n").join(target, ["key", "bucket"])
    reach = F.col("before") + F.sum("n").over(Window.partitionBy("key", "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("reach", reach).filter("reach >= need").groupBy("key").agg(*(F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles))
    return totals.join(found, "key", "left").select("key", "n_rows", "n_values", "n_distinct", (-F.col("top.least")).alias("mode_value"), F.col("top.n").alias("mode_count"), *quantiles)


def heavy_keys(df: DataFrame, key: str, share: float, weight: str | None = None, value: str | None = None) -> DataFrame:
    """(key, size): keys that hold at least ``share`` of all rows (or of the sum of ``weight``; null weights count as 0).

    The total is over all rows, those with a null key included. Sizes come from value frequencies: rows are grouped by key and value (the
    weight, or for row counts the column ``value``), which spreads a hot key over as many reducers as it has values, and the weighted
    values give the size of the key. An empty table or a total of 0 gives an empty result."""
    own = F.col(weight or value) if weight or value else F.lit(0)
    freq = df.groupBy(F.col(key).alias("key"), own.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    held = F.coalesce(F.col("w").cast("long"), F.lit(0)) * F.col("n") if weight else F.col("n")
    sizes = freq.groupBy("key").agg(F.sum(held).alias("size"))
    total = sizes.agg(F.sum("size").alias("total")).scalar()
    return sizes.filter(F.col("key").isNotNull() & (F.col("size") > 0) & (F.col("size") >= total * F.lit(share)))
