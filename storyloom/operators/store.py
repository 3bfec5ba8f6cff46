"""Tables as they change: insert-ignore, upsert, deletes, retention, logs. Every operator gives the new content of a table; ``Snapshots``
keeps it on disk."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_ignore(table: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Table plus those rows of the batch whose key it lacks; of several in the batch the first by ``order`` is taken. Rows with a null key are
    not inserted. What is in the table is never changed."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    new = batch.filter(F.col(key).isNotNull()).withColumn("__n", first).filter("__n = 1").drop("__n").join(table.select(key), key, "left_anti")
    return table.unionByName(new.select(table.columns))


def upsert(table: DataFrame, batch: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Rows of the batch replace those of the table with the same key, but the columns in ``kept`` (and those the batch lacks) survive where the
    table has the row. The key is unique on either side."""
    given = [c for c in batch.columns if c != key]
    new = batch.select(key, *(F.col(c).alias(f"__{c}") for c in given), F.lit(True).alias("__new"))
    old = table.withColumn("__old", F.lit(True))
    both = old.join(new, key, "full_outer")
    out = []
    for c in table.columns:
        if c == key or c not in given:
            out.append(F.col(c))
        elif c in kept:
            out.append(F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c))
        else:
            out.append(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def retain(table: DataFrame, column: str, cutoff) -> DataFrame:
    """Rows at or after the cutoff; rows without a value stay."""
    return table.filter((F.col(column) >= cutoff) | F.col(column).isNull())


def drop_terminal(components: DataFrame, memberships: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Components and memberships without the merged and split components last seen before the cutoff."""
    gone = components.filter(F.col("status").isin("merged", "split") & (F.col("last_seen_at") < F.lit(cutoff).cast("timestamp")))
    return delete_keys(components, gone, "component_id"), delete_keys(memberships, gone, "component_id")


def change_status(table: DataFrame, key: str, updates: DataFrame, expected: list[str], column: str = "enrichment_status") -> DataFrame:
    """Compare-and-set: rows named by updates (key, new_status) take the new status if theirs is an expected one; the rest stays."""
    u = updates.select(key, F.col("new_status").alias("__to")).dropDuplicates([key])
    both = table.join(u, key, "left")
    return both.withColumn(column, F.when(F.col("__to").isNotNull() & F.col(column).isin(expected), F.col("__to")).otherwise(F.col(column))).select(table.columns)


def release_stale(table: DataFrame, now: str, minutes: int = 15) -> DataFrame:
    """Rows in processing without a result whose lease is older than ``minutes`` go back to pending."""
    old = F.col("computed_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    stale = (F.col("enrichment_status") == "processing") & F.col("enriched_at").isNull() & old
    return table.withColumn("enrichment_status", F.when(stale, "pending").otherwise(F.col("enrichment_status")))


def latest(log: DataFrame, by: str, *where) -> DataFrame:
    """The log's row with the greatest ``by`` (ties: the greatest row as a whole)."""
    for w in where:
        log = log.filter(w)
    return log.filter(F.col(by).isNotNull()).groupBy().agg(F.max_by(F.struct(*log.columns), F.col(by)).alias("r")).filter("r is not null").select("r.*")


class Snapshots:
    """A table as numbered snapshot folders with a pointer file that is replaced last: readers see the old content or the new, never a
    mixture, and a writer that dies leaves nothing behind that counts. For file systems with an atomic rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.removeprefix("file://")
        os.makedirs(self.path, exist_ok=True)

    def _pointer(self) -> str:
        return os.path.join(self.path, "_current.json")

    def exists(self) -> bool:
        return os.path.exists(self._pointer())

    def read(self) -> DataFrame:
        with open(self._pointer()) as f:
            return self.spark.read.parquet(os.path.join(self.path, json.load(f)["folder"]))

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        folder = f"v-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(os.path.join(self.path, folder))
        with open(self._pointer() + ".new", "w") as f:
            json.dump({"folder": folder}, f)
        os.replace(self._pointer() + ".new", self._pointer())
