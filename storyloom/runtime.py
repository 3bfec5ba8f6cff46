"""Session set-up, table loading and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("storyloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, else (tests, local mode) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="storyloom-")
    return f"file://{_LOCAL}"


_LOCAL: str | None = None


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: what follows neither recomputes it nor depends on the
    executors that made it. The written schema is given to the reader, so nothing is inferred."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/storyloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete what ``durable`` wrote for this application. To be called when no result that rests on it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/storyloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))


def _salt(df: DataFrame, salts) -> Column:
    """A salt from what is in the row, so that a task that runs again gives each row the same one."""
    return F.pmod(F.xxhash64(F.lit(7), *df.columns), salts).cast("int")


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join on ``key`` where one key may hold a large part of ``many``.

    Rows of ``many`` are spread over ``salts`` sub-keys and ``few`` (unique on ``key``) is repeated for each of them, so no
    task gets more than about 1/``salts`` of a hot key (copies of one row stay together). ``how`` is inner or left (seen from ``many``)."""
    left = many.withColumn("__salt", _salt(many, F.lit(salts)))
    right = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


#: Rows of a key from which a join spreads them over salts.
HOT = 50_000


def spread_join(many: DataFrame, few: DataFrame, key: str, hot: DataFrame, salts: int = 16) -> DataFrame:
    """Inner equi-join like ``salted_join``, but only keys in ``hot`` (those with more than ``HOT`` rows of ``many``; its rows are read several times)
    are spread and repeated, so the other rows of ``few`` are shuffled once and not ``salts`` times."""
    if hot.limit(1).count() == 0:
        return many.join(few, key)
    keys = small_side(hot.select(key, F.lit(True).alias("__hot")))
    left = many.join(keys, key, "left").withColumn("__salt", F.when(F.col("__hot"), _salt(many, F.lit(salts))).otherwise(0))
    right = few.join(keys, key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.drop("__hot").join(large_side(right.drop("__hot")), [key, "__salt"]).drop("__salt")


def hot_join(a: DataFrame, b: DataFrame, key: str, most: int = 2_000) -> DataFrame:
    """Inner equi-join of two tables in which one key may hold a large part of both, for instance of a table with itself.

    Keys with more than ``most`` rows of ``a`` are counted out first; their rows fall into g blocks on either side, and each pair of blocks is
    a sub-key of its own, so no task compares more than about ``most`` rows with as many. Rows of other keys are joined as they are."""
    blocks = a.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("__g"))
    blocks = small_side(durable(blocks))

    def spread(df: DataFrame, mine: str, other: str) -> DataFrame:
        wide = df.join(blocks, key, "left").withColumn("__g", F.coalesce("__g", F.lit(1)))
        return wide.withColumn(mine, _salt(df, F.col("__g"))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__g") - 1))).drop("__g")

    return spread(a, "__i", "__j").join(spread(b, "__j", "__i"), [key, "__i", "__j"]).drop("__i", "__j")


def large_side(df: DataFrame) -> DataFrame:
    """``df``, for tables that grow with the input: joins with it shuffle and merge. Left to itself Spark takes the bytes of compressed files or of a
    shuffle for the size of a table, and broadcasts what is many times that in the driver."""
    return df.hint("merge")


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``rows`` rows (for narrow rows: a few MB), which is counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
