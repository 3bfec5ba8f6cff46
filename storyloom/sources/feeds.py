"""The tab-separated feeds: manifests, zipped files and row parsers. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

# Fragments by which the manifests name the three feeds, least columns of a row, and the positions of the columns read.
FEEDS = {"events": ".export.CSV.zip", "mentions": ".mentions.CSV.zip", "documents": ".gkg.csv.zip"}
LEAST_COLUMNS = {"events": 61, "mentions": 14, "documents": 16}
EVENT_COLUMNS = [
    ("global_event_id", 0, "long"), ("sql_date", 1, "int"), ("actor1_country_code", 7, 3), ("actor2_country_code", 17, 3), ("event_code", 26, "string"), ("event_base_code", 27, "string"), ("event_root_code", 28, "string"),
    ("quad_class", 29, "int"), ("goldstein_scale", 30, "double"), ("num_mentions", 31, "int"), ("num_sources", 32, "int"), ("num_articles", 33, "int"), ("avg_tone", 34, "double"),
    ("action_geo_full_name", 52, "string"), ("action_geo_country_code", 53, 2), ("date_added", 59, "long"), ("source_url", 60, "string"),
]
MENTION_COLUMNS = [("global_event_id", 0, "long"), ("event_time_date", 1, "long"), ("mention_time_date", 2, "long"), ("mention_type", 3, "int"), ("mention_source_name", 4, "string"), ("mention_identifier", 5, "string"), ("mention_doc_len", 12, "int"), ("mention_doc_tone", 13, "double")]
REQUIRED = {"events": ("global_event_id", "sql_date", "date_added"), "mentions": ("global_event_id",), "documents": ()}


def manifest(lines: DataFrame, feed: str | None = None, column: str = "value") -> DataFrame:
    """(url, ts) of manifest lines "size md5 url"; lines of fewer parts, without a 14-digit stamp or of another feed are left out."""
    parts = F.split(F.trim(column), r"\s+")
    ts = F.regexp_extract(F.col("url"), r"/(\d{14})\.", 1)
    out = lines.filter(F.size(parts) >= 3).select(F.try_element_at(parts, F.lit(3)).alias("url")).filter(ts != "").withColumn("ts", ts.cast("long"))
    return out.filter(F.contains("url", F.lit(FEEDS[feed]))) if feed else out


def manifest_range(files: DataFrame, since: int, until: int) -> DataFrame:
    """Files with a stamp in [since, until], oldest first."""
    return files.filter(F.col("ts").between(since, until)).orderBy("ts", "url")


def latest_file(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("url", F.struct("ts", "url")).alias("url"), F.max("ts").alias("ts")).filter("url is not null")


def sidecars(events: DataFrame, others: DataFrame) -> DataFrame:
    """Event files with the file of another feed that has the same stamp, if there is one."""
    return events.join(others.select("ts", F.col("url").alias("sidecar_url")).groupBy("ts").agg(F.min("sidecar_url").alias("sidecar_url")), "ts", "left")


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held, n = [], 0
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    for line in z.read(name).decode("utf-8", "replace").splitlines():
                        n += 1
                        if line.strip():
                            held.append((n, line))
                        if len(held) >= 20_000:
                            yield _lines(path, held)
                            held = []
            yield _lines(path, held)


def _lines(path: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array([n for n, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string())], ["path", "line_no", "line"])


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of all members of the archives at ``path``; bytes that are no UTF-8 become U+FFFD, blank lines are left out, a
    broken archive is an error. One archive (15 minutes of a feed) is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_unzipped, "path string, line_no long, line string")


def columns_of(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines split at tabs, without quoting; ``cols`` is the row's fields. The split is generated as a row of its own, so that it is made once
    and not again for every column that is read from it."""
    return lines.select("*", F.explode(F.array(F.split(column, "\t", -1))).alias("cols"))


def parse_rows(split: DataFrame, feed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of the events or mentions feed. A row is dropped if it is too short, lacks a required number, or has text where a number
    belongs; blank fields are null, codes that are too long too. The fields that are read are trimmed once and numbers cast once, as one
    generated row; what could not be cast is told by the text beside it."""
    table = EVENT_COLUMNS if feed == "events" else MENTION_COLUMNS
    rows = split.filter(F.size("cols") >= LEAST_COLUMNS[feed])
    texts = F.transform(F.array(*(F.get("cols", F.lit(at)) for _, at, _ in table)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = rows.select(*keep, F.explode(F.array(texts)).alias("t"))
    text = {name: F.when(F.get("t", F.lit(i)) != "", F.get("t", F.lit(i))) for i, (name, _, _) in enumerate(table)}
    numbers = [name for name, _, kind in table if kind in ("int", "long", "double")]
    cast = F.struct(*(text[name].try_cast(kind).alias(name) for name, _, kind in table if name in numbers))
    rows = rows.select(*keep, "t", F.explode(F.array(cast)).alias("n"))
    bad = reduce(lambda a, b: a | b, (text[name].isNotNull() & F.col(f"n.{name}").isNull() for name in numbers))
    codes = {name: F.upper(text[name]) for name, _, kind in table if isinstance(kind, int)}
    value = lambda name, kind: F.col(f"n.{name}") if name in numbers else F.when(F.length(codes[name]) <= kind, codes[name]) if name in codes else text[name]
    kept = reduce(lambda a, b: a & b, (F.col(f"n.{name}").isNotNull() for name in REQUIRED[feed]), ~bad)
    return rows.filter(kept).select(*keep, *(value(name, kind).alias(name) for name, _, kind in table))


def parse_documents(split: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of the document feed: lists between semicolons, the tone is the first of the comma-joined figures (null if it is none)."""
    at = lambda i: F.try_element_at("cols", F.lit(i + 1))
    lists = (("themes", 7), ("locations", 9), ("persons", 11), ("organizations", 13))
    tone = scalars.number(F.split_part(F.coalesce(at(15), F.lit("")), F.lit(","), F.lit(1)), "double")
    rows = split.filter(F.size("cols") >= LEAST_COLUMNS["documents"])
    return rows.select(*keep, scalars.blank_to_null(at(0)).alias("gkg_record_id"), scalars.number(at(1), "long").alias("date"), scalars.blank_to_null(at(3)).alias("source_common_name"), scalars.blank_to_null(at(4)).alias("document_identifier"), *(scalars.semicolon_list(at(i)).alias(n) for n, i in lists), tone.alias("document_tone"))
