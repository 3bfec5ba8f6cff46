"""Articles: fetching through an injected callable, extraction of title and text from html, batch enrichment by distinct address."""

from __future__ import annotations

import html as entities
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..settings import DEFAULTS

#: Largest article, in bytes, and the content types that are read.
LARGEST = 1_000_000
TYPES = ("text/html", "application/xhtml+xml")


def clean(text: str | None) -> str | None:
    """White space collapsed, entities resolved; None if nothing is left."""
    t = " ".join(entities.unescape(text or "").split())
    return t or None


class _Reader(HTMLParser):
    """Title and paragraphs. ``lose_open``: a paragraph that is still open when the next begins is lost, else it ends there."""

    def __init__(self, lose_open: bool):
        super().__init__(convert_charrefs=True)
        self.lose_open, self.og, self.title, self.paragraphs = lose_open, None, [], []
        self.in_title, self.buffer = False, None

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            a = {k: v for k, v in attrs}
            if "og:title" in (a.get("property"), a.get("name")) and clean(a.get("content")):
                self.og = a["content"]
        elif tag == "title":
            self.in_title = True
        elif tag == "p":
            if not self.lose_open:
                self.end_paragraph()
            self.buffer = []

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag == "p":
            self.end_paragraph()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.buffer is not None:
            self.buffer.append(data)

    def end_paragraph(self):
        if self.buffer is not None:
            t = clean("".join(self.buffer))
            if t:
                self.paragraphs.append(t)
            self.buffer = None


def extract(page: str | None, lose_open: bool = True) -> tuple[str | None, str | None]:
    """(title, content) of a page: og:title (named by ``property`` or ``name``, the last that says something) before title, paragraphs joined by a blank line; content is None if there is no paragraph."""
    r = _Reader(lose_open)
    try:
        r.feed(page or "")
        r.close()
    except AssertionError:
        pass
    if not lose_open:
        r.end_paragraph()
    return clean(r.og) or clean("".join(r.title)), "\n\n".join(r.paragraphs) or None


def extract_articles(pages: DataFrame, key: str = "page_id", html: str = "html", lose_open: bool = True) -> DataFrame:
    """(key, title, content, error) of pages; error says why there is no content. Null html has no content; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x.as_py(), lose_open) for x in batch.column(1)]
            error = [None if c else "no paragraphs" for _, c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string()), pa.array(error, pa.string())], [key, "title", "content", "error"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string, content string, error string")


def fetch_pages(urls: DataFrame, fetch: Callable[[str], tuple[str, bytes]], column: str = "url") -> DataFrame:
    """(url, html, error) of distinct URLs by a callable that gives (content type, body). Another type, a body over ``LARGEST`` bytes and any
    exception give an error and no html. The callable is sent to the workers."""

    def one(url: str) -> tuple[str | None, str | None]:
        try:
            kind, body = fetch(url)
            if kind.split(";")[0].strip().lower() not in TYPES:
                return None, f"not html: {kind}"
            if len(body) > LARGEST:
                return None, "too large"
            return body.decode("utf-8", "replace"), None
        except Exception as e:  # noqa: BLE001 - one page must not end the batch
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["url", "html", "error"])

    return urls.filter(F.col(column).isNotNull()).select(F.col(column).alias("url")).distinct().mapInArrow(run, "url string, html string, error string")


def ranked_urls(clusters: DataFrame, most: int = DEFAULTS.max_articles) -> DataFrame:
    """(cluster_id, url, rank): up to ``most`` addresses of a cluster, its mention addresses in their order and then its own, one a domain."""
    urls = F.filter(F.concat(F.coalesce("mention_identifiers", F.array().cast("array<string>")), F.array("source_url")), lambda u: u.isNotNull() & (u != ""))
    rows = clusters.select("cluster_id", F.posexplode(urls).alias("pos", "url")).withColumn("domain", scalars.domain("url"))
    first = F.row_number().over(Window.partitionBy("cluster_id", "domain").orderBy("pos"))
    rows = rows.withColumn("n", first).filter("n = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos"))).filter(F.col("rank") <= most).select("cluster_id", "url", "rank")


def combine_articles(ranked: DataFrame, articles: DataFrame) -> DataFrame:
    """(cluster_id, title, content, urls): the readable articles of a cluster in rank order, joined; the title of the first."""
    rows = ranked.join(articles.filter("content is not null"), "url").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "title", "content"))).alias("a"))
    return rows.select("cluster_id", F.col("a")[0]["title"].alias("title"), F.array_join(F.transform("a", lambda x: x["content"]), "\n\n---\n\n").alias("content"), F.transform("a", lambda x: x["url"]).alias("urls"))


def parse_reply(column: str, schema: str) -> Column:
    """A service's JSON reply, with or without code fences, as a struct of the given schema; null if it is no such JSON."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(column), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.from_json(plain, schema, {"mode": "PERMISSIVE"})
