"""Page boilerplate: nearest-URL page differencing.

Pages of a host are put in order of their URL path; each is paired with the nearest before it, and the lines (paragraphs) of both are
aligned by their longest common subsequence. A line form that alignments of a host's pages find on both sides is shared on that host; it
is boilerplate if a fair part of its places lie outside the block that holds the article. It is deleted on all pages of the host."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import durable, salted_join
from . import residue
from .pages import digest, line_shape, main_block, paragraphs, parse

#: Pages before a page, in URL order, with which it is compared.
NEAR = 6
#: Pages, in URL order, that are compared in one go.
BLOCK = 1_000
#: Pages that a task takes apart in one go.
PAGES = 500
#: Longer lines shared by two article blocks tell by themselves that both are one article.
SHORT = 260
#: Least share of a form's places that lie outside the article's block.
OUTSIDE = 0.12

#: Share of the shorter article block's text from which two pages have one article.
COPY = 0.6

#: Flags of a line; the bits from _CHARS on count its characters.
_OUT, _SKIP, _LONG, _CHARS = 1, 2, 4, 3


def _host_path(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.netloc or "").lower().removeprefix("www."), u.path.rstrip("/")
    except ValueError:
        return "", url or ""


def _lists(columns: list[list], sizes: list[int]) -> list[pa.Array]:
    """Flat columns of longs as lists of the given sizes."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype="int64")]).astype("int32"))
    return [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int64())) for c in columns]


def _page_lines(models: residue.Models | None):
    """Lines of the html: hash of the text, form, and flags (outside the article's block; residue or empty; long; characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PAGES) for b in batches for k in range(0, b.num_rows, PAGES)):
            hosts, paths, sizes, hs, shapes, flags, texts, where = [], [], [], [], [], [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2)):
                host, path = _host_path(url)
                ps, _ = parse(page.as_py())
                main, site = main_block(ps), host.split(".")[0]
                for t, block in ps:
                    if t and models is not None:
                        texts.append(t)
                        where.append(len(hs))
                    hs.append(digest(t))
                    shapes.append(digest(line_shape(t, site)))
                    flags.append((_OUT if block != main else 0) | (0 if t else _SKIP) | _size(t))
                hosts.append(host)
                paths.append(path)
                sizes.append(len(ps))
            if texts:
                for k in np.flatnonzero(models.residue(texts)):
                    flags[where[k]] |= _SKIP
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), *_lists([hs, shapes, flags], sizes)], ["page_id", "host", "path", "h", "shape", "flags"])

    return run


def _size(text: str) -> int:
    return (_LONG if len(text) > SHORT else 0) | min(len(text), 1 << 24) << _CHARS


def _content_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of the content like lines of the html, the site's own name not masked."""
    for batch in (b.slice(k, PAGES) for b in batches for k in range(0, b.num_rows, PAGES)):
        texts = [[" ".join(p.split()) for p in paragraphs(c.as_py())] for c in batch.column(1)]
        own = [t for ts in texts for t in ts]
        flat = [[digest(t) for t in own], [digest(line_shape(t)) for t in own], [_size(t) for t in own]]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *_lists(flat, [len(ts) for ts in texts])], ["page_id", "h_own", "shape_own", "flags_own"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms and flags of the paragraphs of pages: those of the content if there is one, else the p elements. A paragraph of the content that
    is no p element counts as part of the article's block."""
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(3, 9)]
        shapes, flags = [], []
        for h, shape, flag, h_own, shape_own, flag_own in zip(*cols):
            if h_own is not None:
                of = dict(zip(h, zip(shape, flag)))
                both = [of.get(x, own) for x, *own in zip(h_own, shape_own, flag_own)]
                shape, flag = [x for x, _ in both], [y for _, y in both]
            shapes.append(shape)
            flags.append(flag)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shapes, pa.list_(pa.int64())), pa.array(flags, pa.list_(pa.int64()))], ["page_id", "host", "path", "shapes", "flags"])


def _one_article(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether two article blocks (flags by form) have most of the shorter one's text in common; one short line alone tells nothing."""
    both = a.keys() & b.keys()
    if len(both) < 2 and not any(a[s] & _LONG for s in both):
        return False
    text = lambda x, of: sum(x[s] >> _CHARS for s in of)
    return text(a, both) > COPY * min(text(a, a), text(b, b))


def _common(a: list[int], b: list[int]) -> set[int]:
    """The elements of a longest common subsequence, found as the longest rising run of the matching places (so the time goes with the number
    of matches, not with the product of the lengths)."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []  # least last place of a run of each length, and the match that ends it
    last: list[tuple] = []
    for x in a:
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            match = (x, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(match)
            else:
                ends[k], last[k] = j, match
    out, match = set(), last[-1] if last else None
    while match:
        out.add(match[0])
        match = match[1]
    return out


def _difference(near: int):
    """Over the pages of blocks, each in URL order: (host, form, pairs) by which alignments with the nearest pages of the host share a form.
    Two pages of one article (most text of the article's block shared) tell nothing and are passed over. Pages that only lead into a
    block are compared with, not by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        last: deque = deque(maxlen=near)
        at = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["site", "shape", "pairs"])

        for batch in batches:
            for block, site, lead, shapes, flags in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = [(s, f) for s, f in zip(shapes, flags) if not f & _SKIP]
                page = ([s for s, _ in own], {s: f for s, f in own if not f & _OUT})
                if (block, site) != at:
                    at = (block, site)
                    last.clear()
                for other in () if lead else last:
                    shared = _common(page[0], other[0])
                    if not shared or _one_article(page[1], other[1]):
                        continue
                    for s in shared:
                        found[site, s] = found.get((site, s), 0) + 1
                last.append(page)
            if len(found) > 500_000:
                yield told()
                found.clear()
        if found:
            yield told()

    return run


def page_table(pages: DataFrame, extracted: DataFrame, models: residue.Models | None) -> DataFrame:
    """(page_id, host, path, shapes, flags): what differencing needs of each page, forms as hashes."""
    longs = "array<bigint>"
    html = pages.select("page_id", "source_url", "html").filter("page_id is not null").mapInArrow(_page_lines(models), f"page_id long, host string, path string, h {longs}, shape {longs}, flags {longs}")
    content = extracted.select("page_id", "content").filter("page_id is not null").mapInArrow(_content_hashes, f"page_id long, h_own {longs}, shape_own {longs}, flags_own {longs}")
    both = html.join(content.dropDuplicates(), "page_id", "left")
    return both.mapInArrow(_numbered, f"page_id long, host string, path string, shapes {longs}, flags {longs}")


def _in_blocks(table: DataFrame, near: int) -> DataFrame:
    """(block, site, lead, shapes, flags): pages in URL order in blocks of ``BLOCK``, each led by the ``near`` pages before it, so that what a page is
    compared with does not depend on the partitions. Only keys are put in order; the place of a page is the number of pages in the ranges
    before its own (one count a range is joined) plus its place in the range."""
    keys = table.select("site", "path", "page_id", "row").repartitionByRange("site", "path", "page_id", "row").sortWithinPartitions("site", "path", "page_id", "row")
    keys = durable(keys.select("row", F.monotonically_increasing_id().alias("at"))).withColumn("range", F.shiftright("at", 33))
    counts = keys.groupBy("range").agg(F.count("*").alias("n"))
    begun = counts.withColumn("begun", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("range", "begun")
    rank = F.col("begun") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = keys.join(F.broadcast(begun), "range").select("row", rank.alias("rank"))  # one row a range of the shuffle
    own, late = F.floor(F.col("rank") / BLOCK), F.col("rank") % BLOCK >= BLOCK - near
    blocks = table.select("row", "site", "shapes", "flags").join(ranked, "row").withColumn("own", own).withColumn("block", F.explode(F.when(late, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    spread = blocks.select("block", "site", (F.col("block") > F.col("own")).alias("lead"), "shapes", "flags", "rank").repartition("block").sortWithinPartitions("block", "rank")
    return spread.select("block", "site", "lead", "shapes", "flags")


def boilerplate_forms(table: DataFrame, lines: DataFrame, near: int = NEAR, outside: float = OUTSIDE) -> DataFrame:
    """(site, shape) of the forms to delete on a host: shared by aligned pairs of its pages, and outside the article's block in at least a share
    ``outside`` of all their places on all hosts (what sites put around articles looks alike on many, and on one host a rare form has few places)."""
    pairs = _in_blocks(table, near).mapInArrow(_difference(near), "site long, shape long, pairs long").groupBy("site", "shape").agg(F.sum("pairs").alias("pairs"))
    places = lines.groupBy("shape").agg(F.count("*").alias("places"), F.sum(F.col("outside").cast("long")).alias("out"))
    kept = places.filter(F.col("out") >= F.col("places") * F.lit(outside)).select("shape")
    return pairs.select("site", "shape").join(kept, "shape", "left_semi")


def boilerplate_paragraphs(pages: DataFrame, extracted: DataFrame, models: residue.Models | None = None, spare_residue: bool = True) -> DataFrame:
    """(page_id, para_no) of the paragraphs that are no running text of the article.

    Paragraphs are those of content between blank lines, or the p elements of html for a page without a row in ``extracted``, counted from
    1. What stands in the article's place (see ``residue``) is no case, unless ``spare_residue`` is off (for callers that leave those pages out). Null or broken html and empty content give no paragraphs; pages
    without a URL form one host; repeated rows are listed once; empty tables give an empty result."""
    if spare_residue:
        models = models or residue.learn(extracted)
    table = durable(page_table(pages, extracted, models if spare_residue else None).withColumns({"site": F.xxhash64("host"), "row": F.monotonically_increasing_id()}).drop("host"))
    each = table.select("page_id", "site", F.posexplode(F.arrays_zip("shapes", "flags")).alias("at", "line"))
    flag = lambda bit: F.col("line.flags").bitwiseAND(F.lit(bit)) != 0
    lines = each.filter(~flag(_SKIP)).select("page_id", "site", (F.col("at") + 1).alias("para_no"), F.col("line.shapes").alias("shape"), flag(_OUT).alias("outside"))
    forms = boilerplate_forms(table, lines).select(F.struct("site", "shape").alias("form"))
    lines = lines.select("page_id", "para_no", F.struct("site", "shape").alias("form"))
    return salted_join(lines, forms, "form", salts=8).select("page_id", "para_no").distinct()
