"""Similarity merge of clusters: candidate pairs are joins; the gated unions, whose gates look at the state of the union so far, are
replayed in one canonical order (mention pairs first, then theme pairs, each by the clusters' ids)."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..runtime import HOT, durable, large_side, small_side, spread_join
from ..settings import DEFAULTS, Settings
from .graph import star_components

#: Clusters of one value from which its tile is split into blocks of about that many, and the width of the hashed vectors that bound an overlap.
TILE, WIDTH = 8_192, 256


def _coded(items: DataFrame) -> DataFrame:
    """(df, code) of items (v) with their other columns: df is the number of items with the value, and codes rise with (df, v), so a value
    has one code and rarer ones have smaller codes. Values of very many items are few; they are joined apart, so no task gets all of their rows."""
    df = items.groupBy("v").agg(F.count("*").alias("df")).orderBy("df", "v")
    codes = durable(df.withColumn("code", F.monotonically_increasing_id()))
    hot = small_side(codes.filter(F.col("df") > TILE))
    few = items.join(small_side(codes.filter(F.col("df") > TILE).select("v")), "v", "left_anti").join(large_side(codes.filter(F.col("df") <= TILE)), "v")
    return items.join(hot, "v").unionByName(few).select(*(c for c in items.columns if c != "v"), "df", "code")


def _tiles(batches):
    """The tiles of a partition, which stand one after the other: each one's batches with its code and whether its blocks differ."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype("int64") for k in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, e in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[:, a].tolist())
            if key != at and held:
                yield at[0], at[1] != at[2], held
                held = []
            at = key
            held.append(batch.slice(a, e - a))
    if held:
        yield at[0], at[1] != at[2], held


def _places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of the elements of rows that begin at ``start`` and have ``length`` elements."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - length - start, length)


def _met(enough):
    """Pairs of clusters that meet in the tiles of a partition, with their overlap and sizes, if ``enough`` (overlap, sizes of both) says so. Products of
    hashed vectors, never below the overlap, leave few pairs, whose overlap is counted. Each pair is told in the tile of the rarest value
    that both have and in no other, so nothing has to be made distinct."""
    import pyarrow as pa

    def run(batches):
        for tile, apart, held in _tiles(batches):
            if sum(b.num_rows for b in held) < 2:
                continue
            side, ids, sets = (pa.chunked_array([b.column(k) for b in held]).combine_chunks() for k in (3, 4, 5))
            names, rank = np.unique(np.array(ids.to_pylist(), object), return_inverse=True)
            size = np.diff(sets.offsets.to_numpy()).astype("int64")
            begin = np.cumsum(size) - size
            known, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            here = int(np.searchsorted(known, tile))
            spot = np.repeat(np.arange(len(size)), size) * WIDTH + code % WIDTH
            vec = np.bincount(spot, minlength=len(size) * WIDTH).reshape(-1, WIDTH).astype("float32")
            side = side.to_numpy(zero_copy_only=False)
            one, two = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if apart else (np.arange(len(size)),) * 2
            for i in range(0, len(one), 1_024):
                p = one[i : i + 1_024]
                for j in range(0 if apart else i, len(two), 1_024):
                    q = two[j : j + 1_024]
                    x, y = np.nonzero(enough(vec[p] @ vec[q].T, size[p][:, None], size[q][None, :]))
                    x, y = p[x], q[y]
                    some = (rank[x] != rank[y]) & (apart | (x < y))
                    x, y = x[some], y[some]
                    x, y = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
                    most = max(1, 2_000_000 // int(size.max()))
                    for k in range(0, len(x), most):
                        u, v = x[k : k + most], y[k : k + most]
                        own, other = (np.repeat(np.arange(len(z)), size[z]) * len(known) + code[_places(begin[z], size[z])] for z in (u, v))
                        pair, value = np.divmod(np.intersect1d(own, other, assume_unique=True), len(known))
                        overlap = np.bincount(pair, minlength=len(u))
                        least = np.full(len(u), len(known))
                        np.minimum.at(least, pair, value)
                        kept = (least == here) & enough(overlap, size[u], size[v])
                        u, v = u[kept], v[kept]
                        yield pa.RecordBatch.from_arrays([pa.array(names[rank[u]], pa.string()), pa.array(names[rank[v]], pa.string()), pa.array(overlap[kept].astype("int64")), pa.array(size[u]), pa.array(size[v])], ["a", "b", "overlap", "size_a", "size_b"])

    return run


def _pairs(sets: DataFrame, enough) -> DataFrame:
    """(a, b, overlap, size_a, size_b), a < b, of sets (cluster_id, set, reach) that share a value among the first ``reach`` of both, rarest first, and
    are ``enough`` alike. Sets meet in the tile of such a value; that of a value which more than ``TILE`` sets bring is split: sets fall
    into blocks by their id, and each two blocks are a tile. Pairs are compared where they meet; only those that count leave the task."""
    sets = durable(sets.filter("cluster_id is not null and reach > 0"))
    met = sets.select("cluster_id", "set", F.explode(F.slice("set", F.lit(1), F.col("reach"))).alias("code"))
    blocks = small_side(durable(met.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("code", F.ceil(F.col("n") / TILE).cast("int").alias("g"))))
    spread = met.join(blocks, "code", "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cluster_id"), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    tiles = spread.select("code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cluster_id", "set")
    ordered = tiles.repartition("code", "i", "j").sortWithinPartitions("code", "i", "j")
    return ordered.mapInArrow(_met(enough), "a string, b string, overlap long, size_a long, size_b long")


def mention_pairs(clusters: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(a, b, overlap), a < b: clusters that share at least the minimum of distinct mention addresses.

    Of the minimum of m shared addresses the rarest is not among a cluster's m - 1 commonest, so clusters meet by all but those: an
    address that very many clusters have brings none together unless it must. Overlaps are counted over all addresses."""
    least = max(1, s.mention_overlap_min)
    items = clusters.select("cluster_id", F.explode(F.array_distinct("mention_identifiers")).alias("v")).filter("v is not null")
    sets = _coded(items).groupBy("cluster_id").agg(F.array_sort(F.collect_set("code")).alias("set")).withColumn("reach", F.size("set") - (least - 1))
    return _pairs(sets, lambda overlap, a, b: overlap >= least).select("a", "b", "overlap")


def theme_pairs(clusters: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(a, b, jaccard), a < b: clusters whose theme sets (cut to the first ``max_themes``) have a Jaccard similarity strictly above the
    threshold t. Candidates share a theme that at most max(2, floor(n * max_theme_df)) clusters have; the similarity counts all themes.

    The rarest theme that a similar pair shares is among the first n - floor(t * n) themes, rarest first, of either one's n, and it is rare
    itself if any shared theme is; so clusters meet by these alone."""
    n, t = clusters.count(), s.jaccard_threshold
    most = max(2, int(n * s.max_theme_df))
    first = F.slice("themes", 1, s.max_themes) if s.max_themes else F.col("themes")
    own = durable(clusters.select(F.monotonically_increasing_id().alias("row"), "cluster_id", F.array_distinct(first).alias("vs")))
    # rows go by number until their sets are made: ids would be most of what is shuffled
    coded = _coded(own.select("row", F.explode("vs").alias("v")).filter("v is not null"))
    sets = coded.groupBy("row").agg(F.array_sort(F.collect_list("code")).alias("set"), F.count_if(F.col("df") <= most).cast("int").alias("rare"))
    sets = sets.withColumn("reach", F.least("rare", F.size("set") - F.floor(F.size("set") * t - 1e-9).cast("int")))
    sets = sets.join(large_side(own.select("row", "cluster_id")), "row").select("cluster_id", "set", "reach")
    pairs = _pairs(sets, lambda overlap, a, b: overlap > t * (a + b - overlap) - 1e-6)
    return pairs.withColumn("jaccard", F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).filter(F.col("jaccard") > t).select("a", "b", "jaccard")


def gap_gate(a: str, b: str, s: Settings = DEFAULTS) -> Column:
    """Whether two date envelopes are close enough; a missing bound lets the pair pass."""
    gap = scalars.day_gap(f"{a}.event_date_ref_start", f"{a}.event_date_ref_end", f"{b}.event_date_ref_start", f"{b}.event_date_ref_end")
    return gap.isNull() | (gap <= s.max_day_gap)


def type_gate(a: str, b: str) -> Column:
    """Whether two lists of action types share one; an empty or missing list lets the pair pass."""
    x, y = F.col(f"{a}.dominant_event_types"), F.col(f"{b}.dominant_event_types")
    return (F.coalesce(F.size(x), F.lit(0)) <= 0) | (F.coalesce(F.size(y), F.lit(0)) <= 0) | F.arrays_overlap(x, y)


def _day(v) -> datetime | None:
    try:
        return datetime.strptime(str(int(v)), "%Y%m%d") if v is not None else None
    except ValueError:
        return None


class _Unions:
    """Union-find that keeps each union's date envelope, action types and evidence."""

    def __init__(self, s: Settings):
        self.parent: dict[str, str] = {}
        self.state: dict[str, list] = {}
        self.s = s

    def add(self, cluster_id: str, start, end, types) -> None:
        self.parent[cluster_id] = cluster_id
        self.state[cluster_id] = [_day(start), _day(end), set(types or ()), []]

    def root(self, x: str) -> str:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def offer(self, a: str, b: str, overlap: int | None, jaccard: float | None) -> None:
        a, b = self.root(a), self.root(b)
        if a == b:
            return
        (s0, e0, t0, v0), (s1, e1, t1, v1) = self.state[a], self.state[b]
        gap = None if None in (s0, e0, s1, e1) else max(0, (s1 - e0).days, (s0 - e1).days)
        if gap is not None and gap > self.s.max_day_gap:
            return
        shared = sorted(t0 & t1)
        if t0 and t1 and not shared:
            return
        seen = {"mention_overlap": overlap, "jaccard": None if jaccard is None else round(jaccard, 4), "date_gap_days": gap, "shared_action_type": shared[0] if shared else None}
        keep, drop = min(a, b), max(a, b)
        self.parent[drop] = keep
        both = lambda f, x, y: f(v for v in (x, y) if v is not None) if x is not None or y is not None else None
        self.state[keep] = [both(min, s0, s1), both(max, e0, e1), t0 | t1, (v0 + v1 + [seen])[: self.s.evidence]]


_MOVED = "cluster_id string, root string, evidence array<struct<mention_overlap:int,jaccard:double,date_gap_days:int,shared_action_type:string>>"


def _replayed(s: Settings):
    """Unions of the groups of a partition, which stand one after the other: first a group's clusters, then its pairs in order. What is held is
    one group's clusters; pairs stream by."""
    import pyarrow as pa

    kind = pa.schema([("cluster_id", pa.string()), ("root", pa.string()), ("evidence", pa.list_(pa.struct([("mention_overlap", pa.int32()), ("jaccard", pa.float64()), ("date_gap_days", pa.int32()), ("shared_action_type", pa.string())])))])

    def told(unions: _Unions):
        rows = [{"cluster_id": c, "root": r, "evidence": unions.state[r][3]} for c in unions.parent for r in [unions.root(c)]]
        for k in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_pylist(rows[k : k + 20_000], kind)

    def run(batches):
        group, unions = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group:
                    if unions is not None:
                        yield from told(unions)
                    group, unions = r["group"], _Unions(s)
                if r["kind"] < 0:
                    unions.add(r["a"], r["start"], r["end"], r["types"])
                else:
                    unions.offer(r["a"], r["b"], r["overlap"], r["jaccard"])
        if unions is not None:
            yield from told(unions)

    return run


def merge_roots(clusters: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(cluster_id, root, evidence) of every cluster; the root is the least id of its union.

    Unions never leave a connected group of pairs, so groups are replayed independently, each by one task that holds the clusters of the
    group it is at and streams its pairs; nothing comes to the driver."""
    m = mention_pairs(clusters, s).select("a", "b", F.lit(0).alias("kind"), F.col("overlap").cast("int").alias("overlap"), F.lit(None).cast("double").alias("jaccard"))
    pairs = durable(m.union(theme_pairs(clusters, s).select("a", "b", F.lit(1), F.lit(None).cast("int"), "jaccard")))
    coded = durable(pairs.withColumn("u", F.xxhash64("a")).withColumn("v", F.xxhash64("b")))
    groups = large_side(durable(star_components(coded.select("u", "v"), "u", "v")))
    ends = coded.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("a").alias("cluster_id")), F.struct(F.col("v").alias("node"), F.col("b").alias("cluster_id")))).alias("x")).select("x.*").distinct()
    empty = {"b": F.lit(None).cast("string"), "kind": F.lit(-1), "overlap": F.lit(None).cast("int"), "jaccard": F.lit(None).cast("double")}
    own = clusters.select("cluster_id", F.col("event_date_ref_start").alias("start"), F.col("event_date_ref_end").alias("end"), F.col("dominant_event_types").alias("types"))
    nodes = own.join(large_side(ends.join(groups, "node")), "cluster_id").select(F.col("root").alias("group"), F.col("cluster_id").alias("a"), *(c.alias(n) for n, c in empty.items()), "start", "end", "types")
    hubs = durable(coded.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("u"))
    links = spread_join(coded, groups.withColumnRenamed("node", "u"), "u", hubs).select(F.col("root").alias("group"), "a", "b", "kind", "overlap", "jaccard", F.lit(None).cast(own.schema["start"].dataType).alias("start"), F.lit(None).cast(own.schema["end"].dataType).alias("end"), F.lit(None).cast("array<string>").alias("types"))
    ordered = nodes.union(links).repartition("group").sortWithinPartitions("group", "kind", "a", "b")
    found = ordered.mapInArrow(_replayed(s), _MOVED)
    return clusters.select("cluster_id").join(large_side(found), "cluster_id", "left").withColumn("root", F.coalesce("root", "cluster_id"))
