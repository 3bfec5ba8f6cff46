"""All similar pairs between set-valued records: a size-aware overlap join.

Sets of up to ``small`` tokens meet through their threshold-sized token subsets: two of them are similar only if they share a
subset of the size that their two sizes demand. Pairs with a larger set meet through inverted lists, scanned over the rarest
tokens that a similar partner cannot all miss. Both candidate streams are cut by a bitmap bound and ended by exact intersection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, hot_join, salted_join

#: Largest set that meets others through token subsets; beyond it their number grows too fast.
SMALL = 8


def clean_value(c: Column | str) -> Column:
    """Trimmed of any white space, lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def token_sets(df: DataFrame, record: str, values: str, kind: str | None = None) -> DataFrame:
    """(record_id, token): the distinct cleaned values of an array column as 64-bit hashes, null and blank left out. Values of different
    ``kind`` (a column) are different tokens, so sets of several columns can be compared in one go. Hashes are checked for
    clashes over all values and made anew with another seed if two values have one."""
    item = df.select(F.col(record).alias("record_id"), (F.col(kind) if kind else F.lit("")).alias("kind"), F.explode(values).alias("v")).withColumn("v", clean_value("v"))
    item = durable(item.filter("record_id is not null and v <> ''").distinct())
    for seed in range(4):
        hashed = item.withColumn("token", F.xxhash64(F.lit(seed), "kind", "v"))
        if hashed.groupBy("token").agg(F.min(F.struct("kind", "v")).alias("lo"), F.max(F.struct("kind", "v")).alias("hi")).filter("lo <> hi").limit(1).count() == 0:
            return hashed.select("record_id", "token")
    raise RuntimeError("64-bit ids clash under four seeds")


def bitmap(tokens: str, words: int = 4) -> Column:
    """A bitmap signature of 64 * ``words`` bits: each token sets one bit. |A and B| is at most (|A| + |B| - bits that differ) / 2."""
    word = "aggregate(filter({0}, t -> pmod(shiftright(t, 6), {1}) = {2}), 0L, (a, t) -> a | shiftleft(1L, cast(pmod(t, 64) as int)))"
    return F.array(*(F.expr(word.format(tokens, words, w)) for w in range(words)))


def differing_bits(a: str, b: str, words: int = 4) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{w}] ^ {b}[{w}])" for w in range(words)))


def classes_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From distinct (record_id, token): classes (cid, size, tokens rarest first, bits) of equal sets, and membership (record_id, cid).

    Rarity is the number of records that hold the token, over all records; ties are broken by the token."""
    df = items.groupBy("token").agg(F.count("*").alias("df"))
    ranked = salted_join(items, df, "token", salts=8)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
    lists = durable(ranked.groupBy("record_id").agg(ordered.alias("tokens")))
    for seed in range(4):
        sets = lists.withColumn("cid", F.xxhash64(F.lit(seed), "tokens"))
        classes = sets.groupBy("cid").agg(F.min("tokens").alias("tokens"), F.max("tokens").alias("other"))
        if classes.filter("tokens <> other").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("64-bit ids clash under four seeds")
    return durable(classes.select("cid", F.size("tokens").alias("size"), "tokens", bitmap("tokens").alias("bits"))), sets.select("record_id", "cid")


def needed(a: int, b: int, t: float) -> int:
    """Least overlap of sets of a and b tokens whose Jaccard similarity is at least t."""
    return ceil(t * (a + b) / (1 + t) - 1e-9)


@cache
def _plans(size: int, small: int, t: float) -> list[tuple[int, int, np.ndarray]]:
    """(least size, largest size, positions) of the subsets by which a set of this size meets partners of up to ``small`` tokens."""
    out = []
    for other in range(1, small + 1):
        c = needed(size, other, t)
        if c <= min(size, other):
            out.append((min(size, other), max(size, other), np.array(list(combinations(range(size), c)))))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype("uint64")
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _subset_keys(small: int, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                toks = _mix(flat[start[own][:, None] + np.arange(n)])
                for lo, hi, at in _plans(int(n), small, t):
                    key = _mix(toks[:, at].sum(axis=2, dtype="uint64") + np.uint64(lo * 1000 + hi)).view("int64")
                    who = np.repeat(cid[own], at.shape[0])
                    for k in range(0, len(who), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()[k : k + 50_000]), pa.array(who[k : k + 50_000]), pa.array(np.full(len(who[k : k + 50_000]), n, "int32"))], ["key", "cid", "size"])

    return run


def similar_classes(classes: DataFrame, t: float, small: int = SMALL) -> DataFrame:
    """(cid_a, cid_b, overlap, union), cid_a < cid_b: pairs of different sets with a Jaccard similarity of at least ``t``. A subset or a token
    that very many sets share is joined in blocks (``hot_join``)."""
    small_sets, near = classes.filter(F.col("size") <= small), classes.filter(F.col("size") > small * t - 1e-9)
    keys = durable(small_sets.select("cid", "size", "tokens").mapInArrow(_subset_keys(small, t), "key long, cid long, size int"))
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "size"))) for s in "ab")
    fits = (F.col("size_a") >= F.col("size_b") * t - 1e-9) & (F.col("size_b") >= F.col("size_a") * t - 1e-9)
    by_subset = hot_join(a, b, "key").filter(fits & (F.col("cid_a") < F.col("cid_b"))).select("cid_a", "cid_b")
    spare = F.col("size") - F.ceil(F.col("size") * F.lit(t) - 1e-9) + 1
    lists = durable(near.select("cid", "size", "bits", F.posexplode(F.slice("tokens", 1, spare.cast("int"))).alias("pos", "token")))
    a, b = (lists.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("cid", "size", "bits", "pos"))) for s in "ab")
    least = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(t / (1 + t)) - 1e-9)
    ahead = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    bound = F.col("size_a") + F.col("size_b") - differing_bits("bits_a", "bits_b") >= 2 * least
    by_list = hot_join(a, b, "token").filter(fits & (F.col("cid_a") < F.col("cid_b")) & (F.greatest("size_a", "size_b") > small) & (ahead >= least) & bound).select("cid_a", "cid_b")
    pairs = durable(by_subset.union(by_list).distinct())
    toks = classes.select("cid", "tokens")
    both = pairs.join(toks.toDF("cid_a", "tokens_a"), "cid_a").join(toks.toDF("cid_b", "tokens_b"), "cid_b")
    common = both.withColumn("overlap", F.size(F.array_intersect("tokens_a", "tokens_b")))
    union = F.size("tokens_a") + F.size("tokens_b") - F.col("overlap")
    return common.select("cid_a", "cid_b", "overlap", union.alias("union")).filter(F.col("overlap") >= F.col("union") * F.lit(t) - 1e-9)


def similar_pairs(df: DataFrame, record: str, values: str, t: float = 0.7, small: int = SMALL, kind: str | None = None) -> DataFrame:
    """(record_a, record_b), record_a < record_b: all pairs of records whose value sets have a Jaccard similarity of at least ``t``.

    Values are compared trimmed and without case; null and blank ones, repeats, and records without a value make no pair. Equal
    sets are compared once, as one class; their pairs are listed by joining the members. Records of different ``kind`` (a column) make no
    pair."""
    classes, members = classes_of(token_sets(df, record, values, kind))
    return expand_pairs(similar_classes(classes, t, small), members)


def similar_pairs_between(left: DataFrame, right: DataFrame, record: str, values: str, t: float = 0.7, small: int = SMALL) -> DataFrame:
    """(record_a, record_b), record_a of ``left`` and record_b of ``right``: all pairs of records of two tables whose value sets have a Jaccard
    similarity of at least ``t``. Either table has the columns ``record`` and ``values``; the rest is as in ``similar_pairs``. Sets of both
    tables are ranked and compared together, so a set that stands in both is one class."""
    sided = left.select(F.struct(F.lit(0).alias("side"), F.col(record).cast("string").alias("id")).alias("r"), F.col(values).alias("v"), F.col(record).isNotNull().alias("known"))
    sided = sided.union(right.select(F.struct(F.lit(1).alias("side"), F.col(record).cast("string").alias("id")), F.col(values), F.col(record).isNotNull()))
    classes, members = classes_of(token_sets(sided.filter("known"), "r", "v"))
    members = durable(members)
    a, b = (members.filter(F.col("record_id.side") == k).select(F.col("record_id.id").alias(f"record_{x}"), F.col("cid").alias(f"cid_{x}")) for k, x in enumerate("ab"))
    pairs = similar_classes(classes, t, small).select("cid_a", "cid_b")
    both = pairs.union(pairs.select("cid_b", "cid_a")).union(classes.select("cid", "cid"))
    return both.join(a, "cid_a").join(b, "cid_b").select("record_a", "record_b")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All record pairs of similar classes and within classes. The result itself has these rows; nothing else is listed."""
    a, b = members.toDF("record_a", "cid_a"), members.toDF("record_b", "cid_b")
    across = pairs.select("cid_a", "cid_b").join(a, "cid_a").join(b, "cid_b")
    across = across.select(F.least("record_a", "record_b").alias("record_a"), F.greatest("record_a", "record_b").alias("record_b"))
    within = a.join(b, F.col("cid_a") == F.col("cid_b")).filter("record_a < record_b").select("record_a", "record_b")
    return across.union(within)
