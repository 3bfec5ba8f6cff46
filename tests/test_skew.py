import random
from collections import Counter, defaultdict

from storyloom.runtime import hot_join, salted_join
from storyloom.operators import skew


def brute(rows):
    by = defaultdict(list)
    for k, v in rows:
        if k is not None:
            by[k].append(v)
    out = {}
    for k, vs in by.items():
        have = sorted(v for v in vs if v is not None)
        c = Counter(have)
        top = max(c.values()) if c else None
        q = lambda p: next((v for i, v in enumerate(have, 1) if i >= p * len(have) - 1e-9), None)  # noqa: E731, B023
        out[k] = (len(vs), len(have), len(c), min((v for v, n in c.items() if n == top), default=None), top, q(0.5), q(0.9))
    return out


def test_profile_equals_brute_force_with_hot_key_nulls_and_ties(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([None, 1, 2, 2, 5, 10_000, -3])) for _ in range(400)] + [(rng.choice(["a", "b", None]), rng.randint(0, 50)) for _ in range(200)] + [("none", None)] * 3
    df = spark.createDataFrame(rows, "key string, value int")
    got = {r.key: tuple(r)[1:] for r in skew.per_key_profile(df, "key", "value", buckets=7).collect()}
    assert got == brute(rows)


def test_profile_of_an_empty_table_and_of_clashing_columns(spark):
    df = spark.createDataFrame([], "key string, value int, n int, bucket string")
    assert skew.per_key_profile(df, "key", "value").count() == 0
    df = spark.createDataFrame([("a", 1, 9, "x")], "key string, value int, n int, bucket string")
    assert tuple(skew.per_key_profile(df, "key", "value").first()) == ("a", 1, 1, 1, 1, 1, 1, 1)


def test_heavy_keys_by_rows_and_by_weight(spark):
    df = spark.createDataFrame([("a", 5)] * 6 + [("b", 100)] + [(None, 1)] * 3 + [("c", None)], "k string, w int")
    assert {r.key: r.size for r in skew.heavy_keys(df, "k", 0.5).collect()} == {"a": 6}
    assert {r.key: r.size for r in skew.heavy_keys(df, "k", 0.5, "w").collect()} == {"b": 100}
    assert skew.heavy_keys(df.limit(0), "k", 0.1).count() == 0
    assert skew.heavy_keys(df.filter("k = 'c'"), "k", 0.1, "w").count() == 0


def test_joins_of_hot_keys_give_the_pairs_of_plain_ones(spark):
    rows = [(1, i) for i in range(60)] + [(2, i) for i in range(5)] + [(3, 1), (None, 4)]
    a, b = spark.createDataFrame(rows, "k int, x int"), spark.createDataFrame(rows, "k int, y int")
    want = sorted((k, x, y) for k, x in rows for j, y in rows if k == j and k is not None)
    for most in (1, 7, 1_000):
        assert sorted(tuple(r) for r in hot_join(a, b, "k", most).select("k", "x", "y").collect()) == want
    few = spark.createDataFrame([(1, "a"), (3, "c")], "k int, z string")
    assert salted_join(a, few, "k").count() == 61 and salted_join(a, few, "k", "left").count() == len(rows)
    assert hot_join(a.limit(0), b, "k").count() == 0
