import random

import pytest

from storyloom import runtime
from storyloom.llm import setjoin


def brute(rows, t):
    sets = {i: {v.strip().lower() for v in vs if v and v.strip()} for i, vs in rows if i is not None and vs}
    ids = sorted(i for i, s in sets.items() if s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("small,t", [(8, 0.7), (0, 0.7), (30, 0.7), (5, 0.5), (6, 0.9)])
def test_pairs_equal_brute_force(spark, small, t):
    rng = random.Random(small)
    rows = []
    for k in range(60):
        base = rng.sample(range(40 if k % 2 else 400), rng.choice([1, 2, 3, 5, 8, 9, 12, 20]))
        for j in range(3):
            s = set(base)
            for _ in range(j):
                s ^= {rng.randint(0, 40)}
            rows.append((f"r{k}-{j}", [rng.choice([f"T{v}", f" t{v} "]) for v in s] + rng.choice([[], [None], ["  "]])))
    rows += [("empty", []), ("null", None), ("same1", ["x", "y"]), ("same2", ["Y", "x", "x"])]
    df = spark.createDataFrame(rows, "id string, vals array<string>")
    got = [tuple(r) for r in setjoin.similar_pairs(df, "id", "vals", t, max(1, small)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, t)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "id string, vals array<string>, tokens int, cid int")
    assert setjoin.similar_pairs(df, "id", "vals").count() == 0
    df = spark.createDataFrame([("a", ["x"], 1, 2), ("b", ["X"], 3, 4)], "id string, vals array<string>, tokens int, cid int")
    assert [tuple(r) for r in setjoin.similar_pairs(df, "id", "vals").collect()] == [("a", "b")]


@pytest.mark.parametrize("most", [3, 2_000])
def test_pairs_between_tables_and_hot_tokens(spark, monkeypatch, most):
    monkeypatch.setattr(setjoin, "hot_join", lambda a, b, key: runtime.hot_join(a, b, key, most))
    rng = random.Random(9)
    rows = [(f"r{k}", ["hot", *(f"t{v}" for v in rng.sample(range(9), rng.randint(0, 3))), *(f"u{v}" for v in rng.sample(range(30), rng.choice([0, 0, 9])))]) for k in range(70)] + [("none", None), (None, ["hot"]), ("blank", [" "])]
    a, b = rows[:40] + rows[-3:], rows[35:]
    frames = [spark.createDataFrame(x, "id string, vals array<string>").withColumn("side", setjoin.F.lit(1)) for x in (a, b)]
    clean = lambda xs: {i: {v.strip().lower() for v in vs if v and v.strip()} for i, vs in xs if i is not None and vs}
    x, y = clean(a), clean(b)
    want = {(i, j) for i, s in x.items() for j, t in y.items() if s and t and len(s & t) >= 0.7 * len(s | t) - 1e-9}
    got = [tuple(r) for r in setjoin.similar_pairs_between(*frames, "id", "vals", 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert setjoin.similar_pairs_between(frames[0], frames[1].limit(0), "id", "vals").count() == 0
