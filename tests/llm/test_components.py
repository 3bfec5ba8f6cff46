import random

import numpy as np
import pytest

from storyloom.llm import components as c


def brute(pairs):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        p[find(a)] = find(b)
    groups = {}
    for x in list(p):
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_union_find_equals_brute_force():
    rng = random.Random(1)
    for n in (1, 5, 50, 400):
        pairs = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(n)]
        node, root = c.union_find(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        got = dict(zip(node.tolist(), root.tolist()))
        assert all(got.get(x, x) == r for x, r in brute(pairs).items())
    assert len(c.union_find(np.empty(0, "int64"), np.empty(0, "int64"))[0]) == 0


@pytest.mark.parametrize("max_edges", [10_000, 40])
def test_levels_and_settling(spark, max_edges):
    """With small bounds the forest never fits one task and the rounds by child and pointer jumps must finish it."""
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 640)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(150)] + [(7, 7), (None, 3), (1, 2)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    got = {r.node: r.root for r in c.connected_components(df, max_edges).collect()}
    want = {x: r for x, r in brute([p for p in pairs if None not in p]).items() if x != r}
    assert got == want
    assert c.connected_components(df.limit(0), max_edges).count() == 0


def test_records_share_values(spark):
    rows = [("component", "b", "1"), ("component", "a", "1"), ("component", "a", "2"), ("component", "c", "2"), ("component", "c", "2"), ("component", "z", "9"), ("story", "a", "1"), ("story", None, "1"), ("story", "q", None)]
    df = spark.createDataFrame(rows, "kind string, record_id string, value string")
    got = {(r.kind, r.record_id): (r.group_id, r.members) for r in c.group_records(df).collect()}
    assert got == {("component", "a"): ("a", 3), ("component", "b"): ("a", 3), ("component", "c"): ("a", 3), ("component", "z"): ("z", 1), ("story", "a"): ("a", 1)}


def test_event_ids_as_whole_numbers(spark):
    rows = [("a", " 007 "), ("b", "7"), ("c", "+7"), ("d", "7.0"), ("e", "n/a"), ("f", None), ("g", "-0"), ("h", "0"), ("i", "-7"), ("j", "9" * 40), ("k", "0" + "9" * 40)]
    df = c.component_links(spark.createDataFrame(rows, "component_id string, event_id string"))
    got = {r.record_id: r.value for r in df.collect()}
    assert got == {"a": "7", "b": "7", "c": "7", "g": "0", "h": "0", "i": "-7", "j": "9" * 40, "k": "9" * 40}


def test_story_values(spark):
    df = spark.createDataFrame([("a", ["U ", None, "  ", "v"]), ("b", ["u"]), ("c", []), ("d", None)], "cluster_id string, mention_identifiers array<string>")
    assert {(r.record_id, r.value) for r in c.story_links(df).collect()} == {("a", "u"), ("a", "v"), ("b", "u")}
