import random

import pytest
from tokenizers import Tokenizer

from storyloom.llm import bpe, mixing


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(bpe.default_path())


def test_ids_equal_the_public_library(encoder):
    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["", "Hello  world\n\n", "<|endoftext|> it's", "a" * 3000, "naïve Привет 日本 👩‍👩‍👧", "\x00\xad ", " \t "]
    texts += ["".join(rng.choice("abe rtn'-=aéж1\n") for _ in range(200)) for _ in range(300)] + ["".join(rng.choice("aeiouhtn") for _ in range(50)) for _ in range(300)]
    for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(s) == e.ids
        assert encoder.decode(e.ids) == s
    assert encoder.encode(None) == [] and encoder.decode([]) == ""


def test_corpus_keeps_every_row(spark, encoder):
    df = spark.createDataFrame([(1, "one two", 5), (2, "", 5), (3, None, 5), (1, "one two", 6), (None, "x", 7)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, encoder.encode("one two")), (1, encoder.encode("one two")), (2, []), (3, []), (0, encoder.encode("x"))], key=str)
    counts = {r.doc_id: r.n_tokens for r in bpe.encode_corpus(df, counts_only=True).collect()}
    assert counts[2] == 0 and counts[1] == len(encoder.encode("one two"))
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_schedule_deviates_by_less_than_a_block():
    rng = random.Random(5)
    for _ in range(30):
        blocks = {f"s{i}": rng.randint(0, 40) for i in range(rng.randint(1, 9))}
        total = sum(blocks.values())
        order = list(mixing.pfair(blocks))
        assert [s for s, _, _ in order] == list(range(total))
        done = dict.fromkeys(blocks, 0)
        for slot, s, j in order:
            assert j == done[s]
            done[s] += 1
            for x, n in blocks.items():
                assert abs(done[x] - (slot + 1) * n / total) < 1
    assert list(mixing.pfair({})) == []


def test_quotas_hit_the_caps_exactly():
    q = {x["source"]: x for x in mixing.plan_quotas({"a": 100, "b": 1000, "free": 9}, [("a", 0.5, 2), ("b", 0.4, 1), ("gone", 0.1, 3)])}
    assert q["a"]["quota"] == 200 and abs(q["b"]["quota"] - 160) <= 1 and q["gone"]["quota"] == 0 and q["gone"]["reachable_share"] == 0
    assert mixing.plan_quotas({}, [("a", 1.0, 1)])[0]["quota"] == 0


def test_mixture_shares_repeats_and_order(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["wire"] * 6 + [" Wire", "tiny", None, "other"]), rng.randint(0, 60)) for i in range(800)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("wire", 0.7, 1), ("Tiny ", 0.3, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(d, t)
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["wire"].actual_share - 0.7) < 0.02 and abs(shares["tiny"].actual_share - 0.3) < 0.02 and shares["none"].tokens_used == 0
    assert shares["tiny"].most_uses <= 3 and shares["wire"].most_uses == 1
    rows = m.sequence().collect()
    size = {i: n for i, _, n in docs}
    assert len({(r.doc_id, r.use_no) for r in rows}) == len(rows) and all(r.n_tokens == size[r.doc_id] for r in rows)
    for s in ("wire", "tiny"):
        own = sorted((r.start, r.n_tokens) for r in rows if r.source == s)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    empty = mixing.Mixture(d.limit(0), t)
    assert empty.sequence().count() == 0 and all(r.actual_share == 0 for r in empty.shares().collect())
