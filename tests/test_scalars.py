from pyspark.sql import functions as F

from storyloom.functions import lookups, scalars
from storyloom.operators import search


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_scores_and_labels(spark):
    lit = F.lit
    r = one(
        spark, a=scalars.severity(lit(4), lit(-20.0), lit(-20.0)), b=scalars.severity(lit(1), lit(10.0), lit(0.0)), c=scalars.severity(lit(1), lit(-10.0), lit(0.0)), d=scalars.severity(lit(None), lit(None), lit(None)),
        t=scalars.topic_score(lit(3), lit(10), lit(20), lit(5)), id=scalars.cluster_id(F.array(lit(102), lit(101))), gap=scalars.day_gap(lit(20260301), lit(20260303), lit(20260306), lit(20260307)), none=scalars.day_gap(lit(20260301), lit(None), lit(1), lit(2)),
    )
    assert (r.a, r.b, r.c, r.d) == (20.0, 0.0, 5.0, 0.0) and r.t == 2.062
    assert r.id == "6874fb31f521eb11f704a287" and r.gap == 3 and r.none is None
    df = spark.createDataFrame([(4, "19"), (9, "99"), (None, None)], "q int, r string").select(lookups.quad_label("q"), lookups.root_label("r"), lookups.root_label_en("r"))
    assert [tuple(x) for x in df.collect()] == [("Conflitto materiale", "Combattimento", "FIGHT"), ("Sconosciuto", "Sconosciuto", "99"), ("Sconosciuto", "Sconosciuto", None)]


def test_parsing_scalars(spark):
    df = spark.createDataFrame([(" 7 ",), ("",), ("x",), (None,), ("usa1",)], "s string")
    got = [tuple(r) for r in df.select(scalars.number("s", "int"), scalars.malformed("s", "int"), scalars.code("s", 3), scalars.semicolon_list("s")).collect()]
    assert got == [(7, False, "7", ["7"]), (None, False, None, []), (None, True, "X", ["x"]), (None, False, None, []), (None, True, None, ["usa1"])]
    r = one(spark, d=scalars.domain(F.lit("HTTPS://u@Www.A.example:80/x?y")), p=scalars.domain_plain(F.lit("no slash")), s=scalars.source_name(F.lit("https://www.b.example/c")), sec=scalars.is_section(F.lit("https://a/TAG/x")), n=scalars.normal_stamp(F.lit("20260301")), bad=scalars.stamp(F.lit(20269999000000)), iso=scalars.iso_day(F.lit(20260301)))
    assert tuple(r) == ("u@www.a.example:80", "", "b.example", True, 20260301000000, None, "2026-03-01")


def test_requests_are_normalised():
    f = search.request_to_filters({"countries": ["Italy", "France", "Atlantis"], "actors": {"actor1_country": "USA", "actor2_country": "Italy"}, "source": {"domains": ["https://www.ansa.it", "reuters.com"]}, "date_range": {"from": 2023, "to": 2024}})
    assert f.geo_countries == ["FR", "IT"] and (f.actor1, f.actor2) == ("USA", "ITA") and f.source_domains == ["ansa.it", "reuters.com"] and (f.date_from, f.date_to) == (20230101, 20241231)
    for bad in ({}, {"date_range": {"from": 2025, "to": 2024}}, {"sentiment": {"tone_min": 5, "tone_max": 1}}, {"impact": {"min_mentions": -1}}):
        try:
            search.request_to_filters(bad)
        except search.FilterError:
            continue
        raise AssertionError(bad)
    assert search.cache_key({"a": "X ", "b": [1]}) == search.cache_key({"b": [1], "a": "x"})
