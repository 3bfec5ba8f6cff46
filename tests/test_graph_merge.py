import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from storyloom.operators import clusters as cl
from storyloom.operators import graph, merge, reconcile, store
from storyloom.plans import pipeline
from storyloom.runtime import durable
from storyloom.settings import DEFAULTS

EVENT = "global_event_id long, sql_date int, date_added long, event_root_code string, quad_class int, goldstein_scale double, avg_tone double, num_mentions int, num_sources int, num_articles int, action_geo_full_name string, action_geo_country_code string, source_url string"
MENTION = "global_event_id long, mention_time_date long, mention_source_name string, mention_identifier string, mention_doc_tone double"
DOCUMENT = "document_identifier string, themes array<string>, persons array<string>, organizations array<string>, locations array<string>, document_tone double"


def event(i, url="https://example.com/story", stamp=None, **k):
    return (i, 20260310, stamp or 20260310010101 + i, "19", 4, -10.0, -5.0, k.get("m", 10), 3, 4, "Tehran, Tehran, Iran", "IR", url)


def mention(i, url, name="s"):
    return (i, 20260310020000, name, url, -1.0)


@pytest.mark.parametrize("parts", [1, 7])
def test_star_components_on_chains_and_hubs(spark, parts):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(2000, 2000), (None, 5), (3000, 3001), (3001, 3000)]
    got = {r.node: r.root for r in graph.star_components(spark.createDataFrame(edges, "a long, b long").repartition(parts), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1200)) and got[3001] == 3000 and got[2000] == 2000


def test_mention_nodes_and_components(spark):
    s, i = "https://site.example/s", "https://site.example/i"
    m = spark.createDataFrame([mention(901, s), mention(902, s), mention(902, i), mention(903, "https://www.yahoo.com/x"), mention(904, "https://a.example/Category/x"), mention(905, None), mention(907, "https://z.example/1")], MENTION)
    ev = spark.createDataFrame([event(k) for k in (901, 902, 903, 904, 905, 907)], EVENT)
    edges = graph.component_edges(ev, m)
    assert {tuple(r) for r in edges.collect()} == {(901, s), (902, s), (902, i), (907, "https://z.example/1")}
    assert {tuple(r) for r in graph.event_components(edges).collect()} == {(901, 901), (901, 902)}


def test_metrics_and_gates(spark):
    ev = spark.createDataFrame([event(1, "https://reuters.com/a", 20260310000000), event(2, "https://reuters.com/b", 20260310030000), event(3, "https://apnews.com/c", 20260310060000)], EVENT)
    edges = spark.createDataFrame([(1, "u"), (2, "u"), (2, "v"), (3, "v")], "event_id long, mention_url string")
    comp = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "component long, event_id long")
    r = graph.component_metrics(comp, edges, ev).first()
    assert (r.events, r.mention_urls, r.source_urls, r.domains, round(r.density, 4), r.span_hours) == (3, 2, 3, 2, 0.6667, 6.0)
    rows = [(0, 2, 2, 2, 24.0, 1.0), (1, 1, 2, 2, 1.0, 1.0), (2, 2, 1, 2, 1.0, 1.0), (3, 2, 2, 1, 1.0, 1.0), (4, 2, 2, 2, 25.0, 1.0), (5, 2, 2, 2, 1.0, 0.1)]
    m = spark.createDataFrame(rows, "component int, events int, source_urls int, domains int, span_hours double, density double")
    got = {r.component: r.failed_gates for r in graph.gates(m, replace(DEFAULTS, min_density=0.5)).collect()}
    assert got == {0: [], 1: ["min_event_ids"], 2: ["min_source_urls"], 3: ["min_domains"], 4: ["max_event_span_hours"], 5: ["min_density"]}


def test_fallback_build(spark):
    ev = spark.createDataFrame([event(101, m=500), event(102, m=500)], EVENT).withColumn("num_articles", F.lit(500)).withColumn("num_sources", F.lit(50))
    me = spark.createDataFrame([mention(101, "https://a/1"), mention(102, "https://b/1")], MENTION)
    docs = spark.createDataFrame([("https://example.com/story", ["ARMEDCONFLICT", "IRAN"], ["P"], [], [], -8.0)], DOCUMENT)
    r = pipeline.component_clusters(ev, me, docs, 20260310000000).collect()
    assert len(r) == 1 and r[0].cluster_id == "6874fb31f521eb11f704a287" and (r[0].num_articles, r[0].num_mentions, r[0].num_sources, r[0].mention_count, r[0].document_tone_avg) == (1000, 1000, 100, 2, -8.0)
    assert r[0].themes == ["ARMEDCONFLICT", "IRAN"] and r[0].event_ids == ["101", "102"]
    assert pipeline.build(ev.limit(0), me, docs).count() == 0


def test_component_build_ends_in_one_cluster(spark):
    ev = spark.createDataFrame([event(1, "https://a.example/1"), event(2, "https://b.example/2"), event(2, "https://b.example/2", 20260311000000)], EVENT)
    me = spark.createDataFrame([mention(1, "https://c/1"), mention(2, "https://c/1"), mention(2, "https://c/1"), mention(2, "https://d/1")], MENTION)
    r = pipeline.build(ev, me, spark.createDataFrame([], DOCUMENT)).collect()
    assert len(r) == 1 and (r[0].event_count, r[0].mention_count, r[0].mention_identifiers, r[0].source_url, r[0].is_root) == (2, 2, ["https://c/1", "https://d/1"], "https://a.example/1", False)


CLUSTER = "cluster_id string, mention_identifiers array<string>, themes array<string>, dominant_event_types array<string>, event_date_ref_start int, event_date_ref_end int"


def clusters(spark, *rows):
    return spark.createDataFrame([(i, m, t, e, a, b) for i, m, t, e, a, b in rows], CLUSTER)


def roots(df, **s):
    r = merge.merge_roots(df, replace(DEFAULTS, **s)).collect()
    return {x.cluster_id: x.root for x in r}, {x.cluster_id: x.evidence for x in r}


D = (20260305, 20260306)


def test_merge_by_mention_and_by_themes(spark):
    two = clusters(spark, ("a", ["u"], [], ["Attacco"], *D), ("b", ["u"], [], ["Attacco", "Z"], *D))
    r, e = roots(two, mention_overlap_min=1)
    assert r == {"a": "a", "b": "a"} and e["a"][0].mention_overlap == 1 and e["a"][0].shared_action_type == "Attacco" and e["a"][0].date_gap_days == 0
    assert roots(two)[0] == {"a": "a", "b": "b"}
    themed = clusters(spark, ("a", [], ["1", "2", "3"], [], *D), ("b", [], ["2", "3", "4", "5"], [], *D))
    assert roots(themed, jaccard_threshold=0.3)[0]["b"] == "a" and roots(themed, jaccard_threshold=0.4)[0]["b"] == "b"


def test_merge_gates(spark):
    far = clusters(spark, ("a", ["u"], [], [], 20260301, 20260301), ("b", ["u"], [], [], 20260304, 20260304))
    assert roots(far, mention_overlap_min=1)[0]["b"] == "b" and roots(far, mention_overlap_min=1, max_day_gap=3)[0]["b"] == "a"
    null = clusters(spark, ("a", ["u"], [], [], None, None), ("b", ["u"], [], [], 20260304, 20260304))
    assert roots(null, mention_overlap_min=1)[0]["b"] == "a"
    other = clusters(spark, ("a", ["u"], [], ["X"], *D), ("b", ["u"], [], ["Y"], *D))
    assert roots(other, mention_overlap_min=1)[0]["b"] == "b"


def test_merge_looks_at_the_union_so_far(spark):
    c = clusters(spark, ("a", ["u"], [], [], 20260301, 20260301), ("b", ["u", "v"], [], [], 20260303, 20260303), ("c", ["v"], [], [], 20260305, 20260305))
    assert set(roots(c, mention_overlap_min=1)[0].values()) == {"a"}


def test_theme_cap_and_stop_themes(spark):
    own = lambda p: [f"{p}{i}" for i in range(50)]
    shared = [f"s{i}" for i in range(50)]
    c = clusters(spark, ("a", [], own("a") + shared, [], *D), ("b", [], own("b") + shared, [], *D))
    assert roots(c, jaccard_threshold=0.3, max_themes=50)[0]["b"] == "b" and roots(c, jaccard_threshold=0.3, max_themes=None)[0]["b"] == "a"
    many = clusters(spark, *[(f"c{i}", [], ["STOP"], [], *D) for i in range(10)])
    assert len(set(roots(many, jaccard_threshold=0.1)[0].values())) == 10


def test_pairs_are_compared_where_they_meet(spark, monkeypatch):
    """Many clusters share a rare theme, few are similar: what is written stays in proportion to the clusters, whatever meets."""
    rows, written = [], []
    for k in range(400):
        rows.append((f"c{k:03}", [], [f"group {k % 6}", f"own {k if k % 40 else k // 80}"], [], *D))
    plain = merge.durable
    monkeypatch.setattr(merge, "durable", lambda df: (written.append(df.count()), plain(df))[1])
    got = {(r.a, r.b): r.jaccard for r in merge.theme_pairs(clusters(spark, *rows)).collect()}
    sets = {r[0]: set(r[2]) for r in rows}
    assert got == {(a, b): 1.0 for a in sets for b in sets if a < b and sets[a] == sets[b]}
    assert max(written) <= 800 < 6 * 66 * 65 // 2


@pytest.mark.parametrize("tile", [8_192, 7])
def test_theme_pairs_in_split_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(merge, "TILE", tile, raising=True)
    rng = random.Random(5)
    rows = [(f"c{k:03}", [], rng.sample([f"t{min(int(rng.expovariate(0.12)), 40)}" for _ in range(12)], rng.randint(0, 9)) or None, [], *D) for k in range(160)]
    got = {(r.a, r.b): r.jaccard for r in merge.theme_pairs(clusters(spark, *rows)).collect()}
    sets = {r[0]: set(r[2] or ()) for r in rows}
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and any(df[t] <= 32 for t in x & y) and len(x & y) / len(x | y) > 0.4}
    assert got == want and len(want) > 50


def test_merge_writes_in_proportion(spark, monkeypatch):
    """Clusters that share one address or theme each, of which few merge: neither the pairs of the addresses nor those of the themes are written."""
    rows = [(f"c{k:03}", [f"common {k % 4}", f"own {k if k >= 8 else k + 200}"], [f"group {k % 6}", f"theme {k}"], [], *D) for k in range(400)]
    written, plain = [], merge.durable
    monkeypatch.setattr(merge, "durable", lambda df: (written.append(df.count()), plain(df))[1])
    got, evidence = roots(clusters(spark, *rows))
    assert {c: r for c, r in got.items() if c != r} == {f"c{k + 200}": f"c{k:03}" for k in range(8)} and evidence["c000"][0].mention_overlap == 2
    assert max(written) <= 800


@pytest.mark.parametrize("tile", [8_192, 7])
def test_merge_evidence_in_split_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(merge, "TILE", tile, raising=True)
    rows = [(f"c{k:02}", ["all", f"pair {k // 2}", None, "all"], None, ["X"], *D) for k in range(40)]
    got, evidence = roots(clusters(spark, *rows))
    assert got == {f"c{k:02}": f"c{k - k % 2:02}" for k in range(40)}
    assert all([e.mention_overlap for e in evidence[f"c{k:02}"]] == [2] for k in range(40))


def test_merge_broadcasts_neither_clusters_nor_groups(spark):
    c = clusters(spark, ("a", ["u"], ["1"], [], *D), ("b", ["u", "v"], ["1"], [], *D), ("c", ["v"], ["2"], [], *D))
    out = merge.merge_roots(c, replace(DEFAULTS, mention_overlap_min=1))
    assert {r.root for r in out.collect()} == {"a"}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_fuse_weighted_tone_and_score(spark):
    kind = "cluster_id string, source_url string, topic_score double, event_count long, num_articles long, num_mentions long, num_sources long, event_ids array<string>, mention_identifiers array<string>, distinct_mention_sources array<string>, component_source_urls array<string>, component_domains array<string>, avg_severity_score double, document_tone_avg double, gkg_doc_count long, event_date_ref_start int, event_date_ref_end int, first_mention_at timestamp, last_mention_at timestamp, themes array<string>, persons array<string>, organizations array<string>, gkg_locations array<string>, dominant_event_types array<string>, dominant_quad_classes array<string>, dominant_countries array<string>, dominant_locations array<string>"
    row = lambda i, n, tone, docs, ids: (i, f"https://{i}.example/1", 1.0, n, 1, 1, 1, ids, [i], [i], [f"https://{i}.example/1"], [f"{i}.example"], 1.0, tone, docs, 20260305, 20260307, None, None, ["T"], [], [], [], [], [], [], [])
    df = spark.createDataFrame([row("a", 10, -2.0, 9, ["10", "20"]), row("b", 8, -10.0, 1, ["30"])], kind)
    r = cl.fuse(df, df.select("cluster_id", F.lit("a").alias("root"))).first()
    assert r.document_tone_avg == -2.8 and r.topic_score == 2.0215 and r.event_count == 18 and r.source_url == "https://a.example/1" and r.mention_count == 2
    none = cl.fuse(df.withColumn("gkg_doc_count", F.lit(0)).withColumn("document_tone_avg", F.col("document_tone_avg") * 1.0), df.select("cluster_id", F.lit("a").alias("root"))).first()
    assert none.document_tone_avg == -6.0


def test_reconcile_growth_merge_split_and_new(spark):
    comps = spark.createDataFrame([("old", "2026-03-20 00:00:00"), ("young", "2026-03-24 00:00:00"), ("torn", "2026-03-01 00:00:00"), ("gone", "2026-03-02 00:00:00")], "component_id string, first_seen_at string").withColumns({"first_seen_at": F.to_timestamp("first_seen_at"), "status": F.lit("active"), "missing_run_count": F.lit(2), "anchor_source_url": F.lit("https://anchor/" ) , "component_source_urls": F.lit(None).cast("array<string>")})
    comps = comps.withColumn("anchor_source_url", F.concat("anchor_source_url", "component_id"))
    past = [("old", "1"), ("old", "2"), ("young", "3"), ("torn", "51"), ("torn", "52"), ("torn", "53"), ("torn", "54"), ("torn", "55"), ("torn", "56"), ("gone", "99")]
    mem = spark.createDataFrame(past, "component_id string, event_id string").withColumn("is_active", F.lit(True))
    now = spark.createDataFrame([("c1", "s", ["1", "2", "3", "4"], "story_clusters"), ("c2", "s2", ["51", "52", "53"], "story_clusters"), ("c3", "s3", ["54", "55", "56"], "story_clusters"), ("c4", "https://anchor/gone", ["7"], "root_clusters")], "cluster_id string, source_url string, event_ids array<string>, table_name string")
    r = {(x.component_id, x.status, x.cluster_id, x.merged_into, x.is_new) for x in reconcile.reconcile(now, comps, mem).collect()}
    assert ("old", "active", "c1", None, False) in r and ("young", "merged", None, "old", False) in r and ("torn", "split", None, None, False) in r and ("gone", "active", "c4", None, False) in r
    assert len([x for x in r if x[4]]) == 2
    aged = {x.component_id: (x.status, x.missing_run_count) for x in reconcile.age(comps, comps.filter("component_id = 'old'")).collect()}
    assert aged["old"] == ("active", 2) and aged["gone"] == ("stale", 3)


def replayed(clusters, comps, member, s):
    """One pass over all clusters that changes what the next one sees, as the operator's docstring states it."""
    live = {c: x for c, x in comps.items() if x["status"] in ("active", "stale")}
    active = {c: {e for k, e, a in member if k == c and a} for c in live}
    out, split = set(), set()
    for c in live:
        over = [len(active[c] & x["events"]) for x in clusters if len(active[c] & x["events"])]
        if sum(n >= s.split_overlap for n in over) >= 2 and max(over) / len(active[c]) < s.split_ratio:
            split.add(c)
            out.add((c, None, None, "split", None, False))
    urls, seen, merged = {c: {x["anchor"], *x["urls"]} for c, x in live.items()}, {c: (x["first"], c) for c, x in live.items()}, set()
    for x in sorted(clusters, key=lambda x: (x["table"] != "story_clusters", x["id"])):
        match = {c for c in active if c not in split | merged and active[c] & x["events"]}
        match = match or {c for c in urls if c not in split | merged and x["url"] in urls[c]}
        if not match:
            keep = "new-" + x["id"]
            seen[keep], urls[keep] = ("9", keep), {x["url"], *x["urls"]}
        else:
            keep = min(match, key=seen.get)
        out.add((keep, x["id"], x["table"], "active", None, not match))
        active[keep] = x["events"]
        for c in match - {keep}:
            merged.add(c)
            active.pop(c, None)
            out.add((c, None, None, "merged", keep, False))
    return out


def test_reconcile_equals_one_pass_over_all_clusters(spark):
    rng = random.Random(3)
    comps = {f"k{i:02d}": {"status": rng.choice(["active", "active", "stale", "merged"]), "first": str(rng.randint(1, 5)), "anchor": f"u{rng.randint(0, 30)}", "urls": [f"u{rng.randint(0, 30)}"]} for i in range(40)}
    member = [(f"k{rng.randint(0, 39):02d}", str(rng.randint(0, 150)), rng.random() < 0.8) for _ in range(260)]
    events = list(range(150))
    rng.shuffle(events)
    clusters = []
    while events:
        n = rng.randint(1, 6)
        clusters.append({"id": f"c{len(clusters):02d}", "table": rng.choice(["story_clusters", "root_clusters"]), "url": f"u{rng.randint(0, 60)}", "urls": [f"u{rng.randint(0, 60)}"], "events": {str(e) for e in events[:n]}})
        events = events[n:]
    comps["torn"] = {"status": "active", "first": "1", "anchor": "u99", "urls": []}
    member += [("torn", f"t{i}", True) for i in range(6)]
    clusters += [{"id": f"t{k}", "table": "story_clusters", "url": f"u{98 - k}", "urls": [], "events": {f"t{i}" for i in range(k, 6, 2)}} for k in (0, 1)]
    c = spark.createDataFrame([(k, x["status"], x["first"], x["anchor"], x["urls"]) for k, x in comps.items()], "component_id string, status string, first_seen_at string, anchor_source_url string, component_source_urls array<string>").withColumn("first_seen_at", F.to_timestamp(F.concat(F.lit("2026-01-0"), "first_seen_at")))
    m = spark.createDataFrame(member, "component_id string, event_id string, is_active boolean")
    now = spark.createDataFrame([(x["id"], x["table"], x["url"], x["urls"], sorted(x["events"])) for x in clusters], "cluster_id string, table_name string, source_url string, urls array<string>, event_ids array<string>")
    got = reconcile.reconcile(now.withColumn("computed_at", F.to_timestamp(F.lit("2026-01-09"))), c, m, new_id=lambda p: "new-" + p)
    rows = [tuple(r) for r in got.collect()]
    want = replayed(clusters, comps, member, DEFAULTS)
    assert len(rows) == len(set(rows))
    assert (set(rows) - want, want - set(rows)) == (set(), set())
    assert {r[3] for r in rows} == {"active", "merged", "split"}


def test_reconcile_broadcasts_no_table(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df)

    for module in (reconcile, graph):
        monkeypatch.setattr(module, "durable", kept)
    current = spark.createDataFrame([("p1", "story_clusters", "https://a/1", ["1", "2"]), ("p2", "story_clusters", "https://b/1", ["9"])], "cluster_id string, table_name string, source_url string, event_ids array<string>")
    components = spark.createDataFrame([("c1", "active", "https://a/0", ["https://b/1"]), ("c2", "active", "https://c/1", None)], "component_id string, status string, anchor_source_url string, component_source_urls array<string>").withColumn("first_seen_at", F.lit("2026-02-01").cast("timestamp"))
    memberships = spark.createDataFrame([("c1", "1", True), ("c2", "2", True)], "component_id string, event_id string, is_active boolean")
    out = reconcile.reconcile(current, components, memberships)
    assert {(r.component_id, r.status) for r in out.collect()} >= {("c1", "active"), ("c2", "merged")}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]


def test_components_after_a_run(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    c = spark.createDataFrame([("a", "active", "c0", "story_clusters", 1), ("b", "active", "c1", "story_clusters", 0), ("m", "active", "c9", "root_clusters", 0), ("x", "active", None, None, 2)], "component_id string, status string, current_cluster_id string, current_table string, missing_run_count int")
    c = c.withColumns({"anchor_source_url": F.lit("u"), "component_source_urls": F.array(F.lit("u")), "first_seen_at": t("2026-01-01"), "last_seen_at": t("2026-01-01"), "merged_into": F.lit(None).cast("string"), "has_gkg": F.lit(False)})
    touched = spark.createDataFrame([("a", "c1", "story_clusters", "active", None, False), ("b", "c1", "story_clusters", "active", None, False), ("m", None, None, "merged", "a", False), ("n", "c2", "root_clusters", "active", None, True)], "component_id string, cluster_id string, table_name string, status string, merged_into string, is_new boolean")
    now = spark.createDataFrame([("c1", "v", ["v"], True), ("c2", "w", ["w"], False)], "cluster_id string, source_url string, urls array<string>, has_gkg boolean").withColumn("computed_at", t("2026-02-01"))
    assert {tuple(r) for r in reconcile.outdated(touched, c).collect()} == {("story_clusters", "c0"), ("root_clusters", "c9")}
    got = {r.component_id: r for r in reconcile.next_components(c, touched, now).collect()}
    assert (got["a"].current_cluster_id, got["a"].missing_run_count, got["a"].has_gkg, got["a"].component_source_urls, str(got["a"].last_seen_at)[:10]) == ("c1", 0, True, ["v"], "2026-02-01")
    assert (got["m"].status, got["m"].merged_into, got["m"].current_cluster_id) == ("merged", "a", None) and (got["x"].status, got["x"].missing_run_count) == ("stale", 3)
    assert (got["n"].status, got["n"].anchor_source_url, str(got["n"].first_seen_at)[:10]) == ("active", "w", "2026-02-01")
    broken = reconcile.dangling(reconcile.next_components(c, touched, now), now.select("cluster_id").filter("cluster_id = 'c1'"), now.select("cluster_id").limit(0))
    healed = {r.component_id: (r.status, r.current_cluster_id) for r in reconcile.heal(reconcile.next_components(c, touched, now), broken).collect()}
    assert healed["n"] == ("stale", None) and healed["a"] == ("active", "c1")


def test_membership_history(spark):
    h = spark.createDataFrame([("c", "1", True), ("c", "2", True), ("d", "9", True)], "component_id string, event_id string, is_active boolean").withColumns({"first_seen_at": F.to_timestamp(F.lit("2026-01-01")), "last_seen_at": F.to_timestamp(F.lit("2026-01-01"))})
    now = spark.createDataFrame([("c", "2"), ("c", "3"), ("c", "3")], "component_id string, event_id string")
    got = {(r.component_id, r.event_id): (str(r.first_seen_at)[:10], str(r.last_seen_at)[:10], r.is_active) for r in reconcile.replace_membership(h, now, "2026-02-01").collect()}
    assert got == {("c", "1"): ("2026-01-01", "2026-02-01", False), ("c", "2"): ("2026-01-01", "2026-02-01", True), ("c", "3"): ("2026-02-01", "2026-02-01", True), ("d", "9"): ("2026-01-01", "2026-01-01", True)}


def test_store_operators(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", "kept"), (2, "b", None)], "k long, v string, status string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D"), (None, "E")], "k long, v string")
    got = {r.k: r.v for r in store.insert_ignore(t.select("k", "v"), new, "k", ["v"]).collect()}
    assert got == {1: "a", 2: "b", 3: "C"}
    up = spark.createDataFrame([(1, "A", "pending"), (4, "N", "pending")], "k long, v string, status string")
    assert {(r.k, r.v, r.status) for r in store.upsert(t, up, "k", ["status"]).collect()} == {(1, "A", "kept"), (2, "b", None), (4, "N", "pending")}
    snap = store.Snapshots(spark, str(tmp_path / "t"))
    assert not snap.exists()
    snap.write(t)
    snap.write(snap.read().filter("k = 1"))
    assert snap.read().count() == 1
    assert store.retain(spark.createDataFrame([(1,), (None,), (9,)], "d int"), "d", 5).count() == 2


@pytest.mark.parametrize("empty", [True, False])
def test_latest_row(spark, empty):
    log = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "at int, what string")
    got = store.latest(log.limit(0) if empty else log, "at").collect()
    assert [tuple(r) for r in got] == ([] if empty else [(3, "y")])


def test_only_hubs_are_salted(spark, monkeypatch):
    from storyloom import runtime

    many = spark.createDataFrame([(1, k) for k in range(300)] + [(k, k) for k in range(2, 40)], "u long, x long")
    few = spark.createDataFrame([(k, 10 * k) for k in range(30)], "u long, m long")
    want = sorted((u, x, 10 * u) for u, x in [(1, k) for k in range(300)] + [(k, k) for k in range(2, 30)])
    hot = many.groupBy("u").count().filter("count > 100").select("u")
    for keys in (hot, hot.limit(0)):
        assert sorted(map(tuple, runtime.spread_join(many, few, "u", keys).collect())) == want
    plan = lambda keys: runtime.spread_join(many, few, "u", keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan(hot) and "Generate" not in plan(hot.limit(0))
    links = [(1, k) for k in range(2, 60)] + [(k, k + 1) for k in range(100, 140)] + [(59, 500), (500, 501)]
    edges = spark.createDataFrame(links, "u long, v long").repartition(7)
    found = []
    for most in (graph.HOT, 3):
        monkeypatch.setattr(graph, "HOT", most)
        found.append(sorted(map(tuple, graph.star_components(edges, "u", "v").collect())))
    assert found[0] == found[1] == sorted([(k, 1) for k in [*range(1, 60), 500, 501]] + [(k, 100) for k in range(100, 141)])
