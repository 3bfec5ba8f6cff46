import zipfile

import pytest
from pyspark.errors import PythonException

from storyloom.operators import store
from storyloom.sources import articles, feeds
from storyloom.streaming import ingest


def event_line(i, **over):
    cells = [""] * 61
    for at, v in {0: i, 1: 20260308, 7: "us", 17: "TOOLONG", 26: "0411", 28: "04", 29: 2, 30: -2.5, 31: 3, 34: 1.75, 53: "US", 59: 20260308120000, 60: "https://example.com/a"}.items():
        cells[at] = str(v)
    for at, v in over.items():
        cells[int(at[1:])] = v
    return "\t".join(cells)


def archive(path, lines):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.csv", b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines))


def test_event_rows(spark, tmp_path):
    archive(tmp_path / "20260308120000.export.CSV.zip", [event_line(1), "", "short\trow", event_line(2, c31="many"), event_line(3, c31=" "), event_line(4).encode() + b"\xff", event_line("x")])
    rows = feeds.parse_rows(feeds.columns_of(feeds.read_zipped(spark, str(tmp_path))), "events").orderBy("global_event_id").collect()
    assert [r.global_event_id for r in rows] == [1, 3, 4]
    assert (rows[0].actor1_country_code, rows[0].actor2_country_code, rows[0].goldstein_scale, rows[1].num_mentions) == ("US", None, -2.5, None)
    assert rows[2].source_url.endswith("�")


def test_broken_archive_is_an_error(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"no zip")
    with pytest.raises((PythonException, Exception)):
        feeds.read_zipped(spark, str(tmp_path)).count()


def test_document_rows_and_manifest(spark):
    cells = [""] * 27
    for at, v in {0: "r-1", 1: "20260310120000", 3: "fn.example", 4: "https://fn.example/a", 7: "A;;B ; ", 11: "M K", 15: "-8.7,1,2"}.items():
        cells[at] = v
    df = spark.createDataFrame([("\t".join(cells),), ("\t".join(cells[:15]),), ("\t".join(cells[:15] + ["x,1"] + cells[16:]),)], "line string")
    a, b = feeds.parse_documents(feeds.columns_of(df)).collect()
    assert (a.themes, a.persons, a.organizations, a.document_tone, b.document_tone) == (["A", "B"], ["M K"], [], -8.7, None)
    lines = [f"1 m http://f/{t}.{k}" for t in (20260305000000, 20260301000000) for k in ("export.CSV.zip", "gkg.csv.zip")] + ["bad", "1 2 http://f/nostamp.export.CSV.zip"]
    m = feeds.manifest(spark.createDataFrame([(x,) for x in lines], "value string"), "events")
    assert [r.ts for r in feeds.manifest_range(m, 20260301000000, 20260309000000).collect()] == [20260301000000, 20260305000000]
    assert feeds.latest_file(m).first().ts == 20260305000000 and feeds.latest_file(m.limit(0)).count() == 0


def test_streaming_takes_each_file_once(spark, tmp_path):
    src, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"
    src.mkdir()
    archive(src / "20260308120000.export.CSV.zip", [event_line(1), event_line(2)])
    ingest.start_ingest(spark, str(src), "events", str(out), str(chk)).awaitTermination(60)
    archive(src / "20260308121500.export.CSV.zip", [event_line(2, c31="99"), event_line(3)])
    for _ in range(2):
        ingest.start_ingest(spark, str(src), "events", str(out), str(chk)).awaitTermination(60)
    rows = {r.global_event_id: r.num_mentions for r in store.Snapshots(spark, str(out)).read().collect()}
    assert rows == {1: 3, 2: 3, 3: 3}


def test_watermark_rules(spark):
    runs = spark.createDataFrame([("bootstrap", "completed", 5), ("incremental", "failed", 9)], "type string, status string, watermark long")
    assert ingest.next_since(runs, 1) == 6 and ingest.next_since(runs.limit(0), 1) == 1
    events = spark.createDataFrame([(1,)], "global_event_id long")
    assert not ingest.should_bootstrap(events, runs) and ingest.should_bootstrap(events.limit(0), runs.limit(0))


def test_extraction(spark):
    page = '<html><head><title>T</title><meta property="og:title" content="O &amp; P"></head><body><p>a\n b</p><p>  </p><P>open<p>c</p></body>'
    assert articles.extract(page) == ("O & P", "a b\n\nc")
    assert articles.extract(page, lose_open=False) == ("O & P", "a b\n\nopen\n\nc")
    assert articles.extract("<title> only </title>") == ("only", None) and articles.extract(None) == (None, None)
    df = spark.createDataFrame([(1, page), (1, page), (2, None)], "page_id long, html string")
    assert articles.extract_articles(df).count() == 3


def test_fetch_and_combine(spark):
    def fetch(url):
        if "big" in url:
            return "text/html", b"x" * 1_000_001
        if "pdf" in url:
            return "application/pdf", b""
        if "down" in url:
            raise OSError("down")
        return "text/html; charset=utf-8", f"<p>{url}</p>".encode()

    urls = [(u,) for u in ("https://a/1", "https://a/1", "https://big/1", "https://pdf/1", "https://down/1", None)]
    got = {r.url: (r.html, r.error) for r in articles.fetch_pages(spark.createDataFrame(urls, "url string"), fetch).collect()}
    assert got["https://a/1"] == ("<p>https://a/1</p>", None) and got["https://big/1"][1] == "too large" and got["https://pdf/1"][1].startswith("not html") and "OSError" in got["https://down/1"][1]
    c = spark.createDataFrame([("c", ["https://a/1", "https://a/2", "https://b/1"], "https://d/1")], "cluster_id string, mention_identifiers array<string>, source_url string")
    ranked = articles.ranked_urls(c, 2)
    assert [(r.url, r["rank"]) for r in ranked.orderBy("rank").collect()] == [("https://a/1", 1), ("https://b/1", 2)]
    texts = spark.createDataFrame([("https://b/1", "B", "bb"), ("https://a/1", "A", "aa")], "url string, title string, content string")
    assert tuple(articles.combine_articles(ranked, texts).first())[1:3] == ("A", "aa\n\n---\n\nbb")
