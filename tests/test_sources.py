from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.__main__ import main
from sievework.operators import chat
from sievework.operators import pages as pg
from sievework.sources import fetch, sinks
from sievework.streaming import pages as stream

SITE = {
    "http://example.net/": b"<title>Home</title><nav><a href='/a'>a</a><a href='/b'>b</a></nav><p>x <a href='/f.pdf'>Form</a></p>",
    "http://example.net/a": b"<h1>Page A</h1><a href='/b'>b</a><a href='/deep'>d</a><a href='/f.pdf'>again</a><a href='/gone.pdf'>Gone</a>",
    "http://example.net/b": b"<h1>Page B</h1><a href='/missing'>m</a><a href='http://other.org/'>o</a>",
    "http://example.net/deep": b"<h1>Deep one</h1>",
    "http://example.net/f.pdf": b"%PDF bytes",
}
SITE["http://example.net"] = SITE["http://example.net/"]


def _getter():
    """By value, as the executors don't import the tests."""
    site = dict(SITE)
    return lambda url: site[url]


get = _getter()




def test_crawl_of_a_site(spark):
    levels = []

    def on_page(parsed):
        levels.append({r["url"]: len(r["page"]["links"]) for r in parsed.collect()})
        raise RuntimeError("kept apart")

    done, records = fetch.crawl_site(spark, "http://example.net", "example.net", get, on_page=on_page)
    assert [(r["url"][18:], r["depth"], r["ok"]) for r in done.visited.orderBy("place").collect()] == [("/", 0, True), ("/a", 1, True), ("/b", 1, True), ("/deep", 2, True), ("/missing", 2, False)]
    assert levels == [{"http://example.net/": 3}, {"http://example.net/a": 4, "http://example.net/b": 2}, {"http://example.net/deep": 0}]
    rows = {r["source"]: r for r in records.collect()}
    assert len(rows) == 4 and all(r["scraped_at"].endswith("+00:00") and len(r["scraped_at"]) == 25 for r in rows.values())
    assert tuple(done.summary().first()) == (5, 4, 1, 2, 6)


def test_scrape_leaves_out_what_fails(spark):
    rows = spark.createDataFrame([("http://example.net/a",), ("http://example.net/no",)], "url string")
    assert [(r["source"], r["title"]) for r in fetch.scrape(rows, get).collect()] == [("http://example.net/a", "Page A")]


def test_command_lines(spark, tmp_path, capsys):
    out = str(tmp_path / "one")
    assert main(["scrape", "http://example.net/a", "--out", out], get, spark) == 0
    (file,) = (tmp_path / "one").glob("*.json")
    saved = json.loads(file.read_text())
    assert saved["title"] == "Page A" and set(saved) == {"title", "content", "source", "content_length", "page_type", "scraped_at"}
    assert main(["scrape", "http://example.net/none", "--out", out], get, spark) == 1
    assert main(["crawl", "http://example.net", "--out", str(tmp_path / "site"), "--max-depth", "2", "--show-links", "--log", str(tmp_path / "log")], get, spark) == 0
    logged = (tmp_path / "log").read_text()
    assert "crawl http://example.net" in logged and "ERROR failed: http://example.net/missing" in logged and '"pages_crawled":5' in logged
    assert len(list((tmp_path / "site").glob("*.json"))) == 4 and '"pages_crawled":5' in capsys.readouterr().out
    assert main(["pdfs", "http://example.net", "--out", str(tmp_path / "pdfs"), "--download"], get, spark) == 0
    assert [p.read_bytes() for p in (tmp_path / "pdfs" / "files").glob("*.pdf")] == [b"%PDF bytes"]
    assert len(list((tmp_path / "pdfs" / "metadata").glob("*.json"))) == 2
    shown = capsys.readouterr().out
    assert '"pdfs_discovered":2,"pdfs_downloaded":1,"failed_downloads":1,"pdfs_skipped":0' in shown
    assert main(["pdfs", "http://example.net", "--out", str(tmp_path / "pdfs"), "--download"], get, spark) == 0
    assert '"pdfs_downloaded":0,"failed_downloads":1,"pdfs_skipped":1' in capsys.readouterr().out
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.pdf").write_bytes(b"no")
    assert main(["parse", str(tmp_path / "in"), "--out", str(tmp_path / "parsed"), "--cleanup"], get, spark) == 1


def test_downloads_keep_failures_apart(spark):
    found = spark.createDataFrame([("http://example.net/f.pdf", "f.pdf", "new"), ("http://example.net/x.pdf", "x.pdf", "new"), ("u", "here.pdf", "new"), ("v", "f.pdf", "skipped")], "pdf_url string, file_name string, status string")
    got = {r["file_name"]: (r["content"], r["status"]) for r in sinks.download(found, spark.createDataFrame([("here.pdf",)], "file_name string"), get).collect()}
    assert got["f.pdf"] == (bytearray(b"%PDF bytes"), "downloaded") and got["x.pdf"][0] is None and got["x.pdf"][1].startswith("failed") and len(got) == 2


def test_upsert(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "source string, v int")
    a, b, c = (str(tmp_path / x) for x in "abc")
    sinks.upsert(rows(("x", 1), ("y", 1), ("x", 2), (None, 5), (None, 5)), str(tmp_path / "none"), a, order="v")
    assert Counter((r[0], r[1]) for r in spark.read.parquet(a).collect()) == {("x", 2): 1, ("y", 1): 1, (None, 5): 2}
    sinks.upsert(rows(("y", 7), ("z", 9)).withColumn("more", F.lit(True)), a, b)
    got = {r["source"]: (r["v"], r["more"]) for r in spark.read.parquet(b).where("source IS NOT NULL").collect()}
    assert got == {"x": (2, None), "y": (7, True), "z": (9, True)}
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        sinks.upsert(rows(("x", 3)), str(tmp_path / "broken"), c)
    assert not (tmp_path / "c").exists()


def test_json_records(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "ü")], "id int, name string")
    sinks.write_json(df, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":1}', '{"id":2,"name":"ü"}']


def test_refresh_takes_each_page_once(spark, tmp_path):
    folder, done = tmp_path / "pages", []
    page = lambda i, u: spark.createDataFrame([(i, u, f"<h1>Title {i}</h1>")], stream.PAGES)

    def run():
        batch = lambda df, _: done.extend((r["source"], r["title"], r["scraped_at"] is not None) for r in df.collect())
        stream.refresh(stream.page_stream(spark, str(folder)), batch, str(tmp_path / "state")).awaitTermination()

    page(1, "http://example.net/1").write.mode("append").parquet(str(folder))
    run()
    page(2, "http://example.net/2").unionByName(page(3, "http://example.net/1")).write.mode("append").parquet(str(folder))
    run()
    run()
    assert sorted(done) == [("http://example.net/1", "Title 1", True), ("http://example.net/2", "Title 2", True)]


def test_ask(spark):
    replies = {"fine": (200, '{"choices":[{"message":{"content":" yes "}}]}'), "busy": (503, "try later"), "odd": (200, "{}"), "down": (None, "timed out")}
    call = lambda body: replies[json.loads(body)["messages"][1]["content"]]
    rows = spark.createDataFrame([(q,) for q in ["fine", "busy", "odd", "down", "  ", None]], "question string")
    got = [(r["status"], r["answer"], r["detail"]) for r in chat.ask(rows, "m", call).collect()]
    assert got == [
        (200, "yes", None), (502, None, "upstream answered 503: try later"), (502, None, "upstream answered in an unexpected shape"), (502, None, "upstream could not be reached: timed out"), (400, None, "question is empty"), (400, None, "question is empty"),
    ]


def test_collector_counts(spark):
    found = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "pdf_url string, file_name string")
    done = spark.createDataFrame([("a", "downloaded"), ("b", "failed: 404")], "pdf_url string, status string")
    assert pg.collector_summary(found, done).first().asDict() == {"pdfs_discovered": 3, "pdfs_downloaded": 1, "failed_downloads": 1, "pdfs_skipped": 1}
