from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from compare import difference
from pyspark.sql import functions as F

import __spark_entry__
from sievework.functions import html, urls
from sievework.plans import catalog, samples

REPO = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, SF), SF, catalog.ORACLES[name]) is None


# Held against plain versions in test_banners.py, or, as a crawl of real links, below.
ELSEWHERE = {"region_candidates", "banner_patterns", "strip_banners", "removed_report", "crawl_pages"}


def test_every_query_is_held_against_something():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == ELSEWHERE


def test_crawl_of_the_pages_table(spark):
    """First in, first out over the links, by hand."""
    read = lambda e: {r["page_id"]: r for r in e.collect()}
    pages = read(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", urls.normalize_page(F.col("url"), F.lit(samples.BASE), samples.DOMAIN).alias("url")))
    links: dict[str, set[str]] = {p["url"]: set() for p in pages.values() if p["url"]}
    raw = catalog._parsed(spark, SF).select(F.explode("page.links").alias("href"), "page_id")
    for r in raw.collect():
        src = pages[r["page_id"]]["url"]
        if src:
            links[src].add(r["href"])
    pairs = spark.createDataFrame([(s, h) for s, hs in links.items() for h in hs], "src string, href string")
    out: dict[str, set[tuple[str, bool]]] = {}
    for r in pairs.select("src", urls.normalize_page(F.col("href"), F.col("src"), samples.DOMAIN).alias("dst")).where("dst IS NOT NULL").withColumn("pdf", urls.is_pdf(F.col("dst"))).collect():
        out.setdefault(r["src"], set()).add((r["dst"], r["pdf"]))
    queue, seen, found, saved, deepest, crawled = [(min(links), 0)], {min(links)}, set(), 0, 0, 0
    while queue and crawled < 200:
        url, depth = queue.pop(0)
        crawled, deepest = crawled + 1, max(deepest, depth)
        if url not in links:
            continue
        saved += 1
        for dst, is_pdf in sorted(out.get(url, ())):
            found.add(dst)
            if not is_pdf and dst not in seen and depth < 5:
                seen.add(dst)
                queue.append((dst, depth + 1))
    assert tuple(catalog.QUERIES["crawl_pages"](spark, SF).select("pages_crawled", "pages_saved", "failed_pages", "max_depth_reached", "links_discovered").first()) == (crawled, saved, crawled - saved, deepest, len(found))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_training_data_operators(tmp_path):
    """With the llm folders and corpus_pipeline.py gone, the entry module still has the other queries."""
    shutil.copytree(REPO / "sievework", tmp_path / "sievework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 30 and e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_references_without_semicolon_stay():
    """A title that is cut inside a reference keeps what is left of it, as in SQL."""
    page = '<h1>a &amp;&amp&amp</h1><article>b &ampc &copy; &#65; &#65 &nosuch; &</article><a href="/x?a=1&copy=2&amp;d=3">l</a>'
    assert html.extract(page)[:3] == ("a &&amp&amp", "b &ampc © A &#65 &nosuch; &", ["/x?a=1&copy=2&d=3"])


def test_few_pages_are_parsed_at_once(spark):
    """Parsed rows come in slices, whatever the size of the batch; the rows are the same."""
    rows = spark.read.parquet(f"{SF}/pages.parquet").coalesce(1)
    out = html.with_extract(rows, rows=7)
    sizes = out.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert "MapInArrow" in out._jdf.queryExecution().toString() and sum(r["n"] for r in sizes.collect()) == rows.count()
    want = {r["page_id"]: html.extract(r["html"]) for r in rows.collect()}
    got = {r["page_id"]: (*r["page"][:3], [tuple(x) for x in r["page"]["pdfs"]], r["page"]["error"]) for r in out.collect()}
    assert got == want
    empty = spark.createDataFrame([(1, None)], "page_id long, html string")
    assert tuple(html.with_extract(empty).first()["page"]) == (None,) * 5
