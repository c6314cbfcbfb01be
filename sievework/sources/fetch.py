"""Fetching of pages and files, and crawling with it; the only part that talks to a network."""

from __future__ import annotations

import logging
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import urls
from sievework.operators import pages as pg
from sievework.operators.crawl import Crawl, advance
from sievework.sources.tables import materialise

log = logging.getLogger("sievework")
Fetch = Callable[[str], bytes]
AGENT = {"User-Agent": "sievework"}


def http_fetch(url: str, timeout: float = 20) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers=AGENT), timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def fetch_pages(found: DataFrame, fetch: Fetch = http_fetch) -> DataFrame:
    """The rows of found(url, ...) with ``html`` and ``fetch_error``; a page that can't be fetched stops no other."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            html, errors = [], []
            for url in b["url"]:
                try:
                    html.append(fetch(url).decode("utf-8", "replace"))
                    errors.append(None)
                except Exception as e:
                    html.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(html=pd.Series(html, dtype="object", index=b.index), fetch_error=pd.Series(errors, dtype="object", index=b.index))

    return found.mapInPandas(run, f"{fields}, html string, fetch_error string")


def scrape(found: DataFrame, fetch: Fetch = http_fetch) -> DataFrame:
    """Page records of found(url), with the time, of the pages that could be fetched and read."""
    got = fetch_pages(found, fetch).where("fetch_error IS NULL").drop("fetch_error")
    return pg.page_records(pg.parsed_pages(got), scraped_at=F.current_timestamp())


def crawl_site(spark: SparkSession, start: str, domain: str, fetch: Fetch = http_fetch, max_pages: int = 200, max_depth: int = 5, on_page: Callable[[DataFrame], None] | None = None) -> tuple[Crawl, DataFrame]:
    """A crawl from ``start``, and the records of its pages.

    Pages of one level are fetched in parallel, in the order of ``crawl``.
    ``on_page`` gets each level's parsed pages, links and PDFs as they were
    before anything was removed from them; what it raises is kept apart from
    the crawl.
    """
    scheme = start.partition("://")[0] if "://" in start else "http"
    first = spark.createDataFrame([(start,)], "u string").select(urls.normalize_page(F.col("u"), F.col("u"), domain, scheme)).first()[0] or start
    records: list[DataFrame] = []

    def expand(level: DataFrame) -> tuple[DataFrame, DataFrame]:
        parsed = materialise(pg.parsed_pages(fetch_pages(level.select("url"), fetch)))
        good = parsed.where("fetch_error IS NULL AND page.error IS NULL AND page.title IS NOT NULL")
        if on_page is not None:
            try:
                on_page(good.drop("fetch_error"))
            except Exception as e:  # the crawl goes on
                log.error("on_page failed: %s: %s", type(e).__name__, e)
        records.append(pg.page_records(good.drop("fetch_error"), scraped_at=F.current_timestamp()))
        links = pg.page_links(good.select("url", "page"), domain, scheme)
        return good.select("url"), links.select(F.col("page_url").alias("src"), F.col("link").alias("dst"), urls.is_pdf(F.col("link")).alias("is_pdf"))

    done = advance(spark, expand, first, max_pages, max_depth)
    saved = records[0]
    for more in records[1:]:
        saved = saved.unionByName(more)
    return done, saved
