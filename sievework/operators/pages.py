"""Pages: records, links, PDF candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import rules, urls
from sievework.functions.html import with_extract
from sievework.functions.text import UI_PHRASES
from sievework.operators.documents import iso_time


def parsed_pages(pages: DataFrame, phrases: tuple[str, ...] = UI_PHRASES) -> DataFrame:
    """pages(url, html, ...) with the struct ``page``; the HTML itself goes."""
    return with_extract(pages, phrases)


def page_records(parsed: DataFrame, page_rules=rules.PAGE_RULES, scraped_at: Column | None = None) -> DataFrame:
    """title, content, source, content_length and page_type of each page that could be parsed, and ``scraped_at`` where that time is given."""
    rows = parsed.where("page.error IS NULL AND page.title IS NOT NULL")
    kind = rules.page_type(urls.path(F.col("url")), F.col("url"), F.col("page.title"), F.col("page.content"), page_rules)
    extra = [c for c in parsed.columns if c not in ("url", "page")]
    return rows.select(*extra, F.col("page.title").alias("title"), F.col("page.content").alias("content"), F.col("url").alias("source"), F.length("page.content").alias("content_length"), kind.alias("page_type"), *([] if scraped_at is None else [iso_time(scraped_at).alias("scraped_at")]))


def page_links(parsed: DataFrame, domain: str, preferred_scheme: str = "http") -> DataFrame:
    """Distinct (page_url, link): normalised links of each page to the domain's pages."""
    hrefs = parsed.select(F.col("url").alias("page_url"), F.explode("page.links").alias("href"))
    return hrefs.select("page_url", urls.normalize_page(F.col("href"), F.col("page_url"), domain, preferred_scheme).alias("link")).where("link IS NOT NULL").distinct()


def links_by_page(links: DataFrame) -> DataFrame:
    """Each page's links, sorted, as the show-links report prints them."""
    return links.groupBy("page_url").agg(F.sort_array(F.collect_set("link")).alias("links"))


def pdf_candidates(parsed: DataFrame, domain: str, preferred_scheme: str = "http") -> DataFrame:
    """(page_url, pos, title, pdf_url) in the order of the page's parts."""
    rows = parsed.select(F.col("url").alias("page_url"), F.explode("page.pdfs").alias("c"))
    return rows.select("page_url", F.col("c.pos").alias("pos"), F.col("c.title").alias("title"), urls.normalize_pdf(F.col("c.url"), F.col("page_url"), domain, preferred_scheme).alias("pdf_url")).where("pdf_url IS NOT NULL")


def first_seen_pdfs(candidates: DataFrame, order: tuple[str, ...] = ("page_url", "pos")) -> DataFrame:
    """Metadata of each PDF as first seen: (pdf_url, title, discovered_from, metadata_file, file_name, status).

    Of PDFs with one file name the first seen is ``new``, the others are
    ``skipped``: their file is taken to be there already.
    """
    seen = F.struct(*order)
    first = candidates.groupBy("pdf_url").agg(F.min_by(F.struct("title", "page_url"), seen).alias("m"), F.min(seen).alias("seen"))
    named = first.select("pdf_url", F.col("m.title").alias("title"), F.col("m.page_url").alias("discovered_from"), "seen", urls.pdf_file_name(F.col("pdf_url")).alias("file_name"))
    place = F.row_number().over(Window.partitionBy("file_name").orderBy("seen", "pdf_url"))
    return named.select("pdf_url", "title", "discovered_from", urls.pdf_metadata_file_name(F.col("pdf_url"), F.col("title")).alias("metadata_file"), "file_name", F.when(place == 1, "new").otherwise("skipped").alias("status"))


def pdf_metadata(found: DataFrame, discovered_at: Column | None = None) -> DataFrame:
    """The metadata rows of ``first_seen_pdfs``, one file each: title, pdf_url, discovered_from, the time and the file's name."""
    when = F.current_timestamp() if discovered_at is None else discovered_at
    return found.select("metadata_file", "title", "pdf_url", "discovered_from", iso_time(when).alias("discovered_at"))


def collector_summary(found: DataFrame, downloads: DataFrame) -> DataFrame:
    """One row: PDFs discovered, downloaded, skipped as known or present, and failed."""
    seen = found.agg(F.count("*").alias("pdfs_discovered"))
    done = downloads.agg(F.count_if(F.col("status") == "downloaded").alias("pdfs_downloaded"), F.count_if(F.col("status").startswith("failed")).alias("failed_downloads"))
    return seen.crossJoin(done).withColumn("pdfs_skipped", F.col("pdfs_discovered") - F.col("pdfs_downloaded") - F.col("failed_downloads"))
