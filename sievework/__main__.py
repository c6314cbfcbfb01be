"""Command lines: scrape, crawl, pdfs and parse."""

from __future__ import annotations

import argparse
import logging
import sys
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import urls
from sievework.operators import pages as pg
from sievework.sources import fetch, pdfs, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sievework", description=__doc__)
    parser.add_argument("--master", help="Spark master; by default what the environment says, else local[*]")
    todo = parser.add_subparsers(dest="command", required=True)
    one = todo.add_parser("scrape", help="one page into a JSON file")
    one.add_argument("url")
    site = todo.add_parser("crawl", help="a site's pages into JSON files")
    docs = todo.add_parser("pdfs", help="the PDFs of a site: metadata, and on demand the files")
    for p, most in ((site, 200), (docs, 50)):
        p.add_argument("url")
        p.add_argument("--domain", help="hosts of this domain belong to the site; the start's own by default")
        p.add_argument("--max-pages", type=int, default=most)
        p.add_argument("--max-depth", type=int, default=5)
        p.add_argument("--show-links", action="store_true", help="print each page's links")
    docs.add_argument("--download", action="store_true")
    parse = todo.add_parser("parse", help="PDF files of a folder into JSON files")
    parse.add_argument("folder")
    parse.add_argument("--cleanup", action="store_true", help="remove headers and footers that repeat")
    parse.add_argument("--threshold", type=float, default=0.5, help="share of the pages, or a percentage")
    for p in (one, site, docs, parse):
        p.add_argument("--out", default="out")
        p.add_argument("--log", help="a file for what was done and what failed; by default standard error")
        p.add_argument("--timeout", type=float, default=30 if p is docs else 20)
    return parser


log = logging.getLogger("sievework")


def _print(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        log.info(row)
        print(row)


def _save(records: DataFrame, folder: str) -> None:
    sinks.write_json_files(records.withColumn("file", urls.page_file_name(F.col("source"))), folder, "file")


def main(argv: list[str] | None = None, get: fetch.Fetch | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 where nothing could be read. ``get`` fetches a URL's bytes."""
    args = _parser().parse_args(argv)
    handler = logging.FileHandler(args.log, encoding="utf-8") if args.log else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.setLevel(logging.INFO if args.log else logging.WARNING)
    log.addHandler(handler)
    try:
        return _run(args, get, spark)
    finally:
        log.removeHandler(handler)
        handler.close()


def _run(args: argparse.Namespace, get: fetch.Fetch | None, spark: SparkSession | None) -> int:
    log.info("%s %s", args.command, getattr(args, "url", None) or args.folder)
    if spark is None:
        builder = SparkSession.builder.appName("sievework")
        spark = builder.master(args.master).getOrCreate() if args.master else builder.getOrCreate()
    timeout = args.timeout
    get = get or (lambda url: fetch.http_fetch(url, timeout))
    if args.command == "scrape":
        records = fetch.scrape(spark.createDataFrame([(args.url,)], "url string"), get).persist()
        _save(records, args.out)
        _print(records.select("source", "title", "page_type", "content_length"))
        if records.isEmpty():
            log.error("could not be read: %s", args.url)
        return int(records.isEmpty())
    if args.command == "parse":
        pages = pdfs.pdf_pages(pdfs.pdf_files(spark, args.folder)).persist()
        records = pdfs.pdf_records(pages, args.cleanup, args.threshold)
        sinks.write_json_files(records.drop("doc_id").withColumn("file", F.regexp_replace("source_pdf", r"\.pdf$", ".json")), args.out, "file")
        _print(pages.where("error IS NOT NULL").select("path", "error"))
        summary = pdfs.pdf_summary(pages)
        _print(summary)
        return int(summary.first()["pdfs_successful"] == 0)
    domain = args.domain or (urlsplit(args.url).hostname or "").removeprefix("www.")
    seen: list[DataFrame] = []

    def on_page(parsed: DataFrame) -> None:
        if args.show_links:
            _print(pg.links_by_page(pg.page_links(parsed.select("url", "page"), domain)))
        if args.command == "pdfs":
            level = F.lit(len(seen))
            seen.append(pg.pdf_candidates(parsed.select("url", "page"), domain).withColumn("level", level))

    done, records = fetch.crawl_site(spark, args.url, domain, get, args.max_pages, args.max_depth, on_page)
    if args.command == "crawl":
        _save(records, args.out)
        for row in done.visited.where("NOT ok").select("url").toLocalIterator():
            log.error("failed: %s", row["url"])
        _print(done.summary())
        return int(records.isEmpty())
    found = pg.first_seen_pdfs(_union(seen), ("level", "page_url", "pos")).persist() if seen else None
    if found is None:
        return 1
    sinks.write_json_files(pg.pdf_metadata(found), f"{args.out}/metadata", "metadata_file")
    if args.download:
        got = sinks.download(found, sinks.present_files(spark, f"{args.out}/files"), get).persist()
        sinks.write_files(got.where("content IS NOT NULL"), f"{args.out}/files")
        _print(pg.collector_summary(found, got))
    else:
        _print(found.select("pdf_url", "title", "discovered_from", "status"))
    return 0


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


if __name__ == "__main__":
    sys.exit(main())
