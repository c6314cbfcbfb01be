"""Breadth-first crawl over a link table, level by level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.sources.tables import materialise


Expand = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Crawl:
    """visited(url, depth, place, ok) in crawling order, and links(src, dst) of the pages crawled."""

    visited: DataFrame
    links: DataFrame

    def summary(self) -> DataFrame:
        """One row: pages_crawled counts attempts, links_discovered every distinct link, PDFs and known ones too."""
        pages = self.visited.agg(
            F.count("*").alias("pages_crawled"), F.count_if("ok").alias("pages_saved"), F.count_if(~F.col("ok")).alias("failed_pages"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth_reached")
        )
        return pages.crossJoin(self.links.agg(F.count_distinct("dst").alias("links_discovered")))


def crawl(edges: DataFrame, nodes: DataFrame, seed: str, max_pages: int = 200, max_depth: int = 5) -> Crawl:
    """``advance`` over edges(src, dst, is_pdf); nodes(url, ok) says what can be fetched. Both are read once a level."""

    def expand(level: DataFrame) -> tuple[DataFrame, DataFrame]:
        good = materialise(level.join(nodes, "url").where("ok").select("url"))
        return good, edges.join(F.broadcast(good.withColumnRenamed("url", "src")), "src").select("src", "dst", "is_pdf")

    return advance(edges.sparkSession, expand, seed, max_pages, max_depth)


def advance(spark: SparkSession, expand: Expand, seed: str, max_pages: int = 200, max_depth: int = 5) -> Crawl:
    """First in, first out from ``seed``.

    ``expand`` gets a level's pages (url, depth, place) and returns those that
    could be fetched (url), and their links (src, dst, is_pdf). A page is
    visited when it is queued, and one that fails has no links. PDFs and links
    found at the last depth are discovered, not queued. The links of a page
    are queued in sorted order. Each level is cut to what is left of the page
    budget before it is expanded, so no ordering, and no broadcast, ever spans
    more than ``max_pages`` rows.
    """
    level = spark.createDataFrame([(seed, 0)], "url string, place long")
    queued, done, links = level.select("url"), [], []
    crawled = 0
    for depth in range(max_depth + 1):
        level = level.orderBy("place", "url").limit(max_pages - crawled)
        place = F.row_number().over(Window.orderBy("place", "url")) + crawled - 1
        level = materialise(level.select("url", F.lit(depth).alias("depth"), place.cast("long").alias("place")))
        n = level.count()
        if n == 0:
            break
        crawled += n
        good, found = expand(level)
        done.append(level.join(F.broadcast(good.select("url", F.lit(True).alias("fetched"))), "url", "left").select("url", "depth", "place", F.coalesce("fetched", F.lit(False)).alias("ok")))
        out = materialise(found.join(F.broadcast(level.select(F.col("url").alias("src"), "place")), "src").select("src", "dst", "is_pdf", "place"))
        links.append(out.select("src", "dst"))
        if depth == max_depth or crawled >= max_pages:
            break
        fresh = out.where("NOT is_pdf").join(queued, out["dst"] == queued["url"], "left_anti")
        ranked = fresh.groupBy("dst").agg(F.min("place").alias("parent"))
        # Only the budget's worth can ever be crawled, but all of it counts as queued.
        ordered = ranked.orderBy("parent", "dst").limit(max_pages - crawled)
        level = ordered.select(F.col("dst").alias("url"), F.row_number().over(Window.orderBy("parent", "dst")).cast("long").alias("place"))
        queued = materialise(queued.unionByName(ranked.select(F.col("dst").alias("url"))))
    visited, found = done[0], links[0]
    for a, b in zip(done[1:], links[1:]):
        visited, found = visited.unionByName(a), found.unionByName(b)
    return Crawl(visited, found)
