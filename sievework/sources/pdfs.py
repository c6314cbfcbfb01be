"""PDF files as a source: pages with their text and placed words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import pdf
from sievework.operators import documents

WORDS = "array<struct<text: string, x0: double, top: double, bottom: double>>"
PAGES = f"path string, stem string, meta_title string, page_number int, page_height double, text string, words {WORDS}, error string"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, content) of the *.pdf files right in a folder, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]*)\.pdf$", 1).alias("stem"), "content").orderBy("path")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "stem", "meta_title", "page_number", "page_height", "text", "words", "error"]
    for batch in batches:
        for path, stem, content in zip(batch["path"], batch["stem"], batch["content"]):
            try:
                doc = pdf.Document(content)
                title = doc.title
                rows = [(path, stem, title, p.number, p.height, p.text, [{"text": w.text, "x0": w.x0, "top": w.top, "bottom": w.bottom} for w in p.words], None) for p in doc.pages()]
            except Exception as e:  # one file never stops the others
                rows = [(path, stem, None, None, None, None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=names).astype({"page_number": "Int32"})


def pdf_pages(files: DataFrame) -> DataFrame:
    """PAGES of files(path, stem, content): a row a page, or one with ``error`` for a file that can't be read.

    A file without pages has no row. Files go through one at a time, so a
    task holds a single file's pages.
    """
    return files.select("path", "stem", "content").mapInPandas(_read, PAGES)


def page_words(pages: DataFrame) -> DataFrame:
    """words(doc_id, page_index, page_height, text, x0, top, bottom) of PAGES."""
    rows = pages.where("error IS NULL").select(F.col("path").alias("doc_id"), F.col("page_number").alias("page_index"), "page_height", F.explode("words").alias("w"))
    return rows.select("doc_id", "page_index", "page_height", "w.*")


def pdf_records(pages: DataFrame, cleanup: bool = False, threshold: float = 0.5, extracted_at=None) -> DataFrame:
    """One record for each PDF of PAGES, by its path, with ``extracted_at``; banners removed on demand."""
    good = pages.where("error IS NULL")
    titles = good.groupBy(F.col("path").alias("doc_id")).agg(F.first("stem").alias("stem"), F.first("meta_title").alias("meta_title"))
    rows = good.select(F.col("path").alias("doc_id"), F.col("page_number").cast("long").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))
    if cleanup:
        records = documents.clean_records(rows, page_words(pages), titles, threshold)
    else:
        content = documents.page_content(F.col("text"), F.lit(None).cast("array<array<array<string>>>"))
        records = documents.assemble(rows.select("doc_id", "page_number", content.alias("content")), titles)
    when = F.current_timestamp() if extracted_at is None else extracted_at
    return records.withColumn("extracted_at", documents.iso_time(when))


def pdf_summary(pages: DataFrame) -> DataFrame:
    """One row: files processed, read and failed."""
    files = pages.groupBy("path").agg(F.max("error").alias("error"))
    return documents.parse_summary(files)
