from __future__ import annotations

import plain
import pytest
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.functions import urls
from sievework.operators import documents, retrieval

BASE = "http://example.net/"
PAGES = [
    ("https://www.example.net:443/about/#x", "http://example.net/about"), ("http://cse.example.net/", "http://cse.example.net/"), ("/a/?b=1", "http://example.net/a?b=1"), ("/a;v=1", "http://example.net/a"),
    ("/x.pdf", "http://example.net/x.pdf"), ("http://example.net//", "http://example.net"), ("/logo.png/", "http://example.net/logo.png"), ("/logo.PNG", None), ("#top", None), ("", None), (None, None),
    ("mailto:a@b", None), ("ftp://example.net/a", None), ("http://evilexample.net/", None), ("http://example.net:8080/a", None), ("../up", "http://example.net/up"), ("rel/x", "http://example.net/rel/x"),
]


def test_normalize_page(spark):
    rows = spark.createDataFrame(PAGES, "url string, want string")
    got = rows.select("url", "want", urls.normalize_page(F.col("url"), F.lit(BASE), "example.net").alias("got")).collect()
    assert [(r["url"], r["got"]) for r in got] == PAGES


@pytest.mark.parametrize("line, want", [("B. Tech. (CSE) VI Semester 2023-24", "btech cse semester"), ("HILLSIDE UNIVERSITY, TOWN - 506009", "hillside university town"), ("Page 3 of 10", "page"), ("R18 & regulations", "regulations"), ("", "")])
def test_canonical(spark, line, want):
    assert spark.range(1).select(tx.canonical(F.lit(line))).first()[0] == want


def test_words_of_codes_and_numbers_are_ascii(spark):
    """A letter of another script opens and closes words, as in SQL and in plain.py."""
    rows = [("ÜCS 101", True), ("CS 101é", True), ("ACS 1012345", False), ("CS 101", True), ("Ü506009 CS 101", False), ("CS 2019Ö", False)]
    got = spark.createDataFrame([(line,) for line, _ in rows], "line string").select("line", tx.never_remove(F.col("line")).alias("kept")).collect()
    assert [tuple(r) for r in got] == rows == [(line, plain.must_stay(line)) for line, _ in rows]
    assert spark.range(1).select(tx.never_remove(F.lit("weißberge 91"))).first()[0]


@pytest.mark.parametrize("text, want", [("  B.Tech – Syllabus! ", "b-tech-syllabus"), ("!!!", "pdf")])
def test_slug(spark, text, want):
    assert spark.range(1).select(tx.slug(F.lit(text))).first()[0] == want


def _paged(spark, pages):
    rows = spark.createDataFrame([("d", n, t) for n, t in enumerate(pages, 1)], "doc_id string, page_number long, text string")
    words = []
    for n, text in enumerate(pages, 1):
        lines = text.split("\n")
        for y, line in enumerate(lines):
            words += [("d", n, 12.0 * len(lines), w, 10.0 * x, 12.0 * y) for x, w in enumerate(line.split())]
    return rows, spark.createDataFrame(words, "doc_id string, page_index int, page_height double, text string, x0 double, top double")


def test_repeated_banners_go(spark):
    body = "\n".join(f"unique words number {'abcdefgh'[k]} stay" for k in range(8))
    rows, words = _paged(spark, [f"Hillside Academy Bulletin\n{body}\nprinted by hillside press" for _ in range(4)])
    cleaned, report = documents.clean_documents(rows, words, 0.5)
    texts = [r["text"] for r in cleaned.select(cleaned.columns[-1]).toDF("text").collect()]
    assert len(texts) == 4 and all("Bulletin" not in t for t in texts)
    assert any("Hillside Academy Bulletin" in r["removed_repeated_lines"] for r in report.collect())


def test_single_pages_stay(spark):
    rows, words = _paged(spark, ["Hillside Academy Bulletin\nbody of text"])
    cleaned, _ = documents.clean_documents(rows, words, 0.5)
    assert "Bulletin" in cleaned.select(cleaned.columns[-1]).first()[0]


def test_words_group_by_the_first_of_a_line(spark):
    words = spark.createDataFrame([("d", 1, 100.0, w, x, t) for w, x, t in [("b", 10.0, 4.0), ("a", 0.0, 0.0), ("c", 0.0, 8.0), ("d", 5.0, 9.0)]], "doc_id string, page_index int, page_height double, text string, x0 double, top double")
    assert [r["line"] for r in documents.group_words(words).orderBy("line_no").collect()] == ["a b", "c d"]


def test_queries_in_blocks(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = vectors.where("vec_id < 12").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    one, many = (sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.cosine_top_k(vectors, queries, 3, block_bytes=size).collect()) for size in (1 << 20, 2000))
    assert one == many and len(one) == 36
