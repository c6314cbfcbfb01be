"""Registered queries of the engine's own operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import rules, urls
from sievework.functions import text as tx
from sievework.operators import chat, crawl, documents, pages, retrieval
from sievework.plans import samples
from sievework.plans.oracles import ORACLES
from sievework.sources import sinks
from sievework.sources.tables import materialise, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(u,) for u in samples.URLS], "url string")
    return read_table(spark, sf_dir, "pages").select("url").unionByName(extra)


def _base() -> Column:
    return F.lit(samples.BASE)


@query
def url_normalize(spark, sf_dir):
    """The page form of every URL."""
    return _urls(spark, sf_dir).select("url", urls.normalize_page(F.col("url"), _base(), samples.DOMAIN).alias("normalized"))


@query
def pdf_url_normalize(spark, sf_dir):
    """The PDF form, which keeps www. and slashes."""
    return _urls(spark, sf_dir).select("url", urls.normalize_pdf(F.col("url"), _base(), samples.DOMAIN).alias("normalized"))


@query
def url_flags(spark, sf_dir):
    """Canonical host, allowed domain, skipped extension, PDF."""
    u = F.col("url")
    host = urls.canonical_host(urls.netloc(u))
    return _urls(spark, sf_dir).select("url", host.alias("host"), urls.is_allowed(host, samples.DOMAIN).alias("allowed"), urls.has_skipped_extension(urls.path(u)).alias("skipped"), urls.is_pdf(u).alias("pdf"))


@query
def url_file_names(spark, sf_dir):
    """Page, PDF and metadata file names, hash and slug."""
    u = F.col("url")
    return _urls(spark, sf_dir).select("url", urls.page_file_name(u).alias("page_file"), tx.short_hash(u).alias("hash"), urls.pdf_file_name(u).alias("pdf_file"), tx.slug(u).alias("slug"), urls.pdf_metadata_file_name(u, u).alias("metadata_file"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parsed_pages(read_table(spark, sf_dir, "pages"))


@query
def html_title(spark, sf_dir):
    """H1-H3, H12."""
    return _parsed(spark, sf_dir).select("page_id", F.col("page.title").alias("title"))


@query
def html_text(spark, sf_dir):
    """H4-H11, H15."""
    return _parsed(spark, sf_dir).select("page_id", F.col("page.content").alias("content"), F.length("page.content").alias("content_length"))


@query
def html_links(spark, sf_dir):
    """Normalised links to the domain, from the unpruned page."""
    return pages.page_links(_parsed(spark, sf_dir), samples.DOMAIN)


@query
def links_by_page(spark, sf_dir):
    """K8: each page's links, sorted."""
    shown = pages.links_by_page(pages.page_links(_parsed(spark, sf_dir), samples.DOMAIN))
    return shown.select("page_url", F.array_join("links", " ").alias("links"))


@query
def page_record(spark, sf_dir):
    """The page records."""
    return pages.page_records(_parsed(spark, sf_dir))


@query
def html_samples(spark, sf_dir):
    """H1-H12, H14 on pages with navigation, tables, frames and UI phrases."""
    rows = pages.parsed_pages(spark.createDataFrame(samples.HTML, "url string, html string"))
    return rows.select("url", F.col("page.title").alias("title"), F.col("page.content").alias("content"), F.size("page.links").alias("n_links"), F.size("page.pdfs").alias("n_pdfs"))


@query
def page_types(spark, sf_dir):
    """H16 on the sample of paths and titles."""
    rows = spark.createDataFrame(samples.PAGE_TYPES, "url string, title string, content string")
    return rows.select("url", "title", rules.page_type(urls.path(F.col("url")), F.col("url"), F.col("title"), F.col("content")).alias("page_type"))


@query
def pdf_first_seen(spark, sf_dir):
    """PDFs as first seen; equal file names are skipped."""
    rows = pages.parsed_pages(spark.createDataFrame(samples.HTML, "url string, html string"))
    return pages.first_seen_pdfs(pages.pdf_candidates(rows, samples.DOMAIN)).select("pdf_url", "title", "discovered_from", "file_name", "status")


@query
def pdf_summary(spark, sf_dir):
    """Counts of PDFs discovered, to fetch and skipped."""
    return pdf_first_seen(spark, sf_dir).agg(F.count("*").alias("pdfs_discovered"), F.count_if(F.col("status") == "new").alias("pdfs_new"), F.count_if(F.col("status") == "skipped").alias("pdfs_skipped"))


def _crawl(spark: SparkSession, max_pages: int) -> crawl.Crawl:
    edges = spark.createDataFrame(samples.EDGES, "src string, dst string, is_pdf boolean")
    nodes = spark.createDataFrame(samples.NODES, "url string, ok boolean")
    return crawl.crawl(edges, nodes, "A", max_pages, 2)


@query
def crawl_levels(spark, sf_dir):
    """Depth of each page crawled, over a cycle and a diamond."""
    return _crawl(spark, 10).visited.select("url", "depth", "ok")


@query
def crawl_summary(spark, sf_dir):
    """C2, C3, K6."""
    return _crawl(spark, 10).summary()


@query
def crawl_budget(spark, sf_dir):
    """C1, C5 under a page budget that ends inside a level."""
    return _crawl(spark, 2).summary()


@query
def crawl_pages(spark, sf_dir):
    """C1 over the links of the pages table, from its first page of the domain; the HTML is parsed once."""
    parsed = _parsed(spark, sf_dir).select("url", "page")
    own = urls.normalize_page(F.col("url"), _base(), samples.DOMAIN)
    hrefs = materialise(parsed.select(own.alias("src"), "page.links").where("src IS NOT NULL").select("src", F.explode_outer("links").alias("href")))
    nodes = materialise(hrefs.groupBy(F.col("src").alias("url")).agg(F.lit(True).alias("ok")))
    links = hrefs.select("src", urls.normalize_page(F.col("href"), F.col("src"), samples.DOMAIN).alias("dst")).where("dst IS NOT NULL").distinct()
    edges = materialise(links.withColumn("is_pdf", urls.is_pdf(F.col("dst"))))
    seed = nodes.agg(F.min("url")).first()[0]
    return crawl.crawl(edges, nodes, seed or samples.BASE).summary()


@query
def crawl_numbers(spark, sf_dir):
    """C1-C5 over the whole pages table: page n links to pages 3n + 1 to 3n + 3, to its parent, and to a PDF; each seventh page can't be fetched."""
    at = lambda n: F.lpad(n.cast("string"), 12, "0")
    n = F.col("page_id")
    rows = read_table(spark, sf_dir, "pages").select("page_id", (F.length("html") > 0).alias("some"))
    nodes = materialise(rows.select(at(n).alias("url"), (F.col("some") & (n % 7 != 6)).alias("ok")))
    links = F.array(*(F.struct(at(m).alias("dst"), F.lit(False).alias("is_pdf")) for m in (3 * n + 3, 3 * n + 1, 3 * n + 2, F.greatest(F.floor((n - 1) / 3), F.lit(0)))), F.struct(F.concat(at(n), F.lit(".pdf")).alias("dst"), F.lit(True).alias("is_pdf")))
    edges = materialise(rows.select(at(n).alias("src"), F.inline(links)))
    return crawl.crawl(edges, nodes, "0" * 12, 60, 4).visited.select("url", "depth", "place", "ok")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return documents.page_lines(docs.select("doc_id", F.lit(1).alias("page_number"), "text"))


@query
def split_lines(spark, sf_dir):
    """Lines of every document, squeezed."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", "line", tx.squeeze(F.col("line")).alias("squeezed"))


@query
def collapse_lines(spark, sf_dir):
    """Blank lines dropped, others stripped."""
    return read_table(spark, sf_dir, "documents").select("doc_id", tx.collapse_lines(F.col("text")).alias("text"))


@query
def canonical_lines(spark, sf_dir):
    """Canonical form and token count of every line."""
    return _lines(spark, sf_dir).select("doc_id", "line_no", tx.canonical(F.col("line")).alias("canonical"), F.size(tx.token_set(F.col("line"))).alias("n_tokens"))


@query
def line_flags(spark, sf_dir):
    """H7, P8, P15-P17."""
    line = F.col("line")
    return _lines(spark, sf_dir).select("doc_id", "line_no", tx.is_ui_phrase(line).alias("ui"), tx.is_table_line(line).alias("tabular"), tx.looks_like_boilerplate(line).alias("boilerplate"), tx.never_remove(line).alias("kept"), tx.looks_like_syllabus(tx.token_set(line)).alias("syllabus"))


@query
def header_footer_window(spark, sf_dir):
    """P24."""
    docs = read_table(spark, sf_dir, "documents")
    return documents.window_lines(docs.select("doc_id", F.lit(1).alias("page_number"), "text")).select("doc_id", "line_no", "zone")


@query
def line_similarity(spark, sf_dir):
    """Each line against the next of its document."""
    docs = read_table(spark, sf_dir, "documents")
    sets = docs.select("doc_id", F.transform(tx.lines(F.coalesce("text", F.lit(""))), lambda line: tx.token_set(line)).alias("s"))
    pairs = F.arrays_zip(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))).alias("a"), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))).alias("b"))
    rows = sets.select("doc_id", F.posexplode(pairs).alias("line_no", "p"))
    a, b = F.col("p").getField("a"), F.col("p").getField("b")
    return rows.select("doc_id", "line_no", tx.jaccard(a, b).alias("jaccard"), tx.overlap(a, b).alias("overlap"), tx.similar(a, b).alias("similar"))


@query
def document_types(spark, sf_dir):
    """P6, P7 on the sample texts."""
    rows = spark.createDataFrame(samples.DOCUMENT_TYPES, "id int, text string")
    sample = rules.classification_sample(F.lit(""), F.array("text"))
    return rows.select("id", rules.document_type(sample, F.length("text")).alias("document_type"))


@query
def document_type_scores(spark, sf_dir):
    """P7 with rules for the documents table: the score of every type, and the type."""
    own = rules.parse_rules(samples.CORPUS_RULES)
    sample = rules.classification_sample(F.lit(""), F.array("text"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text", sample.alias("sample"))
    scores = [s.alias(kind) for kind, s in rules.document_scores(F.col("sample"), own)]
    return rows.select("doc_id", *scores, rules.document_type(F.col("sample"), F.length("text"), own, least=4).alias("document_type"))


def _pseudo_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of pseudo-PDFs: a thousand ids of a source, in order of id, so that a PDF stays of a PDF's size as the table grows."""
    docs = read_table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string"))
    return docs.select(name.alias("doc_id"), F.col("doc_id").alias("page_number"), "text")


def _words(pages: DataFrame) -> DataFrame:
    """Words laid out on pages: lines 12 apart, words wobbling by up to 4."""
    rows = pages.select("doc_id", F.col("page_number").cast("int").alias("page_index"), tx.lines(F.coalesce("text", F.lit(""))).alias("l"))
    rows = rows.select("doc_id", "page_index", (F.size("l") * 12.0).alias("page_height"), F.posexplode("l").alias("line_no", "line"))
    words = rows.select("doc_id", "page_index", "page_height", "line_no", F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("k", "text"))
    return words.select("doc_id", "page_index", "page_height", "text", (F.col("k") * 10.0).alias("x0"), (F.col("line_no") * 12.0 + (F.col("k") % 3) * 2.0).alias("top"))


def _word_pages(pages: DataFrame) -> DataFrame:
    """The same words, a row for each page."""
    rows = pages.select("doc_id", F.col("page_number").cast("int").alias("page_index"), tx.lines(F.coalesce("text", F.lit(""))).alias("l"))
    placed = lambda line, i: F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w, k: F.struct(w.alias("text"), (k * 10.0).alias("x0"), (i * 12.0 + (k % 3) * 2.0).alias("top")))
    return rows.select("doc_id", "page_index", (F.size("l") * 12.0).alias("page_height"), F.flatten(F.transform("l", placed)).alias("words"))


@query
def group_words(spark, sf_dir):
    """Words of every document into lines."""
    docs = read_table(spark, sf_dir, "documents")
    return documents.group_words(_word_pages(docs.select("doc_id", F.lit(1).alias("page_number"), "text"))).select("doc_id", "page_index", "line_no", "top", "line")


@query
def region_candidates(spark, sf_dir):
    """Possible banners at the top and bottom of pseudo-PDF pages."""
    return documents.region_candidates(_word_pages(_pseudo_pdfs(spark, sf_dir))).select("doc_id", "page_index", "zone", "raw_text", F.size("tokens").alias("n_tokens"))


@query
def banner_patterns(spark, sf_dir):
    """Greedy clusters that repeat on a tenth of the pages."""
    pdfs = _pseudo_pdfs(spark, sf_dir)
    counts = pdfs.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    found = documents.cluster_candidates(documents.region_candidates(_word_pages(pdfs)))
    return documents.removal_patterns(found, counts, 0.1).select("doc_id", "zone", "label", "representative", "n_pages")


@query
def strip_banners(spark, sf_dir):
    """Pages without the lines that repeat."""
    pdfs = _pseudo_pdfs(spark, sf_dir)
    return documents.clean_documents(pdfs, _word_pages(pdfs), 0.1)[0]


@query
def removed_report(spark, sf_dir):
    """P26."""
    pdfs = _pseudo_pdfs(spark, sf_dir)
    report = documents.clean_documents(pdfs, _word_pages(pdfs), 0.1)[1]
    return report.select("doc_id", F.array_join("removed_repeated_lines", "\n").alias("removed_repeated_lines"))


@query
def page_tables(spark, sf_dir):
    """Tables of a page as text blocks."""
    rows = spark.createDataFrame(samples.TABLES, "id int, text string, tables array<array<array<string>>>")
    return rows.select("id", documents.page_content(F.col("text"), F.col("tables")).alias("content"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdfs = _pseudo_pdfs(spark, sf_dir)
    content = documents.page_content(F.col("text"), F.lit(None).cast("array<array<array<string>>>"))
    return documents.assemble(pdfs.select("doc_id", "page_number", content.alias("content")))


@query
def assemble_documents(spark, sf_dir):
    """The document records, their texts as hashes."""
    return _records(spark, sf_dir).select("doc_id", "title", "source_pdf", "page_count", "content_length", F.md5("full_content").alias("full_content_md5"), "text_extracted", "needs_ocr", "ocr_status")


@query
def record_json(spark, sf_dir):
    """K4, K5: records as JSON; null fields are left out."""
    rows = _records(spark, sf_dir).select("doc_id", "page_count", "content_length", "needs_ocr", "ocr_status")
    return sinks.to_json_records(rows)


@query
def parse_summary(spark, sf_dir):
    """A page that can't be read never stops the batch."""
    return documents.parse_summary(_parsed(spark, sf_dir).select(F.col("page.error").alias("error")))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))


@query
def valid_questions(spark, sf_dir):
    """A1, S8."""
    return _questions(spark, sf_dir).select("conv_id", "turn", chat.ask_status(F.col("question")).alias("status"))


@query
def chat_requests(spark, sf_dir):
    """A2: a request body for each question."""
    return _questions(spark, sf_dir).where(tx.strip(F.col("question")) != "").select("conv_id", "turn", chat.request_body(F.col("question"), samples.MODEL).alias("body"))


@query
def chat_replies(spark, sf_dir):
    """Status and answer of replies."""
    rows = spark.createDataFrame(samples.REPLIES, "id int, status int, body string")
    s, b = F.col("status"), F.col("body")
    return rows.select("id", chat.reply_status(s, b).alias("reply_status"), chat.answer(s, b).alias("answer"), chat.display_text(chat.answer(s, b)).alias("shown"))


@query
def chunk_overlap(spark, sf_dir):
    """Extension: overlapping chunks of every document."""
    return retrieval.chunks(read_table(spark, sf_dir, "documents"), 1000, 200)


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    queries = means.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("query"))
    return retrieval.cosine_top_k(vectors, queries, 5)


@query
def cosine_top_k(spark, sf_dir):
    """Extension: of each label's mean the five nearest vectors, exactly."""
    return _top(spark, sf_dir).select("query_id", "vec_id", "rank")


@query
def retrieve_with_citation(spark, sf_dir):
    """Extension: those hits with the document that a vector's id names."""
    sources = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return retrieval.with_citations(_top(spark, sf_dir), sources).select("query_id", "vec_id", "rank", "source", "citation")
