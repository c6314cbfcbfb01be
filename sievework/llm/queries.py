"""The ten queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_format, exact_dedup, jaccard_join, license_scan, mixing, quality, toxicity, url_filter
from .common import table

URL_RULES = [
    (1, "example.net", "allow"),
    (2, "tionsh.example.net", "block"),
    (3, "tionsh.example.net/en/", "allow"),
    (4, "tionsh.example.net/en/1", "block"),
    (5, "tionsh.example.net/fr/", "review"),
    (6, "example.org", "review"),
    (7, "ththth.example.org", "block"),
    (8, "blog.ththth.example.org", "allow"),
    (9, "m.thther.example.org/de/", "block"),
    (10, "tiontion.example.com", "block"),
    (11, "m.tiontion.example.com/", "allow"),
    (12, "blog.tionble.example.com/en/7", "block"),
    (13, "example.com", "allow"),
    (14, "com", "review"),
]
BLOCK_LIST = [line.split()[1] for line in Path(__file__).with_name("block_list.txt").read_text().splitlines() if line and not line.startswith("#")]
URL_RULES += [(100 + k, host, "block") for k, host in enumerate(BLOCK_LIST)]
SRC_DOMAINS = {"src0": "web", **{f"src{i}": "forum" for i in range(1, 7)}, **{f"src{i}": "news" for i in range(7, 14)}, **{f"src{i}": "reference" for i in range(14, 20)}}
MIX = mixing.Mix(
    domains=SRC_DOMAINS,
    domain_weights={"web": 0.34, "forum": 0.2, "news": 0.24, "reference": 0.22, "other": 0.1},
    lang_weights={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    source_weights={"src18": 1.5, "src19": 1.5},
    share=0.95,
    epochs=2,
)
# A copy with every twentieth word changed keeps a Jaccard similarity of about 0.74 on word 3-grams, one with every eleventh 0.6;
# unrelated texts that share a passage come to 0.35 at most. The threshold lies in the gap between.
NEAR_THRESHOLD, NEAR_N = 0.5, 3


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule_id long, pattern string, action string")
    return url_filter.match_urls(table(spark, sf_dir, "pages"), rules)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license").distinct()


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and the hash of what they decode to."""
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")), keep_tokens=True)
    return back.select("doc_id", "tokens", F.md5("text").alias("decoded_md5"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that has near copies, with its class and the number of its links."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), NEAR_THRESHOLD, NEAR_N)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), 10, F.col("id") % 50 == 0)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mixed(docs, MIX)
    return out.select("row.doc_id", *mixing.LEAF, mixing.token_count(F.col("row.text")).alias("n_tokens"), "epoch")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier rejects."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxic").select("doc_id", "toxicity")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_exact_dedup, op3_license_scans, op4_bpe, op5_ngram_jaccard_join, op6_nearest_neighbours, op7_source_mixing, op8_toxicity, op9_quality, op10_chat_format)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_sql() -> str:
    values = ", ".join(f"({i}, {_quoted(p)}, {_quoted(a)})" for i, p, a in URL_RULES)
    return f"""
    WITH rules AS (
      SELECT rule_id, action, array_to_string(list_reverse(string_split(split_part(pattern, '/', 1), '.')), ',') || ','
        || CASE WHEN contains(pattern, '/') THEN substr(pattern, strpos(pattern, '/')) ELSE '' END AS prefix
      FROM (VALUES {values}) AS r(rule_id, pattern, action)),
    parts AS (
      SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@|:[0-9]*$', '', 'g') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest
      FROM pages),
    keyed AS (
      SELECT page_id, url, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ','
        || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS "key"
      FROM parts),
    hits AS (
      SELECT k.page_id, k.url, k."key", r.rule_id, r.action,
        row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY length(r.prefix) DESC, r.rule_id) AS place
      FROM keyed k LEFT JOIN rules r ON starts_with(k."key", r.prefix))
    SELECT page_id, url, "key", CAST(rule_id AS BIGINT) AS rule_id, coalesce(action, 'allow') AS action FROM hits WHERE place = 1
    """


def _license_sql() -> str:
    one = "SELECT doc_id, {name} AS license FROM documents WHERE regexp_matches(lower(text), {pattern})"
    return " UNION ".join(one.format(name=_quoted(k), pattern=_quoted(license_scan.to_regex(t))) for k, t in license_scan.TEMPLATES.items())


def _chat_sql() -> str:
    t = chat_format.CHATML
    case = lambda f: "CASE role " + " ".join(f"WHEN {_quoted(k)} THEN {f(v)}" for k, v in t.roles.items()) + " END"
    text = lambda s: _quoted(s).replace("\n", "' || chr(10) || '")
    moves = " OR ".join(f"(before = {_quoted(a)} AND role IN ({', '.join(map(_quoted, bs))}))" for a, bs in t.next_roles.items())
    known = ", ".join(map(_quoted, t.roles))
    return f"""
    WITH t AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text,
        coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start') AS before,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place
      FROM conversations WHERE conv_id IS NOT NULL),
    judged AS (
      SELECT conv_id, CASE
        WHEN count(DISTINCT turn) <> count(*) THEN 'repeated turn'
        WHEN count(*) FILTER (WHERE role IS NULL OR role NOT IN ({known})) > 0 THEN 'unknown role'
        WHEN count(*) FILTER (WHERE NOT ({moves})) > 0 THEN 'turn order'
        WHEN max_by(role, turn) NOT IN ({', '.join(map(_quoted, t.final))}) THEN 'final role' END AS error
      FROM t GROUP BY conv_id),
    good AS (SELECT t.* FROM t JOIN judged j USING (conv_id) WHERE j.error IS NULL)
    SELECT conv_id, CAST(3 * place AS INTEGER) AS seg, {case(lambda v: text(v.before))} AS text, false AS loss, CAST(NULL AS VARCHAR) AS error FROM good
    UNION ALL SELECT conv_id, CAST(3 * place + 1 AS INTEGER), text, {case(lambda v: str(v.loss).lower())}, NULL FROM good
    UNION ALL SELECT conv_id, CAST(3 * place + 2 AS INTEGER), {case(lambda v: text(v.after))}, {case(lambda v: str(v.loss).lower())}, NULL FROM good
    UNION ALL SELECT conv_id, NULL, NULL, NULL, error FROM judged WHERE error IS NOT NULL
    """


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the tests hold the others against brute force."""
    return {
        "op1_url_filters": _url_sql(),
        "op2_exact_dedup": "SELECT doc_id, dup_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS dup_of FROM documents WHERE text IS NOT NULL) WHERE doc_id <> dup_of",
        "op3_license_scans": _license_sql(),
        "op10_chat_format": _chat_sql(),
    }
