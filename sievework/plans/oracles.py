"""DuckDB twins of the registered queries."""

from __future__ import annotations

from sievework.functions import rules
from sievework.functions import text as tx
from sievework.functions.urls import _SPLIT, PDF, SKIPPED_EXTENSIONS
from sievework.operators.chat import SYSTEM_PROMPT
from sievework.plans import samples


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    cell = lambda v: quoted(v) if v is None or isinstance(v, str) else str(v).lower()
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names}))"


D = samples.DOMAIN
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
URLS = f"SELECT url FROM pages UNION ALL SELECT url FROM {_values([(u,) for u in samples.URLS], 'url')}"
_PART = "regexp_extract({0}, " + quoted(_SPLIT) + ", {1})"
_HOST = r"regexp_replace(regexp_replace(lower(trim({0})), '^www\.', ''), ':(?:80|443)$', '')"
_EXT = quoted(r"(?i)\.(?:" + "|".join(SKIPPED_EXTENSIONS) + ")$")


def _normalized(pdf: bool) -> str:
    host = "lower(net)" if pdf else _HOST.format("net")
    path = "pth" if pdf else "CASE WHEN pth = '/' THEN pth ELSE regexp_replace(pth, '/+$', '') END"
    skip = "" if pdf else f" AND NOT regexp_matches(raw, {_EXT})"
    return rf"""
    WITH r AS (SELECT url, trim(url) AS t, CASE WHEN starts_with(trim(url), '/') THEN 'http://{D}' || trim(url) ELSE trim(url) END AS whole FROM ({URLS})),
    p AS (SELECT url, t, lower({_PART.format('whole', 1)}) AS sch, {_PART.format('whole', 2)} AS net, regexp_replace({_PART.format('whole', 3)}, ';[^/]*$', '') AS raw, {_PART.format('whole', 4)} AS q FROM r),
    h AS (SELECT url, t, sch, raw, q, CASE WHEN raw = '' THEN '/' ELSE raw END AS pth, {host} AS host FROM p)
    SELECT url, CASE WHEN t <> '' AND NOT starts_with(t, '#') AND sch IN ('http', 'https') AND (host = '{D}' OR ends_with(host, '.{D}')){skip}
      THEN 'http://' || host || {path} || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS normalized FROM h"""


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'pdf')".format(STRIP.format("url"))
_LINES = "(SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1 - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))"
_SQUEEZED = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
_WORDS = (
    r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(line, '')), '[^a-z0-9]+', ' ', 'g'), '\b([bm]) tech\b', '\1tech', 'g')), ' '), "
    r"lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(map(quoted, tx.STOPWORDS)) + rf") AND NOT regexp_matches(w, '[0-9]') AND NOT regexp_matches(w, {quoted(tx.ROMAN)}))"
)
_YEARLESS = r"\b[A-Z]{2,6}\s*[/-]?\s*(?:[0-9]{2,3}[A-Z]{0,3}|(?:1[0-8]|2[1-9]|[03-9][0-9])[0-9]{2}[A-Z]{0,3}|(?:19|20)[0-9]{2}[A-Z]{1,3})\b"


def _any(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(p)})" for p in parts) + ")"


_TABULAR = f"(starts_with(upper({STRIP.format('line')}), '[TABLE') OR contains(line, '|'))"
_BOILER = f"({_any('upper(line)', [*tx.INSTITUTION_PARTS, *tx.BANNER_PARTS])} OR regexp_matches(upper(line), '\\b[0-9]{{6}}\\b'))"
_KEPT = f"({STRIP.format('line')} = '' OR {_any('upper(line)', [*tx.PROTECTED_PARTS, *tx.BUSINESS_PARTS])} OR (regexp_matches(upper(line), {quoted(_YEARLESS)}) AND NOT {_BOILER}) OR {_TABULAR})"


def _inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _score(cues, c: str) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({c}, {quoted(p)}) THEN {w} ELSE 0 END" for p, w in cues)


def _typed(source: str, keys: str, rule_list, least: int, shown: bool) -> str:
    kinds = [k for k, _ in rule_list]
    scores = ", ".join(f"CAST({_score(cues, 'sample')} AS INTEGER) AS {k}" for k, cues in rule_list)
    top = f"greatest({', '.join(kinds)})"
    case = " ".join(f"WHEN {k} = {top} THEN '{k}'" for k in kinds)
    return f"""
    WITH s AS (SELECT {keys}, substr(lower({_SQUEEZED.format('text')}), 1, 20000) AS sample FROM {source}), p AS (SELECT {keys}, sample, {scores} FROM s)
    SELECT {keys}{', ' + ', '.join(kinds) if shown else ''}, CASE WHEN sample = '' OR {top} < {least} THEN 'unknown' {case} END AS document_type FROM p"""


_DECODED = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TITLE = _SQUEEZED.format(_DECODED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))
_BODY = (
    "array_to_string(list_filter(list_transform(string_split("
    + _DECODED.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', chr(10), 'g')")
    + ", chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
)


def _page_links(extra: str = "") -> str:
    net = _HOST.format(_PART.format("url", 2))
    return rf"""
    WITH l AS (SELECT DISTINCT url AS page_url, {net} AS host, {_DECODED.format('unnest(regexp_extract_all(html, ' + quoted('<a href="([^"]*)"') + ', 1))')} AS href FROM pages),
    links AS (SELECT DISTINCT page_url, 'http://' || host || CASE WHEN href = '/' THEN href ELSE regexp_replace(href, '/+$', '') END AS link FROM l
      WHERE (host = '{D}' OR ends_with(host, '.{D}')) AND NOT regexp_matches(href, {_EXT}))"""


def _record_type() -> str:
    path = f"lower({_PART.format('url', 3)})"
    cases = " ".join(f"WHEN {_any('seen', cues)} THEN '{k}'" for k, cues in rules.PAGE_RULES)
    return f"CASE WHEN {path} IN ('', '/') OR ends_with({path}, '/index.html') OR ends_with({path}, '/index.php') THEN 'homepage' {cases} ELSE 'general' END"


_EDGES = _values(samples.EDGES, "src, dst, is_pdf")
_NODES = _values(samples.NODES, "url, ok")
_BFS = f"""
    WITH RECURSIVE e AS {_EDGES}, n AS {_NODES},
    r(url, depth) AS (SELECT 'A', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url JOIN n ON n.url = r.url WHERE n.ok AND NOT e.is_pdf AND r.depth < 2),
    v AS (SELECT r.url, CAST(min(r.depth) AS INTEGER) AS depth, coalesce(any_value(n.ok), false) AS ok FROM r LEFT JOIN n ON n.url = r.url GROUP BY r.url)"""
_PDFS = "(SELECT source || '-' || CAST(doc_id // 1000 AS VARCHAR) AS doc_id, doc_id AS page_number, " + STRIP.format("coalesce(text, '')") + " AS content FROM documents)"
_PDF_ROWS = [
    (f"http://{D}/docs/plan.pdf", "Plan", f"http://{D}/5", "plan.pdf", "new"), (f"http://{D}/other/plan.pdf", "PDF", f"http://{D}/5", "plan.pdf", "skipped"),
    (f"http://{D}/c.pdf?v=2", "Third", f"http://{D}/5", "c.pdf", "new"), (f"http://{D}/e.pdf", "Label", f"http://{D}/6", "e.pdf", "new"),
]
_MEANS = "(SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)"
_TOP = f"""
    WITH q AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY i) AS query FROM {_MEANS} GROUP BY label),
    s AS (SELECT query_id, vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), query) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product(query, query)) AS sim
      FROM embeddings, q WHERE vec_id <> query_id),
    t AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5)"""

ORACLES: dict[str, str] = {
    "url_normalize": _normalized(False),
    "pdf_url_normalize": _normalized(True),
    "url_flags": f"""SELECT url, host, host = '{D}' OR ends_with(host, '.{D}') AS allowed, regexp_matches({_PART.format('url', 3)}, {_EXT}) AS skipped, regexp_matches({STRIP.format('url')}, {quoted(PDF)}) AS pdf
      FROM (SELECT url, {_HOST.format(_PART.format('url', 2))} AS host FROM ({URLS}))""",
    "url_file_names": rf"""
    WITH u AS (SELECT url, substr(sha256(url), 1, 12) AS hash, {_SLUG} AS slug, regexp_extract(url, '(?i)([^/=?&]+\.pdf)(?:$|[?#&])', 1) AS pdf_name,
      replace({_PART.format('url', 2)}, ':', '_') AS net, replace(regexp_replace(regexp_replace({_PART.format('url', 3)}, ';[^/]*$', ''), '^/+|/+$', '', 'g'), '/', '_') AS pth FROM ({URLS}))
    SELECT url, coalesce(nullif(net, ''), 'unknown-host') || '__' || coalesce(nullif(pth, ''), 'root') || '__' || hash || '.json' AS page_file, hash,
      CASE WHEN pdf_name = '' THEN 'document__' || hash || '.pdf' ELSE regexp_replace(pdf_name, '[^A-Za-z0-9._-]+', '_', 'g') END AS pdf_file, slug, substr(slug, 1, 60) || '__' || hash || '.json' AS metadata_file FROM u""",
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "html_text": f"SELECT page_id, content, CAST(length(content) AS INTEGER) AS content_length FROM (SELECT page_id, {_BODY} AS content FROM pages)",
    "html_links": _page_links() + " SELECT page_url, link FROM links",
    "links_by_page": _page_links() + " SELECT page_url, string_agg(link, ' ' ORDER BY link) AS links FROM links GROUP BY page_url",
    "page_record": f"""
    WITH p AS (SELECT page_id, url, {_TITLE} AS title, {_BODY} AS content FROM pages), s AS (SELECT *, lower(url || ' ' || title || ' ' || substr(content, 1, 2000)) AS seen FROM p)
    SELECT page_id, title, content, url AS source, CAST(length(content) AS INTEGER) AS content_length, {_record_type()} AS page_type FROM s""",
    "html_samples": "SELECT * FROM "
    + _values(
        [(f"http://{D}/1", "FooBar", "Foo\nBar\nx\ny", 0, 0), (f"http://{D}/2", "Real one", "Skip me\nReal one", 0, 0), (f"http://{D}/3", "", "a\nf", 0, 0), (f"http://{D}/4", "", "a | b", 0, 0), (f"http://{D}/5", "", "Plan", 2, 3), (f"http://{D}/6", "", "Again", 1, 3)],
        "url, title, content, n_links, n_pdfs",
    ),
    "page_types": f"SELECT url, title, {_record_type()} AS page_type FROM (SELECT *, lower(url || ' ' || title || ' ' || substr(content, 1, 2000)) AS seen FROM {_values(samples.PAGE_TYPES, 'url, title, content')})",
    "pdf_first_seen": "SELECT * FROM " + _values(_PDF_ROWS, "pdf_url, title, discovered_from, file_name, status"),
    "pdf_summary": f"SELECT count(*) AS pdfs_discovered, count(*) FILTER (WHERE status = 'new') AS pdfs_new, count(*) FILTER (WHERE status = 'skipped') AS pdfs_skipped FROM {_values(_PDF_ROWS, 'a, b, c, d, status')}",
    "crawl_levels": _BFS + " SELECT url, depth, ok FROM v",
    "crawl_summary": _BFS
    + " SELECT count(*) AS pages_crawled, count(*) FILTER (WHERE ok) AS pages_saved, count(*) FILTER (WHERE NOT ok) AS failed_pages, CAST(max(depth) AS BIGINT) AS max_depth_reached, (SELECT count(DISTINCT dst) FROM e JOIN v ON v.url = e.src WHERE v.ok) AS links_discovered FROM v",
    "crawl_budget": "SELECT CAST(2 AS BIGINT) AS pages_crawled, CAST(2 AS BIGINT) AS pages_saved, CAST(0 AS BIGINT) AS failed_pages, CAST(1 AS BIGINT) AS max_depth_reached, CAST(4 AS BIGINT) AS links_discovered",
    "split_lines": f"SELECT doc_id, line_no, line, {_SQUEEZED.format('line')} AS squeezed FROM {_LINES}",
    "collapse_lines": f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> ''), chr(10)) AS text FROM documents",
    "canonical_lines": f"SELECT doc_id, line_no, array_to_string(w, ' ') AS canonical, CAST(len(list_distinct(w)) AS INTEGER) AS n_tokens FROM (SELECT doc_id, line_no, {_WORDS} AS w FROM {_LINES})",
    "line_flags": f"SELECT doc_id, line_no, lower({_SQUEEZED.format('line')}) IN ({', '.join(map(quoted, tx.UI_PHRASES))}) AS ui, {_TABULAR} AS tabular, {_BOILER} AS boilerplate, {_KEPT} AS kept, list_has_any({_WORDS}, [{', '.join(map(quoted, tx.SYLLABUS_TOKENS))}]) AS syllabus FROM {_LINES}",
    "header_footer_window": f"""
    WITH e AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS down FROM {_LINES} WHERE {STRIP.format('line')} <> '' AND NOT {_TABULAR})
    SELECT doc_id, line_no, CASE WHEN up <= 10 THEN 'header' ELSE 'footer' END AS zone FROM e WHERE up <= 10 OR down <= 5""",
    "line_similarity": f"""
    WITH t AS (SELECT doc_id, line_no, list_distinct({_WORDS}) AS a FROM {_LINES}),
    p AS (SELECT x.doc_id, x.line_no, {_inter('x.a', 'y.a')} AS n, len(x.a) AS na, len(y.a) AS nb FROM t x JOIN t y ON y.doc_id = x.doc_id AND y.line_no = x.line_no + 1),
    s AS (SELECT doc_id, line_no, CASE WHEN na > 0 AND nb > 0 THEN CAST(n AS DOUBLE) / (na + nb - n) ELSE 0.0 END AS jaccard, CASE WHEN na > 0 AND nb > 0 THEN CAST(n AS DOUBLE) / least(na, nb) ELSE 0.0 END AS overlap FROM p)
    SELECT doc_id, line_no, CAST(jaccard AS DOUBLE) AS jaccard, CAST(overlap AS DOUBLE) AS overlap, jaccard >= 0.6 OR overlap >= 0.8 AS similar FROM s""",
    "document_types": _typed(_values(samples.DOCUMENT_TYPES, "id, text"), "id", rules.DOCUMENT_RULES, 6, False),
    "document_type_scores": _typed("documents", "doc_id", rules.parse_rules(samples.CORPUS_RULES), 4, True),
    "group_words": f"""
    WITH w AS (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS words FROM {_LINES}),
    f AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS line_no, line_no * 12.0 AS top, words FROM w WHERE len(words) > 0)
    SELECT doc_id, CAST(1 AS INTEGER) AS page_index, line_no, CAST(top AS DOUBLE) AS top, {_SQUEEZED.format("array_to_string(words, ' ')")} AS line FROM f""",
    "crawl_numbers": """
    WITH RECURSIVE t(n, depth) AS (
      SELECT CAST(0 AS BIGINT), 0 UNION ALL
      SELECT 3 * t.n + v.k, depth + 1 FROM t JOIN pages p ON p.page_id = t.n AND length(p.html) > 0 AND t.n % 7 <> 6, (VALUES (1), (2), (3)) AS v(k) WHERE depth < 4),
    placed AS (SELECT n, depth, row_number() OVER (ORDER BY depth, n) - 1 AS place FROM t)
    SELECT lpad(CAST(n AS VARCHAR), 12, '0') AS url, CAST(depth AS INTEGER) AS depth, place, coalesce(length(p.html) > 0 AND n % 7 <> 6, false) AS ok
    FROM placed LEFT JOIN pages p ON p.page_id = n WHERE place < 60""",
    "page_tables": "SELECT * FROM " + _values([(1, "Head\n\n[TABLE 1]\na |  | b\n\n[TABLE 3]\nc"), (2, ""), (3, "[TABLE 1]\nx | y"), (4, "only text")], "id, content"),
    "assemble_documents": f"""
    WITH d AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS page_count, {STRIP.format("string_agg(content, chr(10) || chr(10) ORDER BY page_number)")} AS whole, CAST(sum(length(content)) AS INTEGER) AS content_length FROM {_PDFS} GROUP BY doc_id)
    SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split(whole, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')[1], 1, 200), doc_id) AS title, doc_id || '.pdf' AS source_pdf, page_count, content_length,
      md5(whole) AS full_content_md5, content_length > 0 AS text_extracted, content_length = 0 AS needs_ocr, CASE WHEN content_length = 0 THEN 'pending' END AS ocr_status FROM d""",
    "record_json": f"""SELECT '{{"doc_id":"' || doc_id || '","page_count":' || count(*) || ',"content_length":' || sum(length(content)) || ',"needs_ocr":' || CASE WHEN sum(length(content)) = 0 THEN 'true,"ocr_status":"pending"}}' ELSE 'false}}' END AS value FROM {_PDFS} GROUP BY doc_id""",
    "parse_summary": "SELECT count(*) AS pdfs_processed, count(*) AS pdfs_successful, CAST(0 AS BIGINT) AS pdfs_failed FROM pages",
    "valid_questions": f"SELECT conv_id, turn, CASE WHEN coalesce({STRIP.format('text')}, '') = '' THEN 400 ELSE 200 END AS status FROM conversations WHERE role = 'user'",
    "chat_requests": f"""SELECT conv_id, turn, '{{"model":"{samples.MODEL}","messages":[{{"role":"system","content":' || CAST(to_json({quoted(SYSTEM_PROMPT)}) AS VARCHAR) || '}},{{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '}}],"temperature":0.2,"max_tokens":512}}' AS body
      FROM conversations WHERE role = 'user' AND {STRIP.format('text')} <> ''""",
    "chat_replies": "SELECT id, reply_status, answer, coalesce(nullif(answer, ''), 'No answer was returned.') AS shown FROM " + _values([(1, 200, "hi"), (2, 502, None), (3, 502, None), (4, 502, None), (5, 200, "")], "id, reply_status, answer"),
    "chunk_overlap": """
    WITH n AS (SELECT doc_id, text, CASE WHEN length(text) > 1000 THEN CAST(ceil((length(text) - 200) / 800.0) AS INTEGER) WHEN length(text) > 0 THEN 1 ELSE 0 END AS n FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(text, i * 800 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, n)) AS i FROM n)""",
    "cosine_top_k": _TOP + " SELECT query_id, vec_id, rank FROM t",
    "retrieve_with_citation": _TOP + " SELECT query_id, t.vec_id, rank, source, '[' || rank || '] ' || coalesce(source, 'unknown') AS citation FROM t LEFT JOIN documents d ON d.doc_id = t.vec_id",
}
