from __future__ import annotations

from collections import defaultdict

import plain
import pytest

from sievework.operators import documents
from sievework.plans import catalog


@pytest.fixture(scope="module")
def pdfs(spark):
    """The pages of the catalog's pseudo-PDFs."""
    out: dict[str, list] = defaultdict(list)
    for r in catalog._pseudo_pdfs(spark, SF).collect():
        out[r["doc_id"]].append((r["page_number"], r["text"]))
    return {k: sorted(v) for k, v in out.items()}


SF = "/root/testdata/sf0.001"


def test_candidates(spark, pdfs):
    got = sorted((r["doc_id"], r["page_index"], r["zone"], r["raw_text"], r["n_tokens"]) for r in catalog.QUERIES["region_candidates"](spark, SF).collect())
    want = sorted((d, n, zone, line, len(set(plain.token_list(line)))) for d, pages in pdfs.items() for n, text in pages for zone, line in plain.candidates(text))
    assert got == want and len(want) > 50


def test_patterns(spark, pdfs):
    got = sorted(tuple(r) for r in catalog.QUERIES["banner_patterns"](spark, SF).select("doc_id", "zone", "label", "representative", "n_pages").collect())
    want = sorted((d, zone, label, raw, n) for d, pages in pdfs.items() for zone, label, _, raw, n in plain.patterns(pages, 0.1))
    assert got == want and want


def test_cleaned_pages(spark, pdfs):
    got = {(r["doc_id"], r["page"]): r["text"] for r in catalog.QUERIES["strip_banners"](spark, SF).collect()}
    want = {(d, n): text for d, pages in pdfs.items() for n, text in plain.cleaned(pages, 0.1)[0].items()}
    assert got == want and any(want[d, n] != (text or "").strip() for d, pages in pdfs.items() for n, text in pages)


def test_report(spark, pdfs):
    got = {r["doc_id"]: r["removed_repeated_lines"].split("\n") for r in catalog.QUERIES["removed_report"](spark, SF).collect()}
    want = {d: lines for d, pages in pdfs.items() if (lines := plain.cleaned(pages, 0.1)[1])}
    assert got == want and want


def _body(page: str, n: int) -> list[str]:
    """Lines that no other page has."""
    return [f"w{page}{chr(97 + k)}one w{page}{chr(97 + k)}two w{page}{chr(97 + k)}three" for k in range(n)]


def _paged(spark, texts):
    rows = spark.createDataFrame([("d", n, t) for n, t in enumerate(texts, 1)], "doc_id string, page_number long, text string")
    return rows, catalog._words(rows)


def test_a_line_takes_the_first_cluster_that_fits(spark):
    """Page 4's line holds both banners; the one that was met first has it, though the other stands on more pages."""
    first, second = "apple banana cherry damson", "mango nectar olive peach"
    heads = [[first, second], [first, second], [second, "x1"], [f"{first} {second}", "x2"]]
    texts = ["\n".join([*head, *_body(page, 18)]) for page, head in zip("pqrs", heads)]
    rows, words = _paged(spark, texts)
    cleaned, report = documents.clean_documents(rows, words, 0.5)
    want = plain.cleaned(list(enumerate(texts, 1)), 0.5)
    assert {r["page"]: r["text"] for r in cleaned.collect()} == want[0]
    assert [r["removed_repeated_lines"] for r in report.collect()] == [want[1]] == [[first, second]]


def test_records_of_cleaned_pages(spark):
    rows, words = _paged(spark, ["\n".join(["Hillside Academy Bulletin", *_body(page, 18), "printed by hillside press"]) for page in "pqrs"])
    one, _ = _paged(spark, ["alone"])
    rows = rows.unionByName(one.selectExpr("'e' AS doc_id", "page_number", "text"))
    got = {r["doc_id"]: r for r in documents.clean_records(rows, words).collect()}
    assert got["d"]["cleanup_applied"] and got["d"]["removed_repeated_lines"] == ["printed by hillside press", "Hillside Academy Bulletin"]
    assert got["d"]["full_content"] == "\n\n".join("\n".join(_body(page, 18)) for page in "pqrs") and got["d"]["page_count"] == 4
    assert got["e"]["removed_repeated_lines"] == [] and got["e"]["full_content"] == "alone"


def test_words_at_the_bottom_by_their_lower_edge(spark):
    rows = [("d", 1, 100.0, "printed", 0.0, 86.0, 90.0), ("d", 1, 100.0, "here", 10.0, 86.0, 90.0), ("d", 1, 100.0, "high", 0.0, 50.0, 54.0)]
    words = spark.createDataFrame(rows, "doc_id string, page_index int, page_height double, text string, x0 double, top double, bottom double")
    assert [r["raw_text"] for r in documents.region_candidates(words).collect()] == ["printed here"]
    assert documents.region_candidates(words.drop("bottom")).count() == 0


def test_pages_of_words_as_single_words(spark):
    """Whole pages give the lines and candidates that their single words give, and shuffle nothing."""
    texts = ["a b  c\n\nd e\nf", None, "", *(f"top {k} words here\n" + "\n".join(_body("pqrst"[k], 9)) + "\nprinted here" for k in range(5))]
    rows = spark.createDataFrame([("d", n, t) for n, t in enumerate(texts, 1)], "doc_id string, page_number long, text string")
    flat, whole = catalog._words(rows), catalog._word_pages(rows)
    for f in (documents.group_words, documents.region_candidates):
        assert sorted(map(str, f(whole).collect())) == sorted(map(str, f(flat).collect()))
        assert "Exchange" not in f(whole)._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([("d", 1, [("low", 0.0, 9.0), ("b", 10.0, 2.0), ("a", 0.0, 0.0), (None, 0.0, 0.0), ("x", None, 0.0)])], "doc_id string, page_index int, words array<struct<text: string, x0: double, top: double>>")
    assert [(r["line_no"], r["top"], r["line"]) for r in documents.group_words(odd).orderBy("line_no").collect()] == [(0, 0.0, "a b"), (1, 9.0, "low")]
