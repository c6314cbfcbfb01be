"""Documents of pages: lines, repeated headers and footers, assembly, classification.

Pages are rows of (doc_id, page_number, text, tables), words rows of (doc_id,
page_index, page_height, text, x0, top), or of (doc_id, page_index,
page_height, words) for a whole page, which needs no shuffle. A document's
pages meet only in grouped operators keyed by doc_id, so any number of
documents run in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import rules
from sievework.functions import text as tx
from sievework.functions.urls import let


def page_lines(pages: DataFrame, page_col: str = "page_number") -> DataFrame:
    """(doc_id, page, line_no from 0, line)."""
    return pages.select("doc_id", F.col(page_col).alias("page"), F.posexplode(tx.lines(F.coalesce(F.col("text"), F.lit("")))).alias("line_no", "line"))


def table_text(table: Column) -> Column:
    """Rows of trimmed cells joined by bars; empty cells stay, rows of empty cells go."""
    rows = F.transform(table, lambda row: F.transform(row, lambda c: tx.strip(F.coalesce(c, F.lit("")))))
    full = F.filter(rows, lambda row: F.exists(row, lambda c: c != ""))
    return F.array_join(F.transform(full, lambda row: F.array_join(row, " | ")), "\n")


def page_content(text: Column, tables: Column) -> Column:
    """Text, then a numbered block for each table that isn't empty; numbers count empty ones too."""
    blocks = F.transform(F.coalesce(tables, F.expr("cast(array() as array<array<array<string>>>)")), lambda t, i: F.when(table_text(t) != "", F.concat(F.lit("[TABLE "), (i + 1).cast("string"), F.lit("]\n"), table_text(t))).otherwise(""))
    body = F.concat(F.array(tx.strip(F.coalesce(text, F.lit("")))), blocks)
    return F.array_join(F.filter(body, lambda b: b != ""), "\n\n")


def line_starts(tops: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the words, by top, that open a line: each lies more than the tolerance below the one before."""
    starts, at = [], 0
    while at < len(tops):
        starts.append(at)
        at = int(np.searchsorted(tops, tops[at] + tolerance, "right"))
    return np.array(starts, np.int64)


def _lines_of(rows: pa.Table, keys: list[str], tolerance: float) -> pa.RecordBatch:
    """Lines of whole pages; rows come sorted by the keys, then by top."""
    n = rows.num_rows
    page = np.zeros(n, np.int64)
    for k in keys:
        codes = rows.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        page[1:] |= codes[1:] != codes[:-1]
    page = np.cumsum(page)
    tops = rows.column("top").to_numpy()
    cuts = np.append(np.flatnonzero(np.diff(page, prepend=-1)), n)
    opens = [a + line_starts(tops[a:b], tolerance) for a, b in zip(cuts[:-1], cuts[1:])]
    starts = np.concatenate(opens)
    number = np.concatenate([np.arange(len(o), dtype=np.int32) for o in opens])
    line = np.zeros(n, np.int64)
    line[starts] = 1
    line = np.cumsum(line) - 1
    order = pc.sort_indices(pa.table({"line": line, "x0": rows.column("x0"), "top": rows.column("top"), "text": rows.column("text")}), [(c, "ascending") for c in ("line", "x0", "top", "text")])
    text = rows.column("text").combine_chunks().take(order)
    words = pa.ListArray.from_arrays(pa.array(np.append(starts, n).astype(np.int32)), text)
    first = rows.select(keys).take(pa.array(starts)).combine_chunks()
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in first.columns), pa.array(number), pa.array(tops[starts]), pc.binary_join(words, " ")], [*keys, "line_no", "top", "line"])


def _group(keys: list[str], tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = [batch.column(k).slice(i, 1).to_pylist()[0] for k in keys for i in (0, batch.num_rows - 1)]
            if len(held) > 1 and ends[::2] == ends[1::2]:
                continue  # one page, which may have begun before and may go on
            rows = pa.Table.from_batches(held)
            same = np.ones(batch.num_rows, bool)
            for k in keys:
                codes = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                same &= codes == codes[-1]
            whole = rows.num_rows - int(same.sum())
            if whole:
                yield _lines_of(rows.slice(0, whole), keys, tolerance)
            held = rows.slice(whole).to_batches()
        if held:
            yield _lines_of(pa.Table.from_batches(held), keys, tolerance)

    return run


def _sliced(words: pa.ListArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of pages with some ``most`` words together, or a single page."""
    ends = words.offsets.to_numpy()
    at = 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, len(words))
        at = to


def _group_pages(keys: list[str], tolerance: float, most: int = 1 << 17):
    """As ``_group``, for rows of a whole page each; words are held of few pages at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("words")
            for at, to in _sliced(column, most):
                pages = column.slice(at, to - at)
                parts = pages.flatten()
                rows = pa.table({"page": pc.list_parent_indices(pages), "top": parts.field("top"), "x0": parts.field("x0"), "text": parts.field("text")})
                rows = rows.drop_null()
                if not rows.num_rows:
                    continue
                tops, page = rows.column("top").to_numpy(), rows.column("page").to_numpy()
                if np.any((np.diff(tops) < 0) & (np.diff(page) == 0)):
                    rows = rows.sort_by([("page", "ascending"), ("top", "ascending"), ("x0", "ascending")])
                lines = _lines_of(rows, ["page"], tolerance)
                own = batch.slice(at, to - at).select(keys).take(lines.column("page"))
                yield pa.RecordBatch.from_arrays([*own.columns, *lines.columns[1:]], [*keys, *lines.schema.names[1:]])

    return run


def group_words(words: DataFrame, tolerance: float = 5.0, keys: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """(doc_id, page_index, line_no, top, line): words into lines.

    A line opens with the first word, by top and x0, that lies more than the
    tolerance below the line's first top, which only a pass in order can tell:
    one shuffle by page and one sort bring the words in that order, and whole
    batches of pages are cut into lines at once. Words of a line go by x0.
    Words without a text or a place are left out. Where a row is a whole page,
    with an array ``words`` of structs, nothing is shuffled.
    """
    own = list(keys)
    kinds = dict(words.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in own), "line_no int, top double, line string"])
    if "words" in words.columns:
        shaped = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["x0"].cast("double").alias("x0"), w["top"].cast("double").alias("top")))
        lines = words.select(*own, F.coalesce(shaped, F.expr("cast(array() as array<struct<text: string, x0: double, top: double>>)")).alias("words")).mapInArrow(_group_pages(own, tolerance), schema)
    else:
        rows = words.select(*own, F.col("top").cast("double").alias("top"), F.col("x0").cast("double").alias("x0"), "text").dropna(subset=["top", "x0", "text"])
        lines = rows.repartition(*own).sortWithinPartitions(*own, "top", "x0").mapInArrow(_group(own, tolerance), schema)
    return lines.withColumn("line", tx.squeeze(F.col("line")))


def _zoned(words: DataFrame, top_part: float, bottom_part: float) -> DataFrame:
    """The words of each zone, or, where rows are pages, a row for each zone of a page with its words."""
    whole = "words" in words.columns
    names = words.schema["words"].dataType.elementType.names if whole else words.columns
    high = lambda w: w["top"] <= top_part * F.col("page_height")
    low = lambda w: w["bottom" if "bottom" in names else "top"] >= (1 - bottom_part) * F.col("page_height")
    rows = words.where("page_height > 0")
    if not whole:
        own = {k: F.col(k) for k in names}
        return rows.withColumn("zone", F.explode(F.array_compact(F.array(F.when(high(own), "header"), F.when(low(own), "footer")))))
    zones = F.array(*(F.struct(F.lit(zone).alias("zone"), F.filter("words", test).alias("words")) for zone, test in (("header", high), ("footer", low))))
    return rows.select("doc_id", "page_index", F.inline(zones))


def region_candidates(words: DataFrame, top_part: float = 0.15, bottom_part: float = 0.12, tolerance: float = 5.0) -> DataFrame:
    """(doc_id, page_index, zone, line_no, raw_text, tokens): lines at the top and bottom of pages that may be banners.

    A word stands at the bottom by its lower edge, where there is a column
    ``bottom``, else by its top.
    """
    lines = group_words(_zoned(words, top_part, bottom_part), tolerance, ("doc_id", "page_index", "zone"))
    # Generated, so that the filter on the tokens doesn't work them out again.
    rows = lines.where(~tx.never_remove(F.col("line"))).select("doc_id", "page_index", "zone", "line_no", F.col("line").alias("raw_text"), F.explode(F.array(tx.token_set(F.col("line")))).alias("tokens"))
    return rows.where((F.size("tokens") >= 2) & ~tx.looks_like_syllabus(F.col("tokens")))


CLUSTERS = "doc_id string, zone string, cluster int, pages array<int>, core array<string>, variants map<string,int>"


def cluster_document(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy clusters of one document's candidates, in page, zone and line order.

    A candidate joins the cluster of its zone whose core it is most like, the
    earliest of equals, and cuts the core down to what they share. Clusters
    are found by the tokens of their cores.
    """
    rows = rows.assign(z=rows["zone"] != "header").sort_values(["page_index", "z", "line_no"], kind="stable")
    out: list[dict] = []
    by_token: dict[tuple[str, str], set[int]] = defaultdict(set)
    for page, zone, raw, toks in zip(rows["page_index"], rows["zone"], rows["raw_text"], rows["tokens"]):
        own = set(toks)
        shared: dict[int, int] = defaultdict(int)
        for t in own:
            for c in by_token[zone, t]:
                shared[c] += 1
        best, top = None, 0.0
        for c in sorted(shared):
            n, size = shared[c], len(out[c]["core"])
            jac, over = n / (len(own) + size - n), n / min(len(own), size)
            if (jac >= 0.6 or over >= 0.8) and max(jac, over) > top:
                best, top = c, max(jac, over)
        if best is None:
            best = len(out)
            out.append({"zone": zone, "pages": set(), "core": own, "variants": defaultdict(int)})
            for t in own:
                by_token[zone, t].add(best)
        else:
            for t in out[best]["core"] - own:
                by_token[zone, t].discard(best)
            out[best]["core"] &= own
        out[best]["pages"].add(int(page))
        out[best]["variants"][raw] += 1
    doc = rows["doc_id"].iloc[0]
    return pd.DataFrame(
        [(doc, c["zone"], k, sorted(c["pages"]), sorted(c["core"]), dict(c["variants"])) for k, c in enumerate(out)],
        columns=["doc_id", "zone", "cluster", "pages", "core", "variants"],
    )


def cluster_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("doc_id").applyInPandas(cluster_document, CLUSTERS)


def least_pages(page_count: Column, threshold: float) -> Column:
    """Pages on which a banner must stand; a threshold above 1 is a percentage."""
    t = min(max(threshold / 100 if threshold > 1 else threshold, 0.0), 1.0)
    return F.greatest(F.lit(2), F.ceil(F.lit(t) * page_count).cast("int"))


def representative(variants: Column) -> Column:
    """Of the variants at least half as common as the commonest: fewest digits, punctuation, letters, then by text."""
    entries = F.map_entries(variants)
    most = F.array_max(F.map_values(variants))
    pool = F.filter(entries, lambda e: e["value"] >= F.greatest(F.lit(1), F.ceil(most * 0.5).cast("int")))
    score = F.transform(pool, lambda e: F.struct(F.regexp_count(e["key"], F.lit(r"\p{Nd}")).alias("d"), F.regexp_count(e["key"], F.lit(r"[^\p{L}\p{N}\s]")).alias("p"), F.length(e["key"]).alias("n"), e["key"].alias("raw")))
    return F.array_min(score)["raw"]


def removal_patterns(clusters: DataFrame, page_counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, zone, label, tokens, representative, n_pages, ord) of the clusters that repeat on enough pages.

    ``ord`` is the order in which the clusters were opened, and in which a
    line tries them. Cores of a single token are no patterns.
    """
    repeated = clusters.where((F.size("pages") >= 2) & (F.size("core") >= 2))  # before the shuffle, which the many others need not go through
    joined = repeated.join(page_counts, "doc_id").where((F.col("page_count") > 1) & (F.size("pages") >= least_pages(F.col("page_count"), threshold)))
    return joined.select("doc_id", "zone", F.array_join("core", " ").alias("label"), F.col("core").alias("tokens"), representative(F.col("variants")).alias("representative"), F.size("pages").alias("n_pages"), F.col("cluster").alias("ord"))


def _window(text: Column, first: int = 10, last: int = 5) -> Column:
    """Array of (line_no, line, zone) as ``window_lines`` has them."""
    numbered = F.transform(tx.lines(F.coalesce(text, F.lit(""))), lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    eligible = F.filter(numbered, lambda x: (tx.strip(x["line"]) != "") & ~tx.is_table_line(x["line"]))
    named = lambda part, zone: F.transform(part, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.lit(zone).alias("zone")))
    return let(eligible, lambda e: F.concat(named(F.slice(e, 1, first), "header"), named(F.slice(e, F.greatest(F.lit(first), F.size(e) - last) + 1, last), "footer")))


def window_lines(pages: DataFrame, first: int = 10, last: int = 5) -> DataFrame:
    """(doc_id, page, line_no, line, zone) of pages(doc_id, page_number, text): header for a page's first lines, else footer for its last, of those neither blank nor tabular."""
    return pages.select("doc_id", F.col("page_number").alias("page"), F.inline(_window(F.col("text"), first, last)))


def _label(line: Column, zone: Column, patterns: Column) -> Column:
    """Label of the first of a document's patterns that takes the stripped line away, or null."""
    first = lambda own: F.get(F.filter(patterns, lambda p: (p["zone"] == zone) & tx.similar(own, p["tokens"])), F.lit(0))["label"]
    return F.when(~tx.never_remove(line), let(tx.token_set(line), lambda own: F.when(F.size(own) >= 2, first(own))))


def marked_pages(pages: DataFrame, patterns: DataFrame, every: bool = True) -> DataFrame:
    """(doc_id, page, text, removed): each page, or those of documents with patterns, with the (line_no, label) of the lines in a window that a pattern of their zone takes away; the first pattern's label.

    A document's patterns come to its pages as one row, so lines and tokens
    are never shuffled.
    """
    by_doc = patterns.groupBy(F.col("doc_id").cast(pages.schema["doc_id"].dataType).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "zone", "label", "tokens"))).alias("patterns"))
    rows = pages.select("doc_id", F.col("page_number").alias("page"), "text").join(by_doc, "doc_id", "left" if every else "inner")
    labelled = F.transform(_window(F.col("text")), lambda x: F.struct(x["line_no"].alias("line_no"), _label(tx.strip(x["line"]), x["zone"], F.col("patterns")).alias("label")))
    removed = F.when(F.col("patterns").isNotNull(), F.filter(labelled, lambda x: x["label"].isNotNull()))
    # Generated, so that the uses of the lines don't work them out again.
    return rows.select("doc_id", "page", "text", F.explode(F.array(removed)).alias("removed"))


def cleaned_pages(marked: DataFrame) -> DataFrame:
    """(doc_id, page, text) of every page without the removed lines, stripped."""
    lines, gone = tx.lines(F.coalesce("text", F.lit(""))), F.transform("removed", lambda x: x["line_no"])
    left = F.when(F.size("removed") > 0, let(gone, lambda g: F.filter(lines, lambda line, i: ~F.array_contains(g, i)))).otherwise(lines)
    return marked.select("doc_id", "page", tx.strip(F.array_join(left, "\n")).alias("text"))


def removed_report(marked: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, removed_repeated_lines): representatives of the patterns that removed a line, most pages first, each once.

    Pages are counted by label, which a header and a footer may share.
    """
    labels = marked.select("doc_id", "page", F.explode(F.array_distinct(F.transform("removed", lambda x: x["label"]))).alias("label"))
    pages = labels.groupBy("doc_id", "label").agg(F.count_distinct("page").alias("n"))
    rows = patterns.join(pages, ["doc_id", "label"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "zone", "label", "representative"))).alias("r"))
    return rows.select("doc_id", F.array_distinct(F.transform("r", lambda x: x["representative"])).alias("removed_repeated_lines"))


def assemble(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One record for each document of pages(doc_id, page_number, content) and titles(doc_id, stem, meta_title).

    Full content is the pages joined by blank lines and stripped, its length
    the sum of the pages'; the title is that of the metadata, else the file's
    stem, and where it equals the stem the first non-empty line's first 200
    characters.
    """
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page_number"), "content"))).alias("pages"))
    whole = F.array_join(F.transform("pages", lambda p: p["content"]), "\n\n")
    docs = docs.select("doc_id", F.size("pages").alias("page_count"), tx.strip(whole).alias("full_content"), F.aggregate("pages", F.lit(0), lambda a, p: a + F.length(p["content"])).alias("content_length"), "pages")
    named = titles if titles is not None else docs.select("doc_id", F.col("doc_id").cast("string").alias("stem"), F.lit(None).cast("string").alias("meta_title"))
    docs = docs.join(named, "doc_id", "left")
    given = F.coalesce(F.nullif(tx.strip(F.col("meta_title")), F.lit("")), F.col("stem"))
    first = F.get(F.filter(F.transform(tx.lines(F.col("full_content")), tx.strip), lambda x: x != ""), F.lit(0))
    title = F.when(given == F.col("stem"), F.coalesce(F.substring(first, 1, 200), given)).otherwise(given)
    docs = docs.withColumn("title", title)
    extracted = F.col("content_length") > 0
    sample = rules.classification_sample(F.col("title"), F.transform("pages", lambda p: p["content"]))
    return docs.select(
        "doc_id", "title", F.concat(F.col("stem"), F.lit(".pdf")).alias("source_pdf"), "page_count", "content_length", "pages", "full_content",
        rules.document_type(sample, F.col("content_length")).alias("document_type"),
        extracted.alias("text_extracted"), (~extracted).alias("needs_ocr"), F.when(~extracted, "pending").alias("ocr_status"),
    )


def clean_documents(pages: DataFrame, words: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(cleaned pages, removed report) of pages(doc_id, page_number, text): the whole clean-up."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    found = cluster_candidates(region_candidates(words))
    patterns = removal_patterns(found, counts.withColumn("doc_id", F.col("doc_id").cast("string")), threshold)
    return cleaned_pages(marked_pages(pages, patterns)), removed_report(marked_pages(pages, patterns, False), patterns)


def clean_records(pages: DataFrame, words: DataFrame, titles: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Records as ``assemble`` makes them, of cleaned pages, with ``cleanup_applied`` and ``removed_repeated_lines``."""
    cleaned, report = clean_documents(pages, words, threshold)
    records = assemble(cleaned.select("doc_id", F.col("page").alias("page_number"), F.col("text").alias("content")), titles)
    none = F.expr("cast(array() as array<string>)")
    return records.join(report, "doc_id", "left").withColumn("cleanup_applied", F.lit(True)).withColumn("removed_repeated_lines", F.coalesce("removed_repeated_lines", none))


def iso_time(when: Column) -> Column:
    """A timestamp as UTC in ISO 8601, to the second."""
    utc = F.to_utc_timestamp(when, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def parse_summary(records: DataFrame) -> DataFrame:
    """One row: processed, successful and failed; records carry ``error``."""
    return records.agg(F.count("*").alias("pdfs_processed"), F.count_if(F.col("error").isNull()).alias("pdfs_successful"), F.count_if(F.col("error").isNotNull()).alias("pdfs_failed"))
