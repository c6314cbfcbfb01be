from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import jaccard_join as jj
from sievework.llm import queries as Q
from sievework.llm.components import components
from sievework.llm.exact_dedup import CountingQuotientFilter, drop_exact_duplicates, exact_duplicates


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 5000, 900).astype(np.uint64) << np.uint64(29) for _ in range(4)]
    filters = [CountingQuotientFilter.load(CountingQuotientFilter.of(p).dump()) for p in parts]
    merged = CountingQuotientFilter.merge(filters)
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged.fingerprints() == values).all() and (merged.counts == counts).all()
    assert (merged.repeated() == values[counts > 1]).all()
    empty = CountingQuotientFilter.load(CountingQuotientFilter.of(np.zeros(0, np.uint64)).dump())
    assert len(empty.fingerprints()) == 0


@pytest.mark.parametrize("extra", [False, True])
def test_exact_edges(make_docs, edge_rows, extra):
    docs = make_docs(edge_rows, extra)
    got = {tuple(r) for r in exact_duplicates(docs).collect()}
    assert got == {(3, 2), (6, 5), (9, 8), (12, 11)}
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 4, 5, 7, 8, 10, 11, 13, 13, 14]


def test_exact_without_broadcast(make_docs, edge_rows):
    assert {tuple(r) for r in exact_duplicates(make_docs(edge_rows), broadcast_bytes=0).collect()} == {(3, 2), (6, 5), (9, 8), (12, 11)}


def test_exact_empty(make_docs):
    assert exact_duplicates(make_docs([])).count() == 0
    assert drop_exact_duplicates(make_docs([])).count() == 0


def _near_rows(seed: int = 3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 200, 900]))]
        for _ in range(rng.choice([1, 1, 2, 3, 25])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03, 0.06, 0.1]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(copy)))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(10_000 + k, " ".join(rng.choice(words) for _ in range(80)) + " " + passage) for k in range(60)]
    rng.shuffle(rows)
    return rows


def _pairs(docs, t, n, **more):
    """All pairs of documents, from those of representatives and the membership."""
    pairs, members = jj.jaccard_pairs(docs, t, n, **more)
    of: dict[int, list[int]] = {}
    for i, r in members.collect():
        of.setdefault(r, []).append(i)
    rows = pairs.collect()
    assert len({(r[0], r[1]) for r in rows}) == len(rows) and all(r[0] < r[1] for r in rows)
    out = {(min(a, b), max(a, b)): r[2] for r in rows for a in of[r[0]] for b in of[r[1]]}
    return out | {(a, b): 1.0 for own in of.values() for a in own for b in own if a < b}


def _links(want) -> set[tuple[int, int, int]]:
    degree = Counter(x for pair in want for x in pair)
    roots = brute.groups(want)
    return {(x, roots[x], n) for x, n in degree.items()}


def _rows(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("t", [0.5, 0.7, 0.9])
def test_jaccard_join_is_exact(make_docs, t):
    rows = _near_rows()
    want = brute.jaccard_pairs(rows, t, 3)
    got = _pairs(make_docs(rows), t, 3)
    assert got.keys() == want.keys() and len(want) > 300
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert _rows(jj.near_duplicates(make_docs(rows), t, 3)) == _links(want)


@pytest.mark.parametrize("t, more", [(0.5, {"broadcast_bytes": 0}), (0.8, {"region_grams": 300}), (0.5, {"region_grams": 1, "hot_cell": 5})])
def test_jaccard_join_in_other_ways(make_docs, monkeypatch, t, more):
    """By shuffles, with regions split again and again, with split cells and with guests in parts."""
    if "hot_cell" in more:
        monkeypatch.setattr(jj, "REGION_GUESTS", 3)
    rows = _near_rows(4)
    want = brute.jaccard_pairs(rows, t, 3)
    assert _rows(jj.near_duplicates(make_docs(rows), t, 3, **more)) == _links(want)
    assert _pairs(make_docs(rows), t, 3, **more).keys() == want.keys()


def test_hot_group_of_near_copies(make_docs):
    """A third of the rows is one page with another number in each, next to exact copies of it."""
    rng = random.Random(8)
    page = [f"p{k}" for k in range(30)]
    rows = [(k, " ".join([*page[:15], f"n{k % 90}", *page[15:]])) for k in range(120)]
    rows += [(1000 + k, " ".join(rng.choice(["a", "b", "c", "d", "e"]) + str(rng.randrange(300)) for _ in range(25))) for k in range(240)]
    want = brute.jaccard_pairs(rows, 0.5, 3)
    assert _rows(jj.near_duplicates(make_docs(rows), 0.5, 3, region_grams=400, hot_cell=20)) == _links(want)
    assert len(want) >= 120 * 119 / 2


def test_a_shared_passage_sends_no_text_about(make_docs, monkeypatch):
    """Short texts with a passage in common, too short for a link: none but the two near copies is routed to a region."""
    passage = " ".join(f"p{k}" for k in range(13))
    rows = [(k, " ".join(f"u{k}x{i}" for i in range(10)) + " " + passage) for k in range(300)]
    rows.append((900, rows[7][1] + " end"))
    sent, with_sets = [], jj._with_sets

    def recorded(texts, routes, *more):
        sent.append(routes.count())
        return with_sets(texts, routes, *more)

    monkeypatch.setattr(jj, "_with_sets", recorded)
    assert _rows(jj.near_duplicates(make_docs(rows), 0.5, 3)) == _links(brute.jaccard_pairs(rows, 0.5, 3)) == {(7, 7, 1), (900, 7, 1)}
    assert sum(sent) <= 4


def test_frequent_n_grams_send_no_text_about(make_docs, monkeypatch):
    """Unrelated texts of a small vocabulary: each n-gram is in some 20 of them, which is no reason to route them to each other."""
    rng = random.Random(21)
    rows = [(k, " ".join(f"v{rng.randrange(12)}" for _ in range(130))) for k in range(270)]
    rows += [(900 + k, rows[k][1].replace("v1 v2", "v1 x v2", 1) + " end") for k in range(5)]
    sent, with_sets = [], jj._with_sets

    def recorded(texts, routes, *more):
        sent.append(routes.count())
        return with_sets(texts, routes, *more)

    monkeypatch.setattr(jj, "_with_sets", recorded)
    want = brute.jaccard_pairs(rows, 0.5, 3)
    assert {(k, 900 + k) for k in range(5)} == set(want)
    for more in ({}, {"broadcast_bytes": 0}):
        sent.clear()
        assert _rows(jj.near_duplicates(make_docs(rows), 0.5, 3, **more)) == _links(want)
        assert sum(sent) <= 2 * len(rows)


def test_sketches_rule_out_no_near_set():
    rng = np.random.default_rng(11)
    near = kept = 0
    for _ in range(400):
        size = int(rng.integers(1, 700))
        base = rng.integers(0, 1 << 48, size).astype(np.uint64)
        pack = lambda s: (len(s), jj.zlib.compress(jj.sketch(s).tobytes(), 1))
        homes = [np.unique(np.where(rng.random(size) < rng.random(), base, rng.integers(0, 1 << 48, size).astype(np.uint64)))[: int(rng.integers(1, size + 1))] for _ in range(int(rng.choice([1, 3, 150])))]
        guest = np.unique(base)
        both = np.array([len(np.intersect1d(guest, h)) for h in homes])
        j = both / (np.array([len(h) for h in homes]) + len(guest) - both)
        got = jj.Homes([pack(h) for h in homes], 0.5).may_reach(*pack(guest))
        assert got or j.max() < 0.5
        near, kept = near + (j.max() >= 0.5), kept + got
    assert 40 < near <= kept < 400
    crowded = (np.arange(200, dtype=np.uint64) << np.uint64(20)) + np.uint64(5)  # all in one slot
    assert len(jj.sketch(crowded)) == 0 and jj.Homes([pack(crowded)], 0.5).may_reach(*pack(np.arange(3, dtype=np.uint64)))


def test_members_with_partners_stay():
    rng = np.random.default_rng(6)
    for t in (0.5, 0.8):
        sizes = rng.integers(1, 130, 200)
        caps = jj.largest_partners(sizes, (rng.random(200) * jj.window_lengths(sizes, t)).astype(np.int64), t)
        fits = jj.sizes_fit(sizes[:, None], sizes[None, :], t) & (sizes[None, :] <= caps[:, None]) & (sizes[:, None] <= caps[None, :])
        assert (jj.has_partner(sizes, caps, t) == fits.any(axis=1)).all() and 0 < fits.any(axis=1).sum() < 200


@pytest.mark.parametrize("extra", [False, True])
def test_jaccard_edges(make_docs, edge_rows, extra):
    docs = make_docs(edge_rows, extra)
    want = brute.jaccard_pairs(edge_rows, 0.7, 3)
    assert _pairs(docs, 0.7, 3).keys() == want.keys()
    assert _rows(jj.near_duplicates(docs, 0.7, 3)) == _links(want)
    left = jj.drop_near_duplicates(docs, 0.7, 3)
    gone = {x for x, root in brute.groups(want).items() if x != root}
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in edge_rows if i not in gone)


def test_rows_that_repeat_an_id(make_docs):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h"), (3, "a b c d e f g h")]
    assert _rows(jj.near_duplicates(make_docs(rows), 0.7, 3)) == {(1, 1, 2), (2, 1, 2), (3, 1, 2)}


def test_jaccard_empty(make_docs):
    assert jj.near_duplicates(make_docs([]), 0.7, 3).count() == 0
    assert jj.drop_near_duplicates(make_docs([(1, None), (2, "")]), 0.7, 3).count() == 2


def test_near_duplicates_leave_one_of_each_group(make_docs):
    rows = _near_rows(5)
    gone = {x for x, root in brute.groups(brute.jaccard_pairs(rows, 0.7, 3)).items() if x != root}
    left = {r["doc_id"] for r in jj.drop_near_duplicates(make_docs(rows), 0.7, 3).collect()}
    assert left == {i for i, _ in rows} - gone


@pytest.mark.parametrize("t", [0.7, Q.NEAR_THRESHOLD])
def test_whole_documents_table(spark, t):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute.jaccard_pairs([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], t, 3)
    assert _pairs(docs, t, 3).keys() == want.keys()
    assert _rows(jj.near_duplicates(docs, t, 3)) == _links(want)


def test_registered_threshold_finds_planted_copies(make_docs):
    """Copies with about 3 to 9 % of their words changed; unrelated texts with a common passage are none."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(5000)]
    rows, planted = [], set()
    for k in range(80):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 400]))]
        copy = list(base)
        for at in rng.sample(range(len(copy)), round(len(copy) * (0.03 + 0.06 * k / 79))):
            copy[at] = rng.choice(words)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        planted.add((2 * k, 2 * k + 1))
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(80)) + " " + passage) for k in range(20)]
    got = set(_pairs(make_docs(rows), Q.NEAR_THRESHOLD, Q.NEAR_N))
    assert got <= planted and len(got) >= 0.98 * len(planted)
    left = {r["doc_id"] for r in jj.drop_near_duplicates(make_docs(rows), Q.NEAR_THRESHOLD, Q.NEAR_N).collect()}
    assert left == {i for i, _ in rows} - {b for _, b in got}


def test_light_edits_in_the_documents_table(spark):
    """Pairs of sf0.1 with J from .698 to .7, the same text with some 6 % of its words changed."""
    pairs = {(7264, 9351), (7225, 9651), (6627, 8984)}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin([i for p in pairs for i in p]))
    assert set(_pairs(docs, Q.NEAR_THRESHOLD, Q.NEAR_N)) == pairs


def test_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 400)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(300)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in brute.groups(edges).items() if x != r}
