from __future__ import annotations

import brute
import corpus_pipeline as P
import pytest

SF = "/root/testdata/sf0.01"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_by_brute_force(spark):
    """Each stage judged on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, exact, near, mix, tokens = (f for _, f in P.STAGES)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = toxic(spark, docs, SF)
    left = {r["doc_id"] for r in kept.collect()}
    bad = [i for i, y in labels.items() if y == 1]
    good = [i for i, y in labels.items() if y == 0]
    assert sum(i not in left for i in bad) / len(bad) > 0.8 and sum(i in left for i in good) / len(good) > 0.97
    once = exact(spark, kept, SF)
    first: dict[str, int] = {}
    for r in kept.collect():
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in once.collect()} == set(first.values())
    one = near(spark, once, SF)
    gone = {x for x, root in brute.groups(brute.jaccard_pairs([(r[0], r[1]) for r in once.collect()], P.NEAR_THRESHOLD, P.NEAR_N)).items() if x != root}
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in once.collect()} - gone
    mixed = mix(spark, one, SF)
    assert mixed.columns == one.columns == docs.columns
    assert tokens(spark, mixed, SF).count() == mixed.count()


def test_run_is_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert _rows(P.run(spark, SF)) == _rows(docs)


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, make_docs, edge_rows, k):
    name, stage = P.STAGES[k]
    docs = make_docs(edge_rows, extra=True)
    out = stage(spark, docs, SF)
    assert out.count() > 0
    if k < 4:
        assert out.columns == docs.columns
        assert {r["row"] for r in out.select("row").collect()} == {"clash"}
    assert stage(spark, make_docs([]), SF).count() == 0
