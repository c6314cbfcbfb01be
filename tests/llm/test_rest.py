from __future__ import annotations

import brute
import numpy as np
import pytest
from compare import difference

from sievework.llm import ann, chat_format, mixing
from sievework.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    assert difference(Q.queries()[name](spark, SF), SF, Q.oracle_sql()[name]) is None


def _recall(spark, sf: str, every: int = 1, **more) -> float:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    local = vectors.select("vec_id", "embedding").toPandas()
    ids, x = local["vec_id"].to_numpy(), np.stack(local["embedding"].to_numpy())
    want = {i: v for i, v in brute.nearest(ids, x, 10).items() if i % every == 0}
    got: dict[int, set] = {}
    for r in Q.op6_nearest_neighbours(spark, sf).collect() if every == 50 else ann.nearest(vectors, 10, **more).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    assert got.keys() <= want.keys()
    return float(np.mean([len(got.get(i, set()) & set(v)) / len(v) for i, v in want.items()]))


@pytest.mark.parametrize("every", [1, 50])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_over_all_vectors(spark, sf, every):
    assert _recall(spark, sf, every) >= 0.9


def test_large_buckets_are_split(spark):
    """Parts of a bucket find what the whole would."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, split = (sorted(tuple(r) for r in ann.nearest(vectors, 10, bucket_bytes=size).collect()) for size in (ann.BUCKET_BYTES, 20 * 4 * 64))
    assert one == split


def test_infinite_elements_are_left_out(spark):
    rng = np.random.default_rng(4)
    rows = [(i, r.tolist()) for i, r in enumerate(rng.standard_normal((60, 8)))]
    schema = "vec_id long, embedding array<float>"
    want = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, schema), 5).collect())
    odd = [(100, [float("inf"), *[0.0] * 7]), (101, [0.0, float("-inf"), *[0.0] * 6])]
    assert sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows + odd, schema), 5).collect()) == want


def _uneven(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and which of them are the minority: 10 % beside one tight source, or 1 % of five times the norm."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((6000, 64))
    few = rng.random(6000) < (0.1 if kind == "hot" else 0.01)
    x = np.where(few[:, None], x, 0.05 * x + 1) if kind == "hot" else np.where(few[:, None], 5 * x, x)
    return x.astype(np.float32), few


@pytest.mark.parametrize("kind", ["hot", "norms"])
def test_recall_of_the_minority(spark, kind):
    x, few = _uneven(kind)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict[int, set] = {}
    for r in ann.nearest(v, 10).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    assert all(len(got[i]) == 10 for i in range(len(x)))
    y = x.astype(np.float64)
    for rows in (np.flatnonzero(few), np.flatnonzero(~few)[:200]):
        want = {i: set(np.argsort(np.where(np.arange(len(y)) == i, np.inf, ((y - y[i]) ** 2).sum(1)))[:10].tolist()) for i in rows.tolist()}
        recall = np.mean([len(got[i] & w) / 10 for i, w in want.items()])
        print(kind, recall)
        assert recall >= 0.9


def test_nearest_edges(spark):
    rows = [(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], 3), (3, [1.0, 0.0], 3), (None, [1.0, 1.0], 4), (4, None, 5), (5, [], 6), (6, [1.0], 7), (7, [float("nan"), 0.0], 8), (8, [None, 1.0], 9)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").selectExpr("*", "1 AS bucket", "2 AS vector")
    got = sorted(tuple(r) for r in ann.nearest(v, 2).collect())
    assert [r for r in got if r[0] == 2 and r[3] == 1] == [(2, 3, 0.0, 1)]
    assert {r[0] for r in got} <= {1, 2, 3}
    assert ann.nearest(v.where("vec_id IS NULL"), 2).count() == 0
    assert ann.nearest(v.where("vec_id = 1"), 2).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(30)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: [] for r in ann.nearest(same, 3).collect()}
    assert len(got) == 30


def test_probing_order():
    sets = ann.perturbations(4, 20)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets)
    assert all(7 - k not in s for s in sets for k in s)


def test_water_fill():
    assert mixing.water_fill(10, [("a", 1, 2), ("b", 1, 100), ("c", 2, 100)]) == pytest.approx({"a": 2, "b": 8 / 3, "c": 16 / 3})
    assert mixing.water_fill(1000, [("a", 1, 2), ("b", 0, 9)]) == {"a": 2, "b": 0}
    assert sum(mixing.water_fill(50, [(k, k, 7 * k) for k in range(1, 6)]).values()) == pytest.approx(50)


def test_siblings_come_before_ancestors():
    mix = mixing.Mix(domains={"s1": "web", "s2": "web", "s3": "books"}, budget=100, epochs=1)
    got = mixing.leaf_budgets({("web", "en", "s1"): 10, ("web", "en", "s2"): 500, ("books", "en", "s3"): 500}, mix)
    assert got == {("web", "en", "s1"): 10, ("web", "en", "s2"): 40, ("books", "en", "s3"): 50}


def test_budgets_by_halving():
    rng = np.random.default_rng(6)
    for _ in range(30):
        supply = {(f"d{a}", f"l{b}", f"s{c}"): int(rng.integers(0, 5000)) for a in range(3) for b in range(2) for c in range(4)}
        draw = lambda names: {n: float(rng.choice([0, 0.5, 1, 3])) for n in names}
        mix = mixing.Mix({}, draw(["d0", "d1", "d2"]), draw(["l0", "l1"]), draw(["s0", "s1", "s2", "s3"]), share=float(rng.random() * 2), epochs=2)
        got, want = mixing.leaf_budgets(supply, mix), brute.budgets(supply, mix)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def _mixed(docs, mix):
    return [(r["row"]["doc_id"], r["epoch"], r["domain"], r["lang"], r["source"]) for r in mixing.mixed(docs, mix).collect()]


def _brute_mix(rows, mix, spark):
    """Leaf by leaf: whole epochs, then the prefix in the seeded order."""
    from pyspark.sql import functions as F

    supply: dict[tuple, int] = {}
    leaves: dict[tuple, list] = {}
    for i, text, lang, source in rows:
        if i is None:
            continue
        leaf = (mix.domains.get(source or "", mix.other), lang or "", source or "")
        n = len((text or "").split())
        supply[leaf] = supply.get(leaf, 0) + n
        leaves.setdefault(leaf, []).append((i, n))
    out = []
    for leaf, budget in mixing.leaf_budgets(supply, mix).items():
        total = supply[leaf]
        full = min(mix.epochs, budget // total) if total else 1
        out += [(i, e, *leaf) for e in range(full) for i, _ in leaves[leaf]]
        if full < mix.epochs and total:
            keys = {r[0]: r[1] & (2**64 - 1) for r in spark.createDataFrame([(i,) for i, _ in leaves[leaf]], "i long").select("i", F.xxhash64(F.lit(mix.seed), F.lit(full), "i")).collect()}
            left = budget - full * total
            for i, n in sorted(leaves[leaf], key=lambda r: ((keys[r[0]] >> 52), (keys[r[0]] & (2**64 - 1)) >> 1, r[0], r[1])):
                if n > left:
                    break
                left -= n
                out.append((i, full, *leaf))
    return out


def test_mix_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    want = sorted(_brute_mix(rows, Q.MIX, spark))
    assert sorted(_mixed(docs, Q.MIX)) == want
    by_shuffle = mixing.mixed(docs, Q.MIX, broadcast_bytes=0)
    assert sorted((r["row"]["doc_id"], r["epoch"], r["domain"], r["lang"], r["source"]) for r in by_shuffle.collect()) == want


def test_mix_edges(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows, extra=True)
    rows = [(i, t, "en", "src1") for i, t in edge_rows]
    for budget in (None, 0, 7, 10**9):
        mix = mixing.Mix(budget=budget)
        got = _mixed(docs, mix)
        # Rows that repeat an id are used alike, as long as the first of them fits.
        assert sorted(set(got)) == sorted(set(_brute_mix(rows, mix, spark)))
        assert {r[0] for r in got} <= {i for i, _ in edge_rows if i is not None}
    everything = _mixed(docs, mixing.Mix(budget=10**9))
    assert len(everything) == 2 * (len(edge_rows) - 1)
    assert mixing.mixed(make_docs([]), Q.MIX).count() == 0
    nulls = make_docs([(1, "a b"), (2, "c")]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source")
    assert sorted(_mixed(nulls, mixing.Mix())) == [(1, 0, "other", "", ""), (2, 0, "other", "", "")]


TURNS = "conv_id long, turn int, role string, text string"


def _chats(spark, rows, template=chat_format.CHATML):
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'k' AS error", "1 AS seg", "2 AS t", "3 AS state")
    return sorted((tuple(r) for r in chat_format.format_chats(df, template).collect()), key=str)


def test_chat_machine(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", None)]
    got = sorted(_chats(spark, rows), key=lambda r: r[1])
    assert [r[2] for r in got] == ["<|im_start|>user\n", "hi", "<|im_end|>\n", "<|im_start|>assistant\n", "", "<|im_end|>\n"]
    assert [r[3] for r in got] == [False, False, False, False, True, True]


@pytest.mark.parametrize("turns, error", [
    ([(1, "user"), (1, "assistant")], "repeated turn"), ([(None, "user")], "repeated turn"), ([(1, "user"), (2, "tool")], "unknown role"), ([(1, None)], "unknown role"),
    ([(1, "assistant")], "turn order"), ([(1, "user"), (2, "user")], "turn order"), ([(1, "system")], "final role"),
])
def test_chat_rejects(spark, turns, error):
    assert _chats(spark, [(5, t, r, "x") for t, r in turns]) == [(5, None, None, None, error)]


def test_chat_edges(spark):
    assert _chats(spark, []) == []
    assert _chats(spark, [(None, 1, "user", "x")]) == []
    own = chat_format.Template(chat_format.CHATML.roles, "<s>", "</s>", chat_format.CHATML.next_roles, ("user",))
    got = sorted(_chats(spark, [(1, 1, "user", "y" * 100_000)], own), key=lambda r: r[1])
    assert [r[1] for r in got] == [0, 1, 2, 3, 4] and got[0][2] == "<s>" and got[4][2] == "</s>"
