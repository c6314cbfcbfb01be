"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to floor((a_i . x + b_i) / w) for M Gaussian a_i. A
query visits its own bucket and then perturbed ones in the order of their
estimated success: perturbation sets are ranked once by the expected squared
distances to the M boundaries on either side, and mapped to each query's own
boundaries by their rank. Every visited bucket is searched by exact distance;
the tables' best are merged.

The number of hashes and the width are fitted on a bounded sample: of those
by which a neighbour at the distance to be expected among so many vectors is
found often enough, the ones that visit fewest vectors. So buckets stay small
as the table grows, and every vector is indexed by them.

A width that fits most vectors can be too small for the rest. The distance of
a query's k-th candidate bounds that of its k-th neighbour from above, and
gives the chance that a vector so far away lies in a visited bucket. Queries
of a lower chance than wanted, or with too few candidates, are searched again
exactly: in blocks they meet all vectors where those are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams as G
from .common import BROADCAST_BYTES, cut, frugal, partitions, small

ROWS = 1024
#: Vectors of the sample that width and hashes are fitted on, first in hash order of the id.
SAMPLE, TRIED = 4096, 256
#: Bytes of one bucket's vectors, and of its queries, that one search takes.
BUCKET_BYTES = 16 << 20


@dataclass(frozen=True)
class Hashing:
    """``wanted`` is the chance that ``fitted`` grants a k-th neighbour, ``sure`` that below which a query is searched exactly; width is in the vectors' units."""

    tables: int = 3
    hashes: int = 4
    width: float = 1.0
    probes: int = 14
    seed: int = 5
    wanted: float = 0.93
    sure: float = 0.9


def perturbations(m: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of boundary ranks, 0 the nearest of 2m, best expected score first; the empty set leads."""
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    j = np.arange(m + 1, 2 * m + 1)
    high = 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([low, high])
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, held = heapq.heappop(heap)
        if all(2 * m - 1 - k not in held for k in held):
            out.append(held)
        last = held[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*held[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*held, last + 1)))
    return out


def bucket_ids(cells: np.ndarray, table: int) -> np.ndarray:
    """64-bit name of each row of cell numbers in a table."""
    h = np.full(len(cells), table + 1, np.uint64)
    for k in range(cells.shape[1]):
        h = G.mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, k].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def placed(x: np.ndarray, table: int, dim: int, conf: Hashing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, places inside them (0 to 1), and boundaries by nearness."""
    rng = np.random.Generator(np.random.PCG64([conf.seed, table]))
    a, b = rng.standard_normal((dim, conf.hashes)), rng.random(conf.hashes)
    place = x @ a / conf.width + b
    cell = np.floor(place).astype(np.int64)
    rest = place - cell
    return cell, rest, np.argsort(np.concatenate([rest, 1 - rest], axis=1), axis=1, kind="stable")


def probed(x: np.ndarray, table: int, dim: int, conf: Hashing) -> np.ndarray:
    """Bucket names, a column a probe, the own bucket first."""
    cell, _, near = placed(x, table, dim, conf)
    out = []
    rows = np.arange(len(x))
    for held in perturbations(conf.hashes, conf.probes):
        moved = cell.copy()
        for k in held:
            c = near[:, k]
            moved[rows, c % conf.hashes] += np.where(c < conf.hashes, -1, 1)
        out.append(bucket_ids(moved, table))
    return np.column_stack(out)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, to 1e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(z) / 2**0.5)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z / 2) / 2
    return np.where(z < 0, tail, 1 - tail)


def chances(x: np.ndarray, far: np.ndarray, dim: int, conf: Hashing) -> np.ndarray:
    """The chance of each query x to visit, in some table, the bucket of a vector at distance ``far``."""
    sigma = np.maximum(far / conf.width, 1e-9)[:, None]
    missed, rows = np.ones(len(x)), np.arange(len(x))
    for t in range(conf.tables):
        _, rest, near = placed(x, t, dim, conf)
        edge = [normal_cdf((k - rest) / sigma) for k in (-1, 0, 1, 2)]
        stay = edge[2] - edge[1]
        moves = np.concatenate([edge[1] - edge[0], edge[3] - edge[2]], axis=1)
        hit = np.zeros(len(x))
        for held in perturbations(conf.hashes, conf.probes):
            p = stay.copy()
            for k in held:
                p[rows, near[:, k] % conf.hashes] = moves[rows, near[:, k]]
            hit += p.prod(axis=1)
        missed *= 1 - np.minimum(hit, 1)
    return 1 - missed


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(column), dim)


def expected_distances(x: np.ndarray, rows: np.ndarray, n: int, k: int) -> np.ndarray:
    """Distances of the k-th neighbours among n vectors that the sample x lets expect, for some of its rows.

    Where n is more than the sample, the nearest distances there are carried
    on by the local dimension that they show.
    """
    d2 = np.maximum((x[rows] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[rows] @ x.T, 0)
    d2[np.arange(len(rows)), rows] = np.inf
    m = min(max(k, 20), len(x) - 1)
    near = np.sqrt(np.sort(np.partition(d2, m - 1, axis=1)[:, :m], axis=1))
    if n <= len(x):
        return near[:, min(k, m) - 1]
    low = np.maximum(near, 1e-9)
    dimension = 1 / np.maximum(np.mean(np.log(low[:, -1:] / low), axis=1), 1e-3)
    return near[:, -1] * (k * len(x) / (n * m)) ** (1 / np.maximum(dimension, 1))


def fitted(x: np.ndarray, n: int, k: int, conf: Hashing) -> Hashing:
    """conf with hashes and width for n vectors like those of the sample x."""
    if len(x) < 2:
        return conf
    dim = x.shape[1]
    rows = np.unique(np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(np.int64))
    far = expected_distances(x, rows, n, k)
    spread = float(np.sqrt(max(x.var(axis=0).sum(), 1e-12)))
    best, least = conf, np.inf
    for hashes in (2, 3, 4, 6, 8, 12, 16, 20):
        lo, hi = 1e-3 * spread, 64 * spread
        for _ in range(14):
            mid = (lo * hi) ** 0.5
            found = chances(x[rows], far, dim, replace(conf, hashes=hashes, width=mid)).mean()
            lo, hi = (lo, mid) if found >= conf.wanted else (mid, hi)
        tried = replace(conf, hashes=hashes, width=hi)
        visited = 0.0
        for t in range(conf.tables):
            names = probed(x, t, dim, tried)
            own, counts = np.unique(names[:, 0], return_counts=True)
            at = np.minimum(np.searchsorted(own, names[rows]), len(own) - 1)
            visited += np.where(own[at] == names[rows], counts[at], 0).sum() / len(rows)
        if visited < least * 0.98:
            best, least = tried, visited
    return best


ROUTED = "bucket long, part int, query int, id long, vector binary"


def _count(dim: int, conf: Hashing, query: int):
    """(bucket, rows, queries) of the buckets that a task's vectors lie in, or that its queries visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.zeros(0, np.int64)]
            for a in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(1).slice(a, ROWS), dim)
                names += [(p if query else p[:, 0]).ravel() for p in (probed(x, t, dim, conf) for t in range(conf.tables))]
            bucket, count = np.unique(np.concatenate(names), return_counts=True)
            none = np.zeros_like(count)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(none if query else count), pa.array(count if query else none)], ["bucket", "rows", "queries"])

    return run


def _route(dim: int, conf: Hashing, query: int, hot):
    """ROUTED: each vector once a table, each query once a probe.

    A large bucket is a grid of parts: a vector goes to one row of it, a query
    to one column, so that they meet once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, down, across = hot.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                ids = batch.column(0).slice(a, ROWS)
                x = _matrix(batch.column(1).slice(a, ROWS), dim)
                blobs = pa.array([r.tobytes() for r in x], pa.binary())
                h = G.mix(ids.to_numpy().view(np.uint64))
                for t in range(conf.tables):
                    names = probed(x, t, dim, conf)
                    bucket = names.T.ravel() if query else names[:, 0]
                    take = np.tile(np.arange(len(x)), len(bucket) // max(len(x), 1))
                    part = np.zeros(len(bucket), np.int64)
                    if len(large):
                        at = np.minimum(np.searchsorted(large, bucket), len(large) - 1)
                        split = large[at] == bucket
                        r, c = np.where(split, down[at], 1), np.where(split, across[at], 1)
                        copies = r if query else c
                        own = (h[take] % (c if query else r).astype(np.uint64)).astype(np.int64)
                        each = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
                        bucket, take, own, c = (np.repeat(v, copies) for v in (bucket, take, own, c))
                        part = each * c + own if query else own * c + each
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(part.astype(np.int32)), pa.array(np.full(len(bucket), query, np.int32)), ids.take(pa.array(take)), blobs.take(pa.array(take))], ["bucket", "part", "query", "id", "vector"])

    return run


def _doubtful(dim: int, conf: Hashing, want: int):
    """(id, vector, far) of queries (id, vector, candidates, far) whose neighbours may have been missed; far is what bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x, far = _matrix(part.column(1), dim), part.column(3).to_numpy()
                few = part.column(2).to_numpy() < want
                doubt = pa.array(few | (chances(x, far, dim, conf) < conf.sure))
                rows = [part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.where(few, np.inf, far))]
                yield pa.RecordBatch.from_arrays([c.filter(doubt) for c in rows], ["id", "vector", "far"])

    return run


def _scan(dim: int, k: int, held):
    """Each broadcast query's k best of a task's vectors, of those no farther than its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, far = held.value
        best: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                ids, x = batch.column(0).slice(a, ROWS).to_numpy(), _matrix(batch.column(1).slice(a, ROWS), dim)
                for own, near, distance in top_k(ids, x, qids, q, k):
                    ok = distance <= far[np.searchsorted(qids, own)] + 1e-6
                    best.append((own[ok], near[ok], distance[ok]))
            if sum(len(b[0]) for b in best) > 4 * k * len(qids) + ROWS:
                best = [_best(best, k)]
        if best:
            rows = _best(best, k)
            if len(rows[0]):
                yield _blob_rows([rows])

    return run


def _best(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, neighbour, distance) each query's k nearest, each neighbour once; ties by id."""
    q, n, d = (np.concatenate(c) for c in zip(*parts))
    o = np.lexsort((d, n, q))
    q, n, d = q[o], n[o], d[o]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (n[1:] != n[:-1])
    q, n, d = q[new], n[new], d[new]
    o = np.lexsort((n, d, q))
    q, n, d = q[o], n[o], d[o]
    ok = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[ok], n[ok], d[ok]


def top_k(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, neighbour, distance) of each query's k nearest, itself left out; ties by id. Of rows that repeat an id the nearest counts."""
    o = np.argsort(ids, kind="stable")
    ids, x = ids[o], x[o].astype(np.float64)
    norms = (x * x).sum(1)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    c = min(k + 1, len(first))
    for a in range(0, len(qids), ROWS):
        rows, own = q[a : a + ROWS].astype(np.float64), qids[a : a + ROWS]
        square = (rows * rows).sum(1)[:, None]
        d = np.maximum(square + norms - 2 * rows @ x.T, 0)
        each = np.minimum.reduceat(d, first, axis=1) if len(first) < len(ids) else d
        # The k-th of the others, or the query itself and k others; rounding grows with the norms.
        limit = np.partition(each, c - 1, axis=1)[:, c - 1 : c]
        i, j = np.nonzero(d <= limit + 1e-9 * (1 + square + norms.max()))
        ok = own[i] != ids[j]
        i, j = i[ok], j[ok]
        # Exact distances for what is left, so that ties and copies come out alike everywhere.
        yield _best([(own[i], ids[j], np.sqrt(((rows[i] - x[j]) ** 2).sum(1)))], k)


def _blob_rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    qid, nid, dist = (np.concatenate(c) for c in zip(*parts))
    cuts = np.flatnonzero(np.diff(qid, prepend=qid[0] - 1)) if len(qid) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(qid))
    return pa.RecordBatch.from_arrays([pa.array(qid[cuts]), pa.array([nid[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([dist[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], ["id", "ids", "distances"])


def _search(k: int):
    """Searches part after part of the buckets; rows come sorted by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            query, ids, blobs = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), b"".join(b for h in held for b in h[2])
            x = np.frombuffer(blobs, np.float32).reshape(len(ids), -1)
            data = query == 0
            if data.any() and not data.all():
                for part in top_k(ids[data], x[data], ids[~data], x[~data], k):
                    if len(part[0]):
                        yield _blob_rows([part])

        for batch in batches:
            bucket, place, query, ids, blobs = (*(batch.column(c).to_numpy() for c in range(4)), batch.column(4).to_pylist())
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(place) != 0)) + 1 if len(bucket) else []
            for a, b in zip([0, *cuts], [*cuts, len(bucket)]):
                if b <= a:
                    continue
                if (bucket[a], place[a]) != at and held:
                    yield from close()
                    held = []
                at = bucket[a], place[a]
                held.append((query[a:b], ids[a:b], blobs[a:b]))
        if held:
            yield from close()

    return run


def _merge(k: int):
    """Each query's k best of all lists; rows come sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[tuple] = []

        def best(rows: list[tuple]) -> pa.RecordBatch:
            length = [len(r[1]) // 8 for r in rows]
            parts = np.repeat(np.array([r[0] for r in rows], np.int64), length), np.frombuffer(b"".join(r[1] for r in rows), np.int64), np.frombuffer(b"".join(r[2] for r in rows), np.float64)
            q, n, d = _best([parts], k)
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(n), pa.array(d), pa.array(rank.astype(np.int32))], ["vec_id", "neighbor_id", "distance", "rank"])

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            if not rows:
                continue
            last = rows[-1][0]
            cut = next((i for i in range(len(rows), 0, -1) if rows[i - 1][0] != last), 0)
            if cut or (tail and tail[-1][0] != last):
                yield best(tail + rows[:cut])
                tail = []
            tail += rows[cut:]
        if tail:
            yield best(tail)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) without null ids and vectors that are null, empty, or have a null, NaN or infinite element."""
    v = F.col(vector_col).cast("array<float>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad))


def nearest(vectors: DataFrame, k: int = 10, queries: Column | None = None, conf: Hashing = Hashing(), id_col: str = "vec_id", vector_col: str = "embedding", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(vec_id, neighbor_id, distance, rank): k nearest others by Euclidean distance, nearly all of them, of every vector that ``queries``, a condition on the id named ``id``, holds for, all by default.

    Rows with a null id, a null or empty vector, one with a null, NaN or
    infinite element or of other length than the most common (of equally
    common the longest) are left out. Rows that repeat an id are one vector,
    as a query the first in order, as a neighbour the nearest. Equal distances
    go by the smaller id. Fewer than k come back where there are no more
    others; a single vector has none; an empty table gives no rows; other
    columns are ignored.
    """
    spark, found = vectors.sparkSession, "vec_id long, neighbor_id long, distance double, rank int"
    rows = usable(vectors, id_col, vector_col)
    shapes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if shapes is None:
        return spark.createDataFrame([], found)
    dim, total = shapes["d"], shapes["count"]
    rows = rows.where(F.size("vector") == dim)
    asked = cut((rows if queries is None else rows.where(queries)).groupBy("id").agg(F.min("vector").alias("vector")))
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).toArrow()
    x = _matrix(sample.column("vector").combine_chunks(), dim).astype(np.float64)
    conf = fitted(np.unique(x, axis=0), total, k, conf)
    parts = partitions(spark)
    counts = rows.mapInArrow(frugal(_count(dim, conf, 0)), "bucket long, rows long, queries long").unionByName(asked.mapInArrow(frugal(_count(dim, conf, 1)), "bucket long, rows long, queries long"))
    counts = counts.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("queries").alias("queries"))
    most = max(1, bucket_bytes // (4 * dim))
    large = counts.where((F.col("rows") > 0) & (F.col("queries") > 0) & (F.greatest("rows", "queries") > most)).orderBy("bucket").toArrow()
    hot = spark.sparkContext.broadcast((large.column("bucket").to_numpy(), *(-(-large.column(c).to_numpy() // most) for c in ("rows", "queries"))))
    routed = rows.mapInArrow(frugal(_route(dim, conf, 0, hot)), ROUTED).unionByName(asked.mapInArrow(frugal(_route(dim, conf, 1, hot)), ROUTED))
    lists = "id long, ids binary, distances binary"
    local = routed.repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(frugal(_search(k)), lists)
    merged = lambda df: df.repartition(parts, "id").sortWithinPartitions("id").mapInArrow(frugal(_merge(k)), found)
    hashed = cut(merged(local))
    seen = hashed.groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("candidates"), F.max("distance").alias("far"))
    judged = asked.join(seen, "id", "left").select("id", "vector", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("far", F.lit(0.0)).alias("far"))
    doubt = cut(judged.mapInArrow(frugal(_doubtful(dim, conf, k)), "id long, vector binary, far double"))
    doubts = doubt.count()
    if not doubts:
        return hashed
    exact = None
    rounds = -(-doubts * (4 * dim + 16) // BROADCAST_BYTES)
    for c in range(rounds):
        block = doubt.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == c).orderBy("id").toArrow()
        q = np.frombuffer(b"".join(block.column("vector").to_pylist()), np.float32).reshape(-1, dim)
        held = spark.sparkContext.broadcast((block.column("id").to_numpy(), q, block.column("far").to_numpy()))
        own = merged(rows.mapInArrow(frugal(_scan(dim, k, held)), lists))
        exact = own if exact is None else exact.unionByName(own)
    return hashed.join(small(doubt.select(F.col("id").alias("vec_id")), 8), "vec_id", "left_anti").unionByName(exact)
