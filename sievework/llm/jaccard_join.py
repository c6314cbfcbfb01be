"""Exact Jaccard join of word n-gram sets by metric-space partitioning.

Documents of equal n-gram sets are one node, so copies never meet each other:
the join runs over nodes, and a node's copies count through its weight.

Jaccard distance is a metric, so a pivot p bounds the distance of two nodes:
|d(a,p) - d(b,p)| <= d(a,b) <= d(a,p) + d(b,p). Distances to a fixed handful
of pivot documents are nearly all 1 in a corpus of unrelated texts, so the
first level takes single n-grams as pivots: d(x, {g}) is 1 - 1/|x| where x
holds g and 1 elsewhere, so a node's nearest pivots are its own n-grams,
ranked rarest first. If J(x, y) >= t, y misses at most |x| - ceil(t|x|)
n-grams of x, so the window of pivots into which x is replicated is its first
|x| - ceil(t|x|) + 1 n-grams; two near nodes share at least one such cell. The
window is longer by a fiftieth of |x|, whence they share a fiftieth more of
the smaller set, and unrelated long texts with an n-gram or two in common are
told apart before their sets travel.

Inside the cells nodes are the pivots: a node's home is the Voronoi region of
the node it meets most often as its cells' smallest. Nodes that meet a home
member of another region are replicated to the smaller of the two regions,
unless sketches, counts of hashed n-grams that bound intersections from above,
tell that they reach J >= t with none of its home members. A region with more n-grams than a task should hold is split by new pivots among
its members: each goes to the nearest, exact distances and the triangle
inequality say into which other regions it is replicated, and regions still
too large are split again. A region's home members are then joined exactly
with each other and with the guests, which stream past them in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as G
from .common import BROADCAST_BYTES, cut, frugal, partitions, planes, small, tidy, unplanes
from .components import components

U64 = np.uint64
EPS = 1e-9
SMALL_CELL = 16
HOT_CELL = 200_000
FLUSH = 1_000_000
BLOCK = 512
FOUND_ROWS, FOUND_LISTS = 1 << 16, 256
STEPS = 8
#: Bits, and bytes, of the hashes by which n-grams are counted; texts from which on an n-gram is a frequent one.
COUNT_BITS, COUNT_BYTES = 40, 5
FREQUENT = 4
#: Home n-grams of a region, and guests, that one task takes.
REGION_GRAMS, REGION_GUESTS = 2_000_000, 20_000
PIVOTS, DEPTH = 64, 6
#: Fewest slots of a sketch, the largest count it may hold, and the groups of home members whose sketches are compared as one each.
SKETCH_SLOTS, SKETCH_COUNT, SKETCH_GROUPS = 64, 60, 64


def _lowered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text")).where("id IS NOT NULL AND text IS NOT NULL AND text <> ''")


def node_names(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set, whatever its order; 0 for an empty one."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        total = np.add.reduceat(G.mix(grams + U64(0x5851F42D4C957F2D)), bounds[:-1][full])
        out[full] = G.mix(total + sizes[full].astype(np.uint64))
    return out.view(np.int64)


PROFILE = "id long, node long, size int"


def _profile(n: int) -> Callable:
    """(id, node, size) of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in G.text_chunks(batch):
                grams, bounds = G.gram_sets(data, offsets, n)
                sizes = np.diff(bounds)
                keep = pa.array(sizes > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).filter(keep), pa.array(node_names(grams, bounds)).filter(keep), pa.array(sizes.astype(np.int32)).filter(keep)], ["id", "node", "size"])

    return run


_COUNT_OF = (2.0 ** (np.arange(256) / STEPS) - 1).astype(np.float32)


def _edges(bits: int, ranges: int) -> np.ndarray:
    """Where the ranges of the 2**bits hash slots begin, and the end."""
    return (np.arange(ranges + 1) << bits) // ranges


def _hashes(n: int, bits: int, ranges: int) -> Callable:
    """The upper 40 bits of all n-grams' hashes, sorted and as differences, by range of slots."""
    edges = _edges(bits, ranges).astype(np.uint64) << U64(COUNT_BITS - bits)

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        own = np.concatenate(held)
        own.sort()
        cuts = np.searchsorted(own, edges)
        keys, blobs = [], []
        for r in np.flatnonzero(np.diff(cuts)):
            keys.append(int(r))
            part = own[cuts[r] : cuts[r + 1]]
            blobs.append(planes(np.diff(part, prepend=edges[r]))[: COUNT_BYTES * len(part)])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for _, _, data, offsets in G.text_chunks(batch):
                grams, _ = G.gram_sets(data, offsets, n)
                held.append(grams >> U64(G.GRAM_BITS - COUNT_BITS))
                count += len(grams)
                if count >= 2 * FLUSH:
                    yield pack(held)
                    held, count = [], 0
        if count:
            yield pack(held)

    return run


def _count_hashes(bits: int, ranges: int) -> Callable:
    """(part, counts): for each slot of a range the logarithm of the largest count of an n-gram in it, 0 under FREQUENT; rows come sorted by part."""
    edges = _edges(bits, ranges)

    def counted_range(r: int, blobs: list[bytes]) -> tuple[int, bytes]:
        own = []
        for blob in blobs:
            wide = blob + bytes(len(blob) // COUNT_BYTES * (8 - COUNT_BYTES))
            own.append(np.cumsum(unplanes(wide, "u8"), dtype=np.uint64) + (U64(edges[r]) << U64(COUNT_BITS - bits)))
        grams = np.concatenate(own)
        own.clear()
        grams.sort()
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        counts = np.diff(np.append(first, len(grams)))
        some = counts >= FREQUENT
        slots = (grams[first[some]] >> U64(COUNT_BITS - bits)).astype(np.int64) - edges[r]
        out = np.zeros(edges[r + 1] - edges[r], np.uint8)
        np.maximum.at(out, slots, np.minimum(255, np.rint(np.log2(counts[some] + 1.0) * STEPS)).astype(np.uint8))
        return r, zlib.compress(out.tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs, out = None, [], []
        for (key,), rows in _runs(batches, 1):
            if key != at and blobs:
                out.append(counted_range(at, blobs))
                blobs = []
            at = key
            blobs += rows.column(1).to_pylist()
        if blobs:
            out.append(counted_range(at, blobs))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([c for _, c in out], pa.binary())], ["part", "counts"])

    return run


def gram_ranks(texts: DataFrame, n: int, bits: int) -> np.ndarray:
    """For every slot of n-gram hashes the logarithm of the largest count of texts of its n-grams, 2**bits bytes.

    It ranks n-grams, rarest first, and tells which cells need splitting; any
    ranking gives the same pairs. N-grams are counted one by one: sums by slot
    would grow with the table, until windows fill with n-grams that many
    unrelated texts share and cells with their pairs.
    """
    parts = partitions(texts.sparkSession)
    ranges = min(parts, 1 << bits)
    hashes = texts.mapInArrow(frugal(_hashes(n, bits, ranges)), "part int, blob binary").repartition(parts, "part").sortWithinPartitions("part")
    out, edges = np.zeros(1 << bits, np.uint8), _edges(bits, ranges)
    for row in hashes.mapInArrow(frugal(_count_hashes(bits, ranges)), "part int, counts binary").collect():
        out[edges[row["part"]] : edges[row["part"] + 1]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out


def extra_cells(sizes: np.ndarray) -> np.ndarray:
    """Cells beyond the first that a node's window guarantees with each partner."""
    return sizes // 50


def window_lengths(sizes: np.ndarray, t: float) -> np.ndarray:
    return np.where(sizes > 0, np.minimum(sizes, sizes - np.ceil(t * sizes - EPS).astype(np.int64) + 1 + extra_cells(sizes)), 0)


def cell_parts(cells: np.ndarray, hot: int) -> np.ndarray:
    """Into how many parts a cell is split; its high bits are the logarithm of its count."""
    return np.maximum(1, np.ceil(_COUNT_OF[(cells >> U64(40)).astype(np.int64)] / hot)).astype(np.uint64)


def _signatures(n: int, t: float, bits: int, ranks, buckets: int, hot: int) -> Callable:
    """Packed (cell, id, size, position) of each node's window, grouped by bucket of cells."""

    def pack(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cell, ids, sizes, at = (np.concatenate(x) for x in zip(*held))
        # The low bits of the cell are those of the n-gram's hash.
        part = (G.mix(ids.view(np.uint64)) >> U64(20)) % cell_parts(cell, hot)
        bucket = ((cell + part * U64(0x9E3779B1)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        keys, blobs = [], []
        for b in np.flatnonzero(np.diff(cuts)):
            o = order[cuts[b] : cuts[b + 1]]
            keys.append(int(b))
            blobs.append(np.int64(len(o)).tobytes() + planes(cell[o]) + planes(ids[o]) + planes(sizes[o]) + planes(at[o]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, held, count = ranks.value, [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in G.text_chunks(batch):
                grams, bounds = G.gram_sets(data, offsets, n)
                sizes = np.diff(bounds)
                rows = np.repeat(np.arange(b - a), sizes)
                order = rank[(grams >> U64(G.GRAM_BITS - bits)).astype(np.int64)].astype(np.uint64)
                key = (rows.astype(np.uint64) << U64(48)) | (order << U64(40)) | (grams & U64((1 << 40) - 1))
                key.sort()
                at = np.arange(len(key)) - bounds[:-1][rows]
                keep = at < window_lengths(sizes, t)[rows]
                rows, at = rows[keep], at[keep]
                held.append((key[keep] & U64((1 << 48) - 1), ids[a:b][rows], sizes[rows].astype(np.int32), at.astype(np.int32)))
                count += len(rows)
                if count >= FLUSH:
                    yield pack(held)
                    held, count = [], 0
        if count:
            yield pack(held)

    return run


def sizes_fit(sa: np.ndarray, sb: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(sa, sb) >= t * np.maximum(sa, sb) - EPS


def places_fit(sa: np.ndarray, pa_: np.ndarray, sb: np.ndarray, pb: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of these sizes, their first common element at these places, can reach J >= t."""
    return 1 + np.minimum(sa - pa_ - 1, sb - pb - 1) >= t / (1 + t) * (sa + sb) - EPS


def largest_partners(sizes: np.ndarray, places: np.ndarray, t: float) -> np.ndarray:
    """The largest size of a set that can reach J >= t with one of these, where an n-gram at these places is among the first that they share.

    By the cells that a window guarantees, a pair's i-th common element leaves
    i - 1 + min(|x| - place of x, |y| - place of y) common ones at most.
    """
    sizes = sizes.astype(np.int64)
    return np.floor((sizes - places + extra_cells(sizes)) * ((1 + t) / t) + 1e-6).astype(np.int64) - sizes


def has_partner(sizes: np.ndarray, caps: np.ndarray, t: float) -> np.ndarray:
    """Whether some set of the cell, be it the same one, has a fitting size and neither one's size is beyond the other's cap."""
    order = np.argsort(sizes, kind="stable")
    s, c = sizes[order].astype(np.int64), caps[order]
    lo = np.searchsorted(s, np.ceil(t * s - EPS).astype(np.int64))
    hi = np.searchsorted(s, np.minimum(c, np.floor(s / t + EPS).astype(np.int64)), "right")
    most, out, width = c, np.zeros(len(s), bool), 1
    while width <= len(s):  # most[k]: the largest cap of width sets from k on
        own = (hi - lo >= width) & (hi - lo < 2 * width)
        out[own] = np.maximum(most[lo[own]], most[hi[own] - width]) >= s[own]
        most, width = np.maximum(most[: max(0, len(most) - width)], most[width:]), 2 * width
    back = np.zeros(len(s), bool)
    back[order] = out
    return back


FOUND = "kind int, x long, p long, votes long, need int, fits boolean, h long, ids array<long>, sizes array<int>, caps array<long>"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows of equal values in the first ``keys`` columns, by which they come sorted, as slices; a run over several batches comes in pieces."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def _cells(t: float, hot: int) -> Callable:
    """Pairs that meet in a cell (kind 0), with the number of cells; members of larger cells (kind 1).

    Works bucket by bucket; rows come sorted by bucket. All cells of a pair
    count where none of them is a larger one; pairs that meet in a larger one
    are found by its members. Parts of a split cell name their lists alike.
    Members without a partner in the cell, by sizes and places, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[np.ndarray, ...]] = []
        lists: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        held = listed = 0

        def meet(node, sizes, pos, i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            sa, sb = sizes[i].astype(np.int64), sizes[j].astype(np.int64)
            ok = (node[i] != node[j]) & sizes_fit(sa, sb, t) & (sb <= largest_partners(sa, pos[i], t)) & (sa <= largest_partners(sb, pos[j], t))
            i, j, sa, sb = i[ok], j[ok], sa[ok], sb[ok]
            pairs.append((np.maximum(node[i], node[j]), np.minimum(node[i], node[j]), np.ones(len(i), np.int64), 1 + extra_cells(np.minimum(sa, sb)), places_fit(sa, pos[i], sb, pos[j], t)))
            held += len(i)

        def bucket(blobs: list[bytes]) -> None:
            nonlocal listed
            parts: list[list[np.ndarray]] = [[], [], [], []]
            for blob in blobs:
                k, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
                for out, dtype in zip(parts, ("u8", "i8", "i4", "i4")):
                    width = np.dtype(dtype).itemsize * k
                    out.append(unplanes(blob[at : at + width], dtype))
                    at += width
            cell, node, sizes, pos = (np.concatenate(x) for x in parts)
            parts.clear()
            order = np.lexsort((sizes, node, cell))
            cell, node, sizes, pos = cell[order], node[order], sizes[order], pos[order]
            once = np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1]) | (sizes[1:] != sizes[:-1])])
            cell, node, sizes, pos = cell[once], node[once], sizes[once], pos[once]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            counts = np.diff(np.append(starts, len(cell)))
            split = cell_parts(cell[starts], hot) > 1
            for c in range(2, SMALL_CELL + 1):
                first = starts[(counts == c) & ~split]
                if len(first):
                    u, v = np.triu_indices(c, 1)
                    meet(node, sizes, pos, (first[:, None] + u).ravel(), (first[:, None] + v).ravel())
            large = (counts > SMALL_CELL) | split
            for s, c, apart in zip(starts[large], counts[large], split[large]):
                o = np.arange(s, s + c)
                meet(node, sizes, pos, o[1:], np.full(len(o) - 1, s))
                own, size, caps = node[s : s + c], sizes[s : s + c], largest_partners(sizes[s : s + c], pos[s : s + c], t)
                if not apart:
                    some = has_partner(size, caps, t)
                    own, size, caps = own[some], size[some], caps[some]
                    if len(own) < 2:
                        continue
                name = G.mix(cell[s : s + 1] + U64(7)) if apart else np.bitwise_xor.reduce(G.mix(own.view(np.uint64) + G.mix(np.arange(len(own), dtype=np.uint64))), keepdims=True)
                key = (int(name.view(np.int64)[0]), own.tobytes() + size.tobytes())
                if key not in lists:
                    lists[key] = own.copy(), size.copy(), caps
                    listed += len(own)
                else:
                    np.maximum(lists[key][2], caps, out=lists[key][2])

        def merged() -> tuple[np.ndarray, ...]:
            x, p, votes, need, fit = (np.concatenate(v) for v in zip(*pairs))
            o = np.lexsort((p, x))
            x, p, votes, need, fit = x[o], p[o], votes[o], need[o], fit[o]
            new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (p[1:] != p[:-1])])) if len(x) else np.zeros(0, np.int64)
            if len(x):
                # Rows that repeat an id may differ in size: the least need holds.
                x, p, votes, need, fit = x[new], p[new], np.add.reduceat(votes, new), np.minimum.reduceat(need, new), np.logical_or.reduceat(fit, new)
            return x, p, votes, need, fit

        def emit_pairs() -> Iterator[pa.RecordBatch]:
            x, p, votes, need, fit = merged()
            for a in range(0, len(x), FOUND_ROWS):
                b = min(a + FOUND_ROWS, len(x))
                k = b - a
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(x[a:b]), pa.array(p[a:b]), pa.array(votes[a:b]), pa.array(need[a:b].astype(np.int32)), pa.array(fit[a:b]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int64()))], FOUND_NAMES)

        def emit_lists() -> Iterator[pa.RecordBatch]:
            rows = [(h, *x) for (h, _), x in lists.items()]
            for at in range(0, len(rows), FOUND_LISTS):
                part = rows[at : at + FOUND_LISTS]
                k = len(part)
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), none, none, none, none.cast(pa.int32()), pa.nulls(k, pa.bool_()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.list_(pa.int64())), pa.array([r[2] for r in part], pa.list_(pa.int32())), pa.array([r[3] for r in part], pa.list_(pa.int64()))], FOUND_NAMES)

        at, blobs = None, []

        def spill() -> Iterator[pa.RecordBatch]:
            nonlocal held, listed
            if held >= FLUSH:
                rows = merged()
                pairs[:] = [rows]
                held = len(rows[0])
                if held >= FLUSH // 2:
                    yield from emit_pairs()
                    pairs.clear()
                    held = 0
            if listed >= FLUSH:
                yield from emit_lists()
                lists.clear()
                listed = 0

        for (key,), rows in _runs(batches, 1):
            if key != at and blobs:
                bucket(blobs)
                blobs = []
                yield from spill()
            at = key
            blobs += rows.column(1).to_pylist()
        if blobs:
            bucket(blobs)
        if pairs:
            yield from emit_pairs()
        yield from emit_lists()

    return run


def _routes(found: DataFrame, t: float) -> DataFrame:
    """(id, region, home, role): 2 the region's pivot, 1 its home nodes, 0 nodes from other regions.

    Two nodes that meet in a cell are both in the region where ``counted``
    has their pair: that of the one which is the other's home, else that of
    the smaller of their homes, to which the other is replicated.
    """
    met = found.where("kind = 0").groupBy("x", "p").agg(F.sum("votes").alias("votes"), F.min("need").alias("need"), F.max("fits").alias("fits"))
    pairs = cut(met.where("fits AND votes >= need").select("x", "p", "votes"))
    home = cut(pairs.groupBy("x").agg(F.max_by("p", F.struct("votes", -F.col("p"))).alias("home")))
    of = lambda name: home.select(F.col("x").alias(name), F.col("home").alias(f"{name}_home"))
    sides = pairs.select("x", "p").join(of("x"), "x").join(of("p"), "p", "left").withColumn("p_home", F.coalesce("p_home", "p"))
    apart = sides.where("x_home <> p_home AND x_home <> p")
    low = F.col("x_home") < F.col("p_home")
    guests = apart.select(F.when(low, F.col("p")).otherwise(F.col("x")).alias("id"), F.least("x_home", "p_home").alias("region"))
    members = found.where("kind = 1").select("h", F.explode(F.arrays_zip("ids", "sizes", "caps")).alias("m")).groupBy("h", F.col("m.ids").alias("x"), F.col("m.sizes").alias("size")).agg(F.max("m.caps").alias("cap"))
    members = members.join(of("x"), "x", "left").withColumn("x_home", F.coalesce("x_home", "x"))
    regions = members.groupBy("h", F.col("x_home").alias("region")).agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max("cap").alias("most_cap"))
    many = members.join(regions, "h").where((F.col("x_home") > F.col("region")) & (F.col("size") >= t * F.col("least") - EPS) & (F.col("size") * t <= F.col("most") + EPS) & (F.col("size") <= F.col("most_cap")) & (F.col("least") <= F.col("cap")))
    guests = guests.unionByName(many.select(F.col("x").alias("id"), "region"))
    routes = home.select(F.col("x").alias("id"), F.col("home").alias("region"), F.lit(1).alias("role")).unionByName(guests.select("id", "region", F.lit(0).alias("role")))
    routes = routes.unionByName(routes.select(F.col("region").alias("id"), "region", F.lit(2).alias("role")))
    routes = routes.groupBy("id", "region").agg(F.max("role").alias("role"))
    return routes.join(of("id"), "id", "left").withColumn("home", F.coalesce("id_home", "id")).drop("id_home")


ROUTED = ["region", "part", "role", "id", "node", "home", "base", "copies"]
ROUTE_BYTES = 8 * len(ROUTED)
SETS = "region long, part int, role int, id long, node long, home long, base long, copies long, grams binary"


def _sets(n: int) -> Callable:
    """(id, node, grams): 48-bit n-grams in 6 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in G.text_chunks(batch):
                grams, bounds = G.gram_sets(data, offsets, n)
                low = np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, :6]
                blobs = [low[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(node_names(grams, bounds)), pa.array(blobs, pa.binary())], ["id", "node", "grams"])

    return run


def _routed_sets(n: int, routes) -> Callable:
    """SETS for the documents of the broadcast routes, which are sorted by id."""
    sets = _sets(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = routes.value
        ids = held["id"]
        for batch in batches:
            own = batch.column(0).to_numpy()
            at = np.searchsorted(ids, own)
            needed = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own) if len(ids) else np.zeros(len(own), bool)
            if not needed.any():
                continue
            for out in sets(iter([batch.filter(pa.array(needed))])):
                o, names = out.column(0).to_numpy(), out.column(1).to_numpy()
                lo, hi = np.searchsorted(ids, o), np.searchsorted(ids, o, "right")
                take = np.repeat(np.arange(len(o)), hi - lo)
                of = np.arange(len(take)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[take]
                ok = held["node"][of] == names[take]  # a row that repeats an id may have another text
                of, take = of[ok], take[ok]
                yield pa.RecordBatch.from_arrays([*(pa.array(held[c][of]) for c in ROUTED), out.column(2).take(pa.array(take))], [*ROUTED, "grams"])

    return run


def _with_sets(texts: DataFrame, routes: DataFrame, n: int, limit: int) -> DataFrame:
    """routes with the ``grams`` of their documents; the routes are broadcast where they have no more than ``limit`` bytes."""
    spark = texts.sparkSession
    routes = routes.select(*(F.col(c).cast("int" if c in ("part", "role") else "long") for c in ROUTED))
    if routes.count() * ROUTE_BYTES <= limit:
        local = routes.orderBy("id").toArrow()
        held = spark.sparkContext.broadcast({c: local.column(c).to_numpy() for c in ROUTED})
        return texts.mapInArrow(frugal(_routed_sets(n, held)), SETS)
    needed = texts.join(small(cut(routes.select("id").distinct()), 8, limit), "id", "left_semi")
    return needed.mapInArrow(frugal(_sets(n)), "id long, node long, grams binary").join(routes, ["id", "node"]).select(*ROUTED, "grams")


def sketch(grams: np.ndarray) -> np.ndarray:
    """How many n-grams fall into each of 2**k slots, at least as many as n-grams; empty where a count is too large for it."""
    slots = max(SKETCH_SLOTS, 1 << (len(grams) - 1).bit_length())
    counts = np.bincount((grams & U64(slots - 1)).astype(np.int64), minlength=slots)
    return counts.astype(np.uint8) if counts.max() <= SKETCH_COUNT else np.zeros(0, np.uint8)


def folded(sketches: np.ndarray, slots: int) -> np.ndarray:
    """The sketches in rows, as they are with fewer slots."""
    while sketches.shape[1] > slots:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] + sketches[:, half:]
    return sketches


def _sketches(n: int) -> Callable:
    """(id, node, size, sketch) of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in G.text_chunks(batch):
                grams, bounds = G.gram_sets(data, offsets, n)
                blobs = [zlib.compress(sketch(grams[s:e]).tobytes(), 1) if e > s else b"" for s, e in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(node_names(grams, bounds)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(blobs, pa.binary())], ["id", "node", "size", "sketch"])

    return run


class Homes:
    """Sketches of a region's home members, to tell which other nodes may be near one of them."""

    def __init__(self, rows: list[tuple[int, bytes]], t: float):
        self.t, self.any, self.by = t, False, []
        own: dict[int, list[tuple[int, np.ndarray]]] = {}
        for size, blob in rows:
            counts = np.frombuffer(zlib.decompress(blob), np.uint8)
            self.any |= not len(counts)
            own.setdefault(len(counts), []).append((size, counts))
        for slots, held in own.items():
            held.sort(key=lambda x: x[0])
            starts = np.arange(0, len(held), -(-len(held) // SKETCH_GROUPS))
            sizes = np.array([x[0] for x in held], np.int64)
            most = sizes[np.append(starts[1:], len(held)) - 1]
            self.by.append((sizes[starts], most, {slots: np.maximum.reduceat(np.stack([x[1] for x in held]), starts, axis=0)}))

    def may_reach(self, size: int, blob: bytes) -> bool:
        """Whether J >= t with a home member can't be ruled out; ``any``: some member has no sketch."""
        counts = np.frombuffer(zlib.decompress(blob), np.uint8)
        if self.any or not len(counts):
            return True
        for least, most, at in self.by:
            fits = (size >= self.t * least - EPS) & (size * self.t <= most + EPS)
            if not fits.any():
                continue
            slots = min(len(counts), max(at))
            if slots not in at:
                at[slots] = folded(at[max(at)].astype(np.uint16), slots)
            own = folded(counts[None, :].astype(np.uint16), slots)
            both = np.minimum(at[slots][fits], own).sum(axis=1, dtype=np.int64)
            if (both >= self.t / (1 + self.t) * (size + least[fits]) - EPS).any():
                return True
        return False


def _likely(t: float) -> Callable:
    """(region, id) of the guests that may reach a home member; rows come sorted by region and part, home members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, homes = None, [], None
        for key, run_ in _runs(batches, 2):
            if key != at:
                at, rows, homes = key, [], None
            kept = []
            for role, name, size, blob in zip(*(c.to_pylist() for c in run_.columns[2:])):
                if role:
                    rows.append((size, blob))
                    continue
                if homes is None:
                    homes = Homes(rows, t)
                    rows = []
                if homes.may_reach(size, blob):
                    kept.append(name)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(kept), pa.int64()), pa.array(kept, pa.int64())], ["region", "id"])

    return run


def _spread(routes: DataFrame) -> DataFrame:
    """routes with ``part``: guests of a region beyond a task's number go to parts, each with the home nodes."""
    guests = routes.groupBy("region").agg(F.count_if(F.col("role") == 0).alias("guests")).where(F.col("guests") > REGION_GUESTS)
    salted = routes.join(guests, "region", "left").withColumn("salts", F.ceil(F.coalesce("guests", F.lit(1)) / REGION_GUESTS).cast("int"))
    spread = F.when(F.col("role") > 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), "salts").cast("int")))
    return salted.withColumn("part", F.explode(spread))


def likely_guests(routes: DataFrame, texts: DataFrame, n: int, t: float, limit: int) -> DataFrame:
    """routes without the guests which no home member of their region can be near, by their sketches.

    Frequent n-grams bring unrelated texts together. A sketch is smaller than
    a set, and never counts less than two sets share, so no link is lost.
    """
    parts = partitions(texts.sparkSession)
    some = routes.where("role = 0").select("region").distinct()
    own = cut(_spread(routes.join(some, "region", "left_semi")).select("region", "part", "role", "id", "node"))
    if own.isEmpty():
        return routes
    needed = texts.join(small(cut(own.select("id").distinct()), 8, limit), "id", "left_semi")
    made = needed.mapInArrow(frugal(_sketches(n)), "id long, node long, size int, sketch binary")
    rows = made.join(small(own, 40, limit), ["id", "node"]).select("region", "part", "role", "id", "size", "sketch")
    rows = rows.repartition(parts, "region", "part").sortWithinPartitions("region", "part", F.desc("role"))
    kept = cut(rows.mapInArrow(frugal(_likely(t)), "region long, id long").distinct())
    return cut(routes.where("role > 0").unionByName(routes.where("role = 0").join(small(kept, 16, limit), ["region", "id"], "left_semi")))


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of sets, one after the other, and their sizes."""
    sizes = np.array([len(b) // 6 for b in blobs], np.int64)
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel(), sizes


class Sets:
    """Sets of n-grams, indexed by n-gram, with which others are intersected."""

    def __init__(self, grams: np.ndarray, sizes: np.ndarray):
        self.sizes, self.m = sizes, len(sizes)
        rows = np.repeat(np.arange(self.m), sizes)
        order = np.argsort(grams, kind="stable")
        grams, self.rows = grams[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        self.keys, self.starts = grams[first], first
        self.counts = np.diff(np.append(first, len(grams)))

    def overlaps(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the given sets, a row each, with all of these."""
        n, m = len(sizes), self.m
        row = np.repeat(np.arange(n), sizes)
        at = np.searchsorted(self.keys, grams)
        hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == grams) if len(self.keys) else np.zeros(len(grams), bool)
        row, at = row[hit], at[hit]
        out = np.zeros((n, m), np.float32)
        rare = self.counts[at] <= max(2, m // 32)
        for a in range(0, int(rare.sum()), 200_000):
            r, c = row[rare][a : a + 200_000], at[rare][a : a + 200_000]
            k = self.counts[c]
            j = self.rows[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.starts[c], k)]
            out += np.bincount(np.repeat(r, k) * m + j, minlength=n * m).reshape(n, m)
        row, at = row[~rare], at[~rare]
        used, column = np.unique(at, return_inverse=True)
        step = max(64, 4_000_000 // max(m, n, 1))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for a in range(0, len(used), step):
            own = used[a : a + step]
            k = self.counts[own]
            right = np.zeros((len(own), m), np.float32)
            right[np.repeat(np.arange(len(own)), k), self.rows[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.starts[own], k)]] = 1
            left = np.zeros((n, len(own)), np.float32)
            lo, hi = np.searchsorted(column, [a, a + step])
            left[row[lo:hi], column[lo:hi] - a] = 1
            out += left @ right
        return out


def counted(a: np.ndarray, ha: np.ndarray, b: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """The one region in which the pair of ids a and b, with these homes, counts."""
    return np.where(ha == b, b, np.where(hb == a, a, np.minimum(ha, hb)))


def linked(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """labels, the smallest member of each one's component, after joining u with v."""
    while True:
        low = np.minimum(labels[u], labels[v])
        if (low == labels[u]).all() and (low == labels[v]).all():
            return labels
        roots = labels.copy()
        np.minimum.at(roots, labels[u], low)
        np.minimum.at(roots, labels[v], low)
        while True:
            further = roots[roots]
            if (further == roots).all():
                break
            roots = further
        labels = roots[labels]


class Region:
    """One region's home nodes, ordered by their distance from its pivot."""

    def __init__(self, rows: list[tuple], t: float, emit: str):
        self.t, self.emit, self.eps = t, emit, 1 - t + EPS
        grams, sizes = _unpacked([r[-1] for r in rows])
        pivot = Sets(grams[: sizes[0]], sizes[:1])
        self.pivot = pivot
        distance = self.from_pivot(grams, sizes)
        o = np.argsort(distance, kind="stable")
        self.distance, self.sizes = distance[o], sizes[o]
        self.id, self.home, self.base, self.copies = (np.array([r[k] for r in rows], np.int64)[o] for k in (0, 2, 3, 4))
        cuts = np.append(0, np.cumsum(sizes))
        self.grams = np.concatenate([grams[cuts[k] : cuts[k + 1]] for k in o])
        self.cuts = np.append(0, np.cumsum(self.sizes))
        self.sets = Sets(self.grams, self.sizes)
        self.links, self.labels = np.zeros(len(o), np.int64), np.arange(len(o))
        self.out: list[tuple[np.ndarray, ...]] = []

    def from_pivot(self, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        both = self.pivot.overlaps(grams, sizes)[:, 0]
        return 1 - both / np.maximum(self.pivot.sizes[0] + sizes - both, 1)

    def found(self, grams: np.ndarray, sizes: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, home member, J) of pairs with J >= t, those only compared whose distances from the pivot allow it."""
        lo, hi = np.searchsorted(self.distance, [distance.min() - self.eps, distance.max() + self.eps])
        inter = self.sets.overlaps(grams, sizes)[:, lo:hi]
        j = inter / np.maximum(sizes[:, None] + self.sizes[None, lo:hi] - inter, 1)
        i, c = np.nonzero(j >= self.t - 1e-6)
        both = inter[i, c].astype(np.float64)
        c = c + lo
        exact = both / (sizes[i] + self.sizes[c] - both)
        ok = exact >= self.t - EPS
        return i[ok], c[ok], exact[ok]

    def join_homes(self) -> None:
        for a in range(0, len(self.id), BLOCK):
            b = min(a + BLOCK, len(self.id))
            i, c, j = self.found(self.grams[self.cuts[a] : self.cuts[b]], self.sizes[a:b], self.distance[a:b])
            i = i + a
            own = (i < c) & (counted(self.id[i], self.home[i], self.id[c], self.home[c]) == self.base[i])
            i, c, j = i[own], c[own], j[own]
            self.links += np.bincount(i, self.copies[c], len(self.id)).astype(np.int64) + np.bincount(c, self.copies[i], len(self.id)).astype(np.int64)
            if self.emit == "pairs":
                self.out.append((self.id[i], self.id[c], j))
            else:
                self.labels = linked(self.labels, i, c)

    def join_guests(self, rows: list[tuple]) -> None:
        grams, sizes = _unpacked([r[-1] for r in rows])
        ids, home, base, copies = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3, 4))
        distance = self.from_pivot(grams, sizes)
        near = distance <= self.distance[-1] + self.eps
        if not near.any():
            return
        grams = grams[np.repeat(near, sizes)]
        sizes, ids, home, base, copies, distance = (x[near] for x in (sizes, ids, home, base, copies, distance))
        i, c, j = self.found(grams, sizes, distance)
        own = counted(ids[i], home[i], self.id[c], self.home[c]) == base[i]
        i, c, j = i[own], c[own], j[own]
        if self.emit == "pairs":
            self.out.append((ids[i], self.id[c], j))
            return
        m = len(self.id)
        self.links += np.bincount(c, copies[i], m).astype(np.int64)
        links = np.bincount(i, self.copies[c], len(ids)).astype(np.int64)
        labels = linked(np.concatenate([self.labels, m + np.arange(len(ids))]), m + i, c)
        self.labels = labels[:m]
        some = links > 0
        self.out.append((ids[some], links[some], self.id[labels[m:][some]]))

    def result(self) -> list[tuple[np.ndarray, ...]]:
        if self.emit == "pairs":
            return [(np.minimum(a, b), np.maximum(a, b), j) for a, b, j in self.out]
        some = self.links > 0
        return [*self.out, (self.id[some], self.links[some], self.id[self.labels[some]])]


RESULTS = {"pairs": "doc_a long, doc_b long, jaccard double", "links": "id long, links long, root long"}


def _join_regions(t: float, emit: str) -> Callable:
    """Joins region after region; rows come sorted by region and part, home nodes before guests, and by id.

    Every part of a region holds its home nodes, and the first alone joins
    them with each other.
    """
    names = [c.split()[0] for c in RESULTS[emit].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, region, homes, guests = None, None, None, [], []
        out: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            """Takes the home nodes together, then the guests that wait."""
            nonlocal region
            if region is None and homes:
                region = Region(homes, t, emit)
                homes.clear()
                if at[1] == 0:
                    region.join_homes()
            if region is not None and guests:
                region.join_guests(guests)
            guests.clear()

        def close() -> None:
            nonlocal region
            settle()
            if region is not None:
                out.extend(region.result())
            region = None

        def batch_of() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for key, rows in _runs(batches, 2):
            if key != at:
                close()
                at, last = key, None
                if sum(len(x[0]) for x in out) > 100_000:
                    yield batch_of()
            for role, *row in zip(*(c.to_pylist() for c in rows.columns[2:])):
                if row[0] == last:
                    continue  # a repeated row
                last = row[0]
                (homes if role else guests).append(tuple(row))
                if len(guests) == BLOCK:
                    settle()
        close()
        if out:
            yield batch_of()

    return run


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, id, pivot, distance) of every member to its region's pivots, which come first (role 3) in each part."""
    at, pivots, names = None, [], np.zeros(0, np.int64)
    held: Sets | None = None
    for key, rows in _runs(batches, 2):
        if key != at:
            at, pivots, held = key, [], None
        role, node, blobs = (rows.column(k).to_pylist() for k in (2, 3, 8))
        k = sum(r == 3 for r in role)
        pivots += list(zip(node[:k], blobs[:k]))
        if k == len(role) or not pivots:
            continue
        if held is None:
            unique = dict(pivots)
            names = np.array(list(unique), np.int64)
            held = Sets(*_unpacked(list(unique.values())))
        for a in range(k, len(role), BLOCK):
            own = np.array(node[a : a + BLOCK], np.int64)
            grams, sizes = _unpacked(blobs[a : a + BLOCK])
            both = held.overlaps(grams, sizes).astype(np.float64)
            far = 1 - both / np.maximum(sizes[:, None] + held.sizes[None, :] - both, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(far.size, key[0], np.int64)), pa.array(np.repeat(own, len(names))), pa.array(np.tile(names, len(own))), pa.array(far.ravel())], ["region", "id", "pivot", "distance"])


def split_regions(routes: DataFrame, texts: DataFrame, n: int, t: float, most: int, limit: int) -> DataFrame:
    """routes with every region of more than ``most`` home n-grams split by new pivots, again and again.

    Each home member goes to its nearest pivot's region and is a guest in the
    earlier ones which the triangle inequality doesn't rule out; a guest stays
    one, in all of those. After DEPTH levels members go by hash instead of
    distance, which ends the recursion and changes no result.
    """
    parts = partitions(texts.sparkSession)
    for depth in range(2 * DEPTH):
        size = routes.groupBy("region").agg(F.sum(F.when(F.col("role") > 0, F.col("size"))).alias("grams"), F.count_if(F.col("role") > 0).alias("homes"), F.count("*").alias("rows"))
        big = cut(size.where((F.col("grams") > most) & (F.col("homes") > 1)).select("region", "grams", "homes", "rows"))
        if big.isEmpty():
            break
        own = cut(routes.join(big, "region"))
        key = F.pmod(F.xxhash64("id", "region", F.lit(depth)), F.lit(1 << 40)) / float(1 << 40)
        wanted = F.least(F.lit(PIVOTS), 2 * F.ceil(F.col("grams") / most))
        # As many as wanted on average, and the one of the smallest key in any case.
        lowest = own.where("role > 0").groupBy("region").agg(F.min(key).alias("lowest"))
        pivots = cut(own.where("role > 0").join(lowest, "region").where((key < wanted / F.col("homes")) | (key == F.col("lowest"))).select(*own.columns))
        salts = F.greatest(F.lit(1), F.ceil(F.col("rows") / 4096)).cast("int")
        fan = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("role", F.lit(3))
        rows = own.withColumn("part", F.pmod(F.xxhash64("id"), salts).cast("int")).select(*ROUTED).unionByName(fan.select(*ROUTED))
        sets = _with_sets(texts, rows, n, limit).repartition(parts, "region", "part").sortWithinPartitions("region", "part", F.desc("role"))
        far = cut(sets.mapInArrow(frugal(_distances), "region long, id long, pivot long, distance double").distinct())
        nearest = F.struct(F.col("distance") if depth < DEPTH else F.lit(0), F.xxhash64("id", "pivot"))
        homes = own.where("role > 0").select("region", "id").join(far, ["region", "id"])
        chosen = cut(homes.groupBy("region", "id").agg(F.min_by("pivot", nearest).alias("chosen")))
        radius = homes.join(chosen, ["region", "id"]).where("pivot = chosen").groupBy("region", "pivot").agg(F.max("distance").alias("radius"))
        near = far.join(radius, ["region", "pivot"]).join(chosen, ["region", "id"], "left")
        near = near.where(F.col("chosen").isNull() | (F.col("pivot") == F.col("chosen")) | ((F.col("pivot") < F.col("chosen")) & (F.col("distance") <= F.col("radius") + 1 - t + EPS)))
        near = near.where(F.col("chosen").isNotNull() | (F.col("distance") <= F.col("radius") + 1 - t + EPS))
        new = own.join(near.select("region", "id", "pivot", (F.col("pivot") == F.col("chosen")).alias("here")), ["region", "id"])
        new = new.withColumn("role", F.when(F.coalesce("here", F.lit(False)), 1).otherwise(0)).withColumn("region", F.xxhash64("region", "pivot"))
        routes = cut(routes.join(big.select("region"), "region", "left_anti").unionByName(new.select(*routes.columns)))
    return routes


def _classes(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each document, and (node, id, copies, size) with the smallest id of each node's documents."""
    own = cut(profile.groupBy("id").agg(F.max(F.struct("size", "node")).alias("s")).select("id", "s.node", "s.size"))
    return own.select("id", "node"), cut(own.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size")))


def _joined(docs: DataFrame, t: float, n: int, id_col: str, text_col: str, emit: str, sketch_bits: int, limit: int, most: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, node), (node, id, copies, size) and the joined regions' RESULTS."""
    spark = docs.sparkSession
    texts = _lowered(docs, id_col, text_col)
    own, classes = _classes(texts.mapInArrow(frugal(_profile(n)), PROFILE))
    parts = partitions(spark)
    # A node's further copies have nothing to add.
    more = cut(own.join(classes.where("copies > 1").select("node", F.col("id").alias("first")), "node").where("id <> first").select("id"))
    texts = texts.join(small(more, 8, limit), "id", "left_anti")
    ranks = spark.sparkContext.broadcast(gram_ranks(texts, n, sketch_bits))
    tidy(spark)
    packed = texts.mapInArrow(frugal(_signatures(n, t, sketch_bits, ranks, 8 * parts, hot)), "bucket int, blob binary")
    found = cut(packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_cells(t, hot)), FOUND))
    tidy(spark)
    routes = _routes(found, t).join(classes, "id").withColumn("base", F.col("region"))
    routes = likely_guests(cut(routes), texts, n, t, limit)
    tidy(spark)
    routes = split_regions(routes, texts, n, t, most, limit)
    sets = _with_sets(texts, cut(_spread(routes).select(*ROUTED)), n, limit)
    rows = sets.repartition(parts, "region", "part").sortWithinPartitions("region", "part", F.desc("role"), "id")
    return own, classes, rows.mapInArrow(frugal(_join_regions(t, emit)), RESULTS[emit])


def jaccard_pairs(docs: DataFrame, threshold: float = 0.7, n: int = 3, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = 24, broadcast_bytes: int = BROADCAST_BYTES, region_grams: int = REGION_GRAMS, hot_cell: int = HOT_CELL) -> tuple[DataFrame, DataFrame]:
    """(doc_a < doc_b, jaccard) of representatives, and the membership (doc_id, representative).

    Documents of equal n-gram sets are represented by the smallest id among
    them. As ``near_duplicates`` in all else.
    """
    own, classes, pairs = _joined(docs, threshold, n, id_col, text_col, "pairs", sketch_bits, broadcast_bytes, region_grams, hot_cell)
    return pairs, own.join(classes.select("node", F.col("id").alias("representative")), "node").select(F.col("id").alias("doc_id"), "representative")


def near_duplicates(docs: DataFrame, threshold: float = 0.7, n: int = 3, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = 24, broadcast_bytes: int = BROADCAST_BYTES, region_grams: int = REGION_GRAMS, hot_cell: int = HOT_CELL) -> DataFrame:
    """(doc_id, class_id, links): one row for each document that has a near copy.

    ``links`` is the number of other documents whose word n-gram sets have a
    Jaccard similarity of at least ``threshold`` with its own, every one of
    them counted; ``class_id`` the smallest id that such links, one after
    another, lead to.

    Words are lower-cased; a text of fewer than n words has one gram, all its
    words. Texts without words, null texts and null ids have no link. Ties at
    the threshold are links. Of rows that repeat an id, the one with the
    largest set counts. Texts of any length are read whole. An empty table
    gives no rows; other columns are ignored. N-grams are told apart by 48
    bits of their hash, sets by 64 bits of theirs: different sets with one
    name, of odds 1 to 2**64 a pair, would pass for copies. The routing table
    is broadcast up to ``broadcast_bytes`` and joined by a shuffle beyond.
    """
    own, classes, links = _joined(docs, threshold, n, id_col, text_col, "links", sketch_bits, broadcast_bytes, region_grams, hot_cell)
    links = cut(links)
    roots = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("class_id"))
    degree = links.groupBy("id").agg(F.sum("links").alias("links"))
    rows = classes.join(degree, "id", "left").join(roots, "id", "left").where("copies > 1 OR links > 0")
    rows = cut(rows.select("node", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return own.join(small(rows, 24, broadcast_bytes), "node").select(F.col("id").alias("doc_id"), "class_id", "links")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.7, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, with one document, the smallest id, of each class of ``near_duplicates``.

    Documents without words, and null ids, stay.
    """
    gone = cut(near_duplicates(docs, threshold, n, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")))
    return docs.join(small(gone, 8), docs[id_col].cast("long") == gone["__gone"], "left_anti")
