"""Exact deduplication by counting quotient filters and byte verification.

Every input partition builds counting quotient filters of its texts'
fingerprints, one per range of quotients; there are as many ranges as the
rows need. Filters of one range are merged by sorted remainders, run by run,
which loses nothing, and yield the fingerprints counted more than once. Only texts with such a fingerprint are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, frugal, partitions, small

U64 = np.uint64
REMAINDER_BITS = 32
#: Fingerprints that one merge takes, about.
RANGE_ROWS = 250_000


class CountingQuotientFilter:
    """Multiset of fingerprints, held as quotient runs of sorted remainders.

    ``occupied`` has a bit for every quotient of the range, ``run_ends`` a bit
    for every slot, the last of each quotient's run being set; slot i holds a
    remainder and its count. A fingerprint is quotient << 32 | remainder, so
    no bit of it is lost.
    """

    def __init__(self, quotients: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.run_ends, self.remainders, self.counts = quotients, run_ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From fingerprints in any order, each counted once or as given."""
        weights = np.ones(len(fingerprints), np.int64) if counts is None else counts.astype(np.int64)
        order = np.argsort(fingerprints, kind="stable")
        return cls.of_sorted(fingerprints[order].astype(np.uint64), weights[order])

    @classmethod
    def of_sorted(cls, values: np.ndarray, weights: np.ndarray) -> CountingQuotientFilter:
        """From ascending fingerprints, which may repeat."""
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        totals = np.add.reduceat(weights, first) if len(first) else np.zeros(0, np.int64)
        values = values[first]
        quotient = values >> U64(REMAINDER_BITS)
        ends = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if len(values) else np.zeros(0, bool)
        return cls(quotient[ends], ends, (values & U64(0xFFFFFFFF)).astype(np.uint32), totals)

    def fingerprints(self) -> np.ndarray:
        run = np.cumsum(self.run_ends) - self.run_ends
        return (self.quotients[run] << U64(REMAINDER_BITS)) | self.remainders.astype(np.uint64)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Union of multisets; counts of equal fingerprints add up.

        Two filters' slots are in one order already: each slot's place in the
        union is its own plus the other's slots before it. Filters are merged
        in pairs, and the pairs again.
        """
        held = list(filters) or [cls.of(np.zeros(0, np.uint64))]
        while len(held) > 1:
            held = [held[k]._with(held[k + 1]) if k + 1 < len(held) else held[k] for k in range(0, len(held), 2)]
        return held[0]

    def _with(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        a, b = self.fingerprints(), other.fingerprints()
        values, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
        theirs = np.searchsorted(a, b) + np.arange(len(b))
        mine = np.ones(len(values), bool)
        mine[theirs] = False
        values[theirs], values[mine], counts[theirs], counts[mine] = b, a, other.counts, self.counts
        return CountingQuotientFilter.of_sorted(values, counts)

    def repeated(self) -> np.ndarray:
        return self.fingerprints()[self.counts > 1]

    def dump(self) -> bytes:
        """Occupied quotients as gaps, run ends as bits, remainders, counts above one."""
        gaps = np.diff(self.quotients, prepend=U64(0)).astype(np.uint64)
        more = np.flatnonzero(self.counts > 1).astype(np.uint32)
        head = np.array([len(self.quotients), len(self.remainders), len(more)], np.uint32)
        return b"".join(x.tobytes() for x in (head, gaps[:1], gaps[1:].astype(np.uint32), np.packbits(self.run_ends), self.remainders, more, self.counts[more]))

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        nq, n, nm = (int(x) for x in np.frombuffer(data, np.uint32, 3))
        at = 12

        def take(dtype: type, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, k, at)
            at += out.nbytes
            return out

        gaps = np.concatenate([take(np.uint64, min(nq, 1)), take(np.uint32, max(nq - 1, 0)).astype(np.uint64)])
        ends = np.unpackbits(take(np.uint8, (n + 7) // 8), count=n).astype(bool) if n else np.zeros(0, bool)
        remainders, counts = take(np.uint32, n), np.ones(n, np.int64)
        more = take(np.uint32, nm)
        counts[more] = take(np.int64, nm)
        return cls(np.cumsum(gaps, dtype=np.uint64), ends, remainders, counts)


def range_bits(rows: int, parts: int) -> int:
    """Leading bits of a fingerprint that name its range: some ranges for each task, of about RANGE_ROWS rows at most."""
    return min(31, max(1, 4 * parts - 1, rows // RANGE_ROWS).bit_length())


def _build(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        values = np.sort(np.concatenate(parts))
        ranges = (values >> U64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
        keys, blobs = [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(values))):
            keys.append(int(ranges[a]))
            blobs.append(CountingQuotientFilter.of_sorted(values[a:b], np.ones(b - a, np.int64)).dump())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["range", "filter"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each range's filters; rows come sorted by range."""
    at, held = None, []

    def out() -> pa.RecordBatch:
        values = CountingQuotientFilter.merge(held).repeated()
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64), pa.int64())], ["fp"])

    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != at and held:
                yield out()
                held = []
            at = key
            held.append(CountingQuotientFilter.load(blob))
    if held:
        yield out()


def repeated_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """64-bit fingerprints (fp) that at least two rows share."""
    prints = docs.select(F.col(text_col).alias("t")).where("t IS NOT NULL").select(F.xxhash64("t").alias("fp"))
    parts = partitions(docs.sparkSession)
    built = prints.mapInArrow(frugal(_build(range_bits(docs.count(), parts))), "range int, filter binary")
    return built.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(frugal(_merge), "fp long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, dup_of): every document whose text, byte for byte, is that of one with a smaller id.

    dup_of is the smallest id with that text. Empty texts are texts, and equal
    to each other; texts of any length are compared whole. Null texts and null
    ids are no one's copy. Rows that repeat both id and text count as one
    document. An empty table gives no rows; other columns are ignored.
    Repeated fingerprints are broadcast up to ``broadcast_bytes`` and joined
    by a shuffle beyond.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("fp", F.xxhash64("text"))
    repeated = small(cut(repeated_fingerprints(docs, text_col)), 8, broadcast_bytes)
    suspects = rows.join(repeated, "fp", "left_semi")
    # min() combines on the map side: a text crosses the shuffle once for a
    # map task, however many of its copies that task has read.
    verified = suspects.groupBy("fp", "text").agg(F.min("doc_id").alias("dup_of"))
    per_print = cut(verified.groupBy("fp").agg(F.count("*").alias("texts"), F.min("dup_of").alias("dup_of")))
    sure = suspects.select("doc_id", "fp").join(per_print.where("texts = 1").select("fp", "dup_of"), "fp")
    clash = cut(per_print.where("texts > 1").select("fp"))
    found = sure.select("doc_id", "dup_of")
    if not clash.isEmpty():  # different texts of one fingerprint: decided by the texts themselves
        both = rows.join(small(clash, 8, broadcast_bytes), "fp", "left_semi")
        found = found.unionByName(both.join(both.groupBy("fp", "text").agg(F.min("doc_id").alias("dup_of")), ["fp", "text"]).select("doc_id", "dup_of"))
    return found.where("doc_id <> dup_of").distinct()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, without those ``exact_duplicates`` names."""
    gone = cut(exact_duplicates(docs, id_col, text_col).select(F.col("doc_id").alias("__gone")))
    return docs.join(small(gone, 8), docs[id_col].cast("long") == gone["__gone"], "left_anti")
