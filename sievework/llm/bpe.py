"""Byte-pair encoding and decoding with a pair occurrence index.

A partition's texts are cut into pieces by the tokenizer's own pattern, its
distinct pieces laid out as one linked row of symbols, and every mergeable
pair mapped to all its positions there. Ranks are applied in ascending order:
each merges all its positions at once and enters the pairs that arise beside
them into their own lists. Each piece is so encoded once for a partition.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as G
from .common import frugal, ragged, tokenizer_dir

U64 = np.uint64
VOCABULARY = "byte_bpe_50k.tiktoken"
ROWS_OUT = 1_000
BLOCK = 1 << 18
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Class of each code point, as the pattern's \\s, \\p{L} and \\p{N} see it."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if a < 0xD800 < b:
                out[a:0xD800] = kind
                a = 0xE000
            out[a : b + 1] = kind
    return out


class Vocabulary:
    """Ranks of a public byte-level vocabulary and its table of mergeable pairs.

    A pair of tokens merges where its bytes are a token; its rank is that
    token's id.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            entries = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in entries}
        self.size = max(self.ranks.values()) + 1
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, to = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    to.append(rank)
        o = np.argsort(np.array(keys, np.uint64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.uint64)[o], np.array(to, np.int32)[o]
        names = [b""] * self.size
        for token, rank in self.ranks.items():
            names[rank] = token
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        self.classes = _classes()
        # Pairs are looked up in an open table of two slots a key.
        bits = 1
        while 1 << bits < 4 * len(keys):
            bits += 1
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.slots, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        pending = np.arange(len(self.pair_keys))
        at = self._slot(self.pair_keys)
        while len(pending):
            free = self.values[at[pending]] < 0
            _, first = np.unique(at[pending[free]], return_index=True)
            placed = pending[free][first]
            self.slots[at[placed]], self.values[at[placed]] = self.pair_keys[placed], self.pair_ranks[placed]
            pending = np.setdiff1d(pending, placed, assume_unique=True)
            at[pending] = (at[pending] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge; looked up in blocks, for memory."""
        if len(left) > BLOCK:
            return np.concatenate([self.pair_rank(left[a : a + BLOCK], right[a : a + BLOCK]) for a in range(0, len(left), BLOCK)])
        keys = (left.astype(np.uint64) << U64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        left_over = np.arange(len(keys))
        while len(left_over):
            a = at[left_over]
            hit = self.slots[a] == keys[left_over]
            out[left_over[hit]] = self.values[a[hit]]
            left_over = left_over[~hit & (self.values[a] >= 0)]
            at[left_over] = (at[left_over] + 1) & self.mask
        return out


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def pieces(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and rows of the pieces that the pattern finds in each row, vectorised.

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes[code]
    n = len(code)
    row_first = np.zeros(n + 1, bool)
    begin = offsets[:-1][np.diff(offsets) > 0]
    row_first[np.searchsorted(lead, begin)] = True
    row_first[n] = True
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (kind[1:] != kind[:-1]) | row_first[1:n]
    # The last of a run of white space goes with, or stands before, what follows in the row.
    space = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~row_first[1:n]
    new |= last
    joins = np.zeros(n, bool)
    joins[1:] = last[:-1] & (code[:-1] == 32)
    new &= ~joins
    quote = np.flatnonzero((code == 39) & new)
    if len(quote):
        ends = np.flatnonzero(row_first)
        room = ends[np.searchsorted(ends, quote, "right")] - quote
        at = lambda k: code[np.minimum(quote + k, n - 1)]
        one = (room > 1) & np.isin(at(1), [ord(c) for c in "stmd"])
        two = (room > 2) & (((at(1) == ord("r")) | (at(1) == ord("v"))) & (at(2) == ord("e")) | (at(1) == ord("l")) & (at(2) == ord("l")))
        for hit, k in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            new[q + 1] = False
            after = q + k + 1
            after = after[after < n]
            new[after] = True
            # A space before what follows still joins it: that start was set above.
    starts = lead[new]
    return starts, np.searchsorted(offsets, starts, "right") - 1


def encode_pieces(data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each piece, and their offsets, by the pair occurrence index."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    symbol = v.of_byte[data]
    following = np.arange(1, n + 1, dtype=np.int32)
    following[offsets[1:][np.diff(offsets) > 0] - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[offsets[:-1][np.diff(offsets) > 0]] = -1
    inside = np.flatnonzero(following >= 0).astype(np.int32)
    rank = v.pair_rank(symbol[inside], symbol[following[inside]])
    inside, rank = inside[rank >= 0], rank[rank >= 0]
    o = np.argsort(rank, kind="stable").astype(np.int32)
    inside, rank = inside[o], rank[o]
    del o
    cuts = np.flatnonzero(np.diff(rank, prepend=-1))
    index: dict[int, list[np.ndarray]] = {int(rank[a]): [inside[a:b]] for a, b in zip(cuts, np.append(cuts[1:], len(rank)))}
    active = list(index)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        nxt = following[at]
        live = (nxt >= 0) & (symbol[at] >= 0)
        at, nxt = at[live], nxt[live]
        live = v.pair_rank(symbol[at], symbol[nxt]) == r
        at, nxt = at[live], nxt[live]
        if len(at) > 1:
            chained = np.flatnonzero(nxt[:-1] == at[1:])
            if len(chained):  # a run of overlapping pairs: every other one merges, from the left
                start = np.ones(len(at), bool)
                start[chained + 1] = False
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                at, nxt = at[place % 2 == 0], nxt[place % 2 == 0]
        if not len(at):
            continue
        after = following[nxt]
        symbol[at], symbol[nxt] = r, -1
        following[at] = after
        has = after >= 0
        before[after[has]] = at[has]
        left = before[at]
        left = left[left >= 0]
        fresh = np.concatenate([left, at[has]])
        ranks = v.pair_rank(symbol[fresh], symbol[following[fresh]])
        ok = ranks >= 0
        fresh, ranks = fresh[ok], ranks[ok]
        if not len(fresh):
            continue
        o = np.argsort(ranks, kind="stable")
        fresh, ranks = fresh[o], ranks[o]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for a, b, q in zip(cuts, [*cuts[1:], len(ranks)], ranks[cuts].tolist()):
            if q in index:
                index[q].append(fresh[a:b])
            else:
                index[q] = [fresh[a:b]]
                heapq.heappush(active, q)
    alive = np.flatnonzero(symbol >= 0)
    return symbol[alive], np.searchsorted(alive, offsets)


def spread(values: np.ndarray, offsets: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``take`` of (values, offsets), and the offsets of the result."""
    length = np.diff(offsets)[take]
    out = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1][take], length)
    return values[at], out


def _encode(path: str, id_kind: str):
    """Encodes a partition: its texts become piece numbers, then its distinct pieces tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        known_hash, known_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        blobs, lengths, held, count = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal known_hash, known_at, blobs, lengths, held, count
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64) if lengths else np.zeros(1, np.int64)
            ids, id_offsets = encode_pieces(np.concatenate(blobs) if blobs else np.zeros(0, np.uint8), offsets, v)
            for keys, nulls, numbers, cuts in held:
                for a in range(0, len(keys), ROWS_OUT):
                    b = min(a + ROWS_OUT, len(keys))
                    tokens, bounds = spread(ids, id_offsets, numbers[cuts[a] : cuts[b]].astype(np.int64))
                    ends = bounds[cuts[a : b + 1] - cuts[a]]
                    lists = ragged(tokens, ends, pa.int32())
                    if nulls[a:b].any():
                        lists = pa.array([None if z else x for x, z in zip(lists.to_pylist(), nulls[a:b])], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], ["doc_id", "tokens"])
            known_hash, known_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            blobs, lengths, held, count = [], [], [], 0

        for batch in batches:
            nulls = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for a, b, data, offsets in G.text_chunks(batch):
                starts, rows = pieces(data, offsets, v.classes)
                ends = np.append(starts[1:], len(data))
                h = G.span_hashes(data, starts, ends)
                distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                at = np.searchsorted(known_hash, distinct)
                old = at < len(known_hash)
                old[old] = known_hash[at[old]] == distinct[old]
                number = np.empty(len(distinct), np.int64)
                number[old] = known_at[at[old]]
                fresh = first[~old]
                number[~old] = len(known_hash) + np.arange(len(fresh))
                if len(fresh):
                    raw, _ = spread(data, np.append(starts, len(data)), fresh)
                    blobs.append(raw)
                    lengths.append(ends[fresh] - starts[fresh])
                    place = at[~old]
                    known_hash, known_at = np.insert(known_hash, place, distinct[~old]), np.insert(known_at, place, number[~old])
                held.append((batch.column(0).slice(a, b - a), nulls[a:b], number[inverse].astype(np.int32), np.searchsorted(rows, np.arange(b - a + 1))))
                count += len(starts)
                if count > 40_000_000:  # some 200 MB of text, for memory
                    yield from flush()
        if held:
            yield from flush()

    return run


def encode(docs: DataFrame, vocabulary_file: str = VOCABULARY, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) of every row: the byte-level BPE ids of its whole text.

    A null text has null tokens, an empty one none. Special tokens have no
    part: their strings are ordinary text. Ids may repeat or be null; other
    columns are ignored; an empty table gives no rows. Equal pieces of a
    partition are encoded once, and known by 64 bits of their hash: two
    different ones with one hash, of odds some 3 in 10**8 among a million
    pieces, would get the same tokens, which ``decode`` would show.
    """
    path = f"{tokenizer_dir(folder)}/{vocabulary_file}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(_encode(path, "long")), "doc_id long, tokens array<int>")


def _decode(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(a, ROWS_OUT)
                lists = part.column(1)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                tokens = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                if len(tokens) and (tokens.min() < 0 or tokens.max() >= v.size):
                    raise ValueError("token ids outside the vocabulary")
                raw, bounds = spread(v.bytes, v.offsets, tokens)
                ends = bounds[offsets - offsets[0]]
                nulls = lists.is_null().to_numpy(zero_copy_only=False)
                valid = pa.array(~nulls) if nulls.any() else None
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
                if valid is not None:
                    texts = pa.compute.if_else(valid, texts, pa.scalar(None, pa.large_binary()))
                own = [(part.column(0), "doc_id"), *([(lists, "tokens")] if keep else []), (texts.cast(pa.binary()), "raw")]
                yield pa.RecordBatch.from_arrays([c for c, _ in own], [n for _, n in own])

    return run


def decode(tokens: DataFrame, vocabulary_file: str = VOCABULARY, folder: str | None = None, keep_tokens: bool = False) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens), or (doc_id, tokens, text). Bytes that are no UTF-8 become U+FFFD; null tokens give a null text."""
    path = f"{tokenizer_dir(folder)}/{vocabulary_file}"
    kept = ["tokens"] if keep_tokens else []
    schema = ", ".join(["doc_id long", *(f"{c} array<int>" for c in kept), "raw binary"])
    raw = tokens.select("doc_id", "tokens").mapInArrow(frugal(_decode(path, keep_tokens)), schema)
    return raw.select("doc_id", *kept, F.decode("raw", "utf-8").alias("text"))
