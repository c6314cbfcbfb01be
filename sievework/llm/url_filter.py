"""URL filters: a sort-merge range join of reversed-host keys with nested rules.

A URL's key is its host's labels in reverse, each ended by a comma, then path
and query: https://b.example.net/fr?x becomes net,example,b,/fr?x. A rule for
a host with its subdomains, or for a path prefix of one host, is a prefix of
keys, so an interval, and intervals of prefixes nest or are apart. A sweep
over sorted keys therefore keeps the active rules on a stack, the most
specific on top.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, frugal, partitions

TOP = "\U0010ffff"


def url_key(url) -> F.Column:
    """Canonical key; null for a null URL and one without scheme and host.

    Scheme, user, port and fragment have no part in it; the host is
    lower-cased and loses dots at its end; an empty path is /.
    """
    whole = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(whole), r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^#]*)", 2)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","), path)
    return F.when(host != "", key)


def rule_prefix(pattern) -> F.Column:
    """Key prefix of a rule: ``host`` with its subdomains, ``host/path...`` of one host alone."""
    host = F.lower(F.regexp_extract(F.trim(pattern), r"^([^/]*)", 1))
    path = F.regexp_extract(F.trim(pattern), r"^[^/]*(/.*)$", 1)
    prefix = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","), path)
    return F.when(host != "", prefix)


class Sweep:
    """Stack of the rules active at the key that the sweep has reached; keys must not decrease."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, str]] = []

    def to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def push(self, prefix: str, rule: int, action: str) -> None:
        self.to(prefix)
        if not self.stack or self.stack[-1][0] != prefix:  # of equal prefixes the first, the smallest id, holds
            self.stack.append((prefix, rule, action))

    def top(self) -> tuple[int | None, str | None]:
        return self.stack[-1][1:] if self.stack else (None, None)


def _sweep_batch(keys: list[str | None], rules: list[tuple[str, int, str]]) -> tuple[list, list]:
    """Rule and action of each key; rules sorted by prefix, then id."""
    n = len(keys)
    ids: list[int | None] = [None] * n
    actions: list[str | None] = [None] * n
    sweep, r = Sweep(), 0
    for i in sorted((i for i in range(n) if keys[i] is not None), key=keys.__getitem__):
        key = keys[i]
        while r < len(rules) and rules[r][0] <= key:
            sweep.push(*rules[r])
            r += 1
        sweep.to(key)
        ids[i], actions[i] = sweep.top()
    return ids, actions


def _local(held):
    """Sorts each batch where it is and sweeps it along the broadcast rules; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = held.value
        for batch in batches:
            ids, actions = _sweep_batch(batch.column(2).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.int64()), pa.array(actions, pa.string())], ["page_id", "url", "key", "rule_id", "action"])

    return run


def _bucketed(bounds, rule: bool):
    """(bucket, key, kind, page_id, url, rule_id, action); a rule goes to every bucket that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bounds.value
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(3)]
            out: list[tuple] = []
            if rule:
                for key, i, action in zip(*cols):
                    out += [(b, key, 0, None, None, i, action) for b in range(bisect.bisect_right(cuts, key), bisect.bisect_right(cuts, key + TOP) + 1)]
            else:
                out = [(bisect.bisect_right(cuts, key), key, 1, i, url, None, None) for i, url, key in zip(*cols)]
            yield pa.RecordBatch.from_pylist([dict(zip(SHAPE.names, x)) for x in out], SHAPE)

    return run


SHAPE = pa.schema([("bucket", pa.int32()), ("key", pa.string()), ("kind", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("rule_id", pa.int64()), ("action", pa.string())])
SHAPE_SQL = "bucket int, key string, kind int, page_id long, url string, rule_id long, action string"
RESULT = "page_id long, url string, key string, rule_id long, action string"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps rows sorted by bucket, key, rules before pages."""
    at, sweep = None, Sweep()
    for batch in batches:
        out = []
        for bucket, key, kind, i, url, rule, action in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                at, sweep = bucket, Sweep()
            if kind == 0:
                sweep.push(key, rule, action)
            else:
                sweep.to(key)
                out.append((i, url, key, *sweep.top()))
        yield pa.RecordBatch.from_pylist([dict(zip(("page_id", "url", "key", "rule_id", "action"), x)) for x in out], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("key", pa.string()), ("rule_id", pa.int64()), ("action", pa.string())]))


def match_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rows: int = 500_000) -> DataFrame:
    """(page_id, url, key, rule_id, action): of each page the most specific rule (rule_id, pattern, action) that holds.

    Without one, and where the URL is null or has no host, rule_id is null and
    the action ``default``. Of rules with one prefix the smallest id holds;
    rules without a pattern, host or id are none. Repeated pages stay
    repeated; other columns are ignored; empty tables are fine. Up to
    ``broadcast_rows`` rules of BROADCAST_BYTES in all, pages are sorted and
    swept where they are read; beyond, pages and rules are range-partitioned
    on the key, the ranges cut by a sample of both, so that the paths of one
    host of very many pages are spread as well.
    """
    spark = pages.sparkSession
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), url_key(F.col(url_col)).alias("key"))
    prefixes = rules.select(rule_prefix(F.col("pattern")).alias("prefix"), F.col("rule_id").cast("long").alias("rule_id"), "action").where("prefix IS NOT NULL AND rule_id IS NOT NULL")
    count, size = prefixes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("prefix") + F.coalesce(F.octet_length("action"), F.lit(0))), F.lit(0))).first()
    if count <= broadcast_rows and size <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast(sorted((tuple(r) for r in prefixes.collect()), key=lambda r: r[:2]))
        out = keyed.mapInArrow(frugal(_local(held)), RESULT)
    else:
        parts = partitions(spark)
        table = cut(prefixes)
        hosts = keyed.where("key IS NOT NULL").select(F.col("key").alias("prefix"))
        share = lambda n: min(1.0, 50 * parts / max(n, 1))
        sample = table.select("prefix").sample(share(count), seed=3).unionByName(hosts.sample(share(pages.count()), seed=3)).distinct().orderBy("prefix").collect()
        bounds = spark.sparkContext.broadcast([r[0] for r in sample[:: max(1, len(sample) // (4 * parts))]])
        hosted = keyed.where("key IS NOT NULL").select("page_id", "url", "key").mapInArrow(frugal(_bucketed(bounds, False)), SHAPE_SQL)
        spread = table.select("prefix", "rule_id", "action").mapInArrow(frugal(_bucketed(bounds, True)), SHAPE_SQL)
        both = hosted.unionByName(spread).repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "kind", "rule_id")
        out = both.mapInArrow(frugal(_merge), RESULT).unionByName(keyed.where("key IS NULL").select("page_id", "url", "key", F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("action")))
    return out.withColumn("action", F.coalesce("action", F.lit(default)))
