"""Mixing sources to target weights by hierarchical budgeting.

The leaves are (domain, language, source). A token budget is split top down
by weight; what a child can't use of its share goes to its siblings, and only
what all of them can't use to their parent's siblings. Each leaf then passes
over its documents in seeded orders, whole epochs first and of the last one
the prefix that fits its budget.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, cut, small

BINS = 4096
#: Leaves whose budgets the driver works out; a table with more of them is refused.
MAX_LEAVES = 1_000_000


@dataclass(frozen=True)
class Mix:
    """Weights of the tree's nodes; what isn't named has weight 1.

    ``domains`` maps a source to its domain, others belong to ``other``.
    ``budget`` is in tokens, or where it is None ``share`` of all tokens there
    are. A document is used in at most ``epochs`` epochs.
    """

    domains: Mapping[str, str] = field(default_factory=dict)
    domain_weights: Mapping[str, float] = field(default_factory=dict)
    lang_weights: Mapping[str, float] = field(default_factory=dict)
    source_weights: Mapping[str, float] = field(default_factory=dict)
    budget: int | None = None
    share: float = 1.0
    epochs: int = 2
    seed: int = 17
    other: str = "other"


def water_fill(budget: float, children: list[tuple[object, float, float]]) -> dict[object, float]:
    """Splits a budget over (name, weight, capacity) by weight, never above a capacity.

    What a full child leaves over is split again among the others.
    """
    out = {name: 0.0 for name, _, _ in children}
    open_ = [c for c in children if c[1] > 0 and c[2] > 0]
    left = min(budget, sum(c[2] for c in open_))
    while open_ and left > 1e-9:
        total = sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] <= left * c[1] / total]
        if not full:
            out.update({n: left * w / total for n, w, _ in open_})
            break
        for n, _, cap in full:
            out[n] = cap
            left -= cap
        names = {c[0] for c in full}
        open_ = [c for c in open_ if c[0] not in names]
    return out


def leaf_budgets(supply: Mapping[tuple[str, str, str], int], mix: Mix) -> dict[tuple[str, str, str], int]:
    """Tokens for each leaf, given the tokens it has."""
    levels = (mix.domain_weights, mix.lang_weights, mix.source_weights)
    total = sum(supply.values())

    def down(prefix: tuple[str, ...], budget: float) -> dict:
        depth = len(prefix)
        if depth == 3:
            return {prefix: math.floor(budget + 1e-6)}
        caps: dict[str, float] = {}
        for leaf, tokens in supply.items():
            if leaf[:depth] == prefix:
                open_ = all(levels[d].get(leaf[d], 1.0) > 0 for d in range(depth, 3))
                caps[leaf[depth]] = caps.get(leaf[depth], 0.0) + (tokens * mix.epochs if open_ else 0)
        parts = water_fill(budget, [(name, levels[depth].get(name, 1.0), cap) for name, cap in sorted(caps.items())])
        return {k: v for name, part in parts.items() for k, v in down((*prefix, name), part).items()}

    return down((), mix.share * total if mix.budget is None else mix.budget) if supply else {}


def _leaves(docs: DataFrame, mix: Mix, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(row, id, text, domain, lang, source): the rows whole, so that no name of theirs clashes."""
    source = F.coalesce(F.col(source_col), F.lit(""))
    domain = F.lit(mix.other)
    for name in sorted(set(mix.domains.values())):
        domain = F.when(source.isin([s for s, d in mix.domains.items() if d == name]), F.lit(name)).otherwise(domain)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), domain.alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), source.alias("source"))
    return rows.where("id IS NOT NULL")


def token_count(text) -> F.Column:
    """Runs of anything but white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


LEAF = ["domain", "lang", "source"]


def mixed(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, epoch, domain, lang, source): the rows of docs, each whole as a struct, once for each epoch that uses them.

    A null language or source is the leaf "". Rows with a null id are left
    out; rows that repeat an id are used alike, as long as the first of them
    in order of tokens fits. Documents without tokens cost
    nothing and come with the epoch that reaches them. The prefix ends before
    the first document that doesn't fit. Texts of any length are counted
    whole. An empty table gives no rows, and a name of docs may be any. More
    than MAX_LEAVES leaves are an error; plans and chosen ids are broadcast up
    to ``broadcast_bytes`` and joined by a shuffle beyond. Only the order inside one of the
    4096 bins of a leaf's last epoch needs sorting; all other rows are decided
    where they are read, so no text is shuffled.
    """
    spark = docs.sparkSession
    rows = _leaves(docs, mix, id_col, text_col, lang_col, source_col)
    light = cut(rows.select("id", *LEAF, token_count(F.col("text")).alias("n")))
    leaves = cut(light.groupBy(*LEAF).agg(F.sum("n").alias("n")))
    if leaves.count() > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves of domain, language and source")
    supply = {tuple(r[:3]): r[3] for r in leaves.collect()}
    plan = []
    for leaf, budget in leaf_budgets(supply, mix).items():
        # A leaf without tokens is used whole once, as it costs nothing.
        full = min(mix.epochs, budget // supply[leaf]) if supply[leaf] else 1
        plan.append((*leaf, int(full), int(budget - full * supply[leaf]) if full < mix.epochs and supply[leaf] else -1))
    names = T.StructType([T.StructField(c, T.StringType()) for c in LEAF] + [T.StructField("full", T.IntegerType()), T.StructField("rest", T.LongType())])
    width = max((sum(len(x.encode()) for x in p[:3]) + 64 for p in plan), default=64)
    plans = small(spark.createDataFrame(plan, names), width, broadcast_bytes)
    key = F.xxhash64(F.lit(mix.seed), F.col("full"), F.col("id"))
    bin_of = F.pmod(F.shiftrightunsigned("key", 52), F.lit(BINS)).cast("int").alias("bin")
    binned = light.join(plans, LEAF).withColumn("key", key).select("*", bin_of)
    totals = binned.groupBy(*LEAF, "bin", "rest").agg(F.sum("n").alias("sum"))
    totals = totals.withColumn("before", F.sum("sum").over(Window.partitionBy(*LEAF).orderBy("bin")) - F.col("sum"))
    edge = cut(totals.where("before <= rest AND before + sum > rest").select(*LEAF, "bin", "before"))
    order = Window.partitionBy(*LEAF).orderBy(F.shiftrightunsigned("key", 1), "id", "n")
    inside = binned.join(small(edge, width, broadcast_bytes), [*LEAF, "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = small(cut(inside.where("upto <= rest").select(F.col("id").alias("chosen")).distinct()), 8, broadcast_bytes)
    edges = small(edge.select(*LEAF, F.col("bin").alias("edge")), width, broadcast_bytes)
    out = rows.join(plans, LEAF).join(edges, LEAF, "left").withColumn("key", key).select("*", bin_of)
    out = out.join(chosen, out["id"] == chosen["chosen"], "left")
    partial = (F.col("rest") >= 0) & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & F.col("chosen").isNotNull()))
    out = out.withColumn("used", F.col("full") + partial.cast("int")).where("used > 0")
    return out.select("row", F.explode(F.sequence(F.lit(0), F.col("used") - 1)).alias("epoch"), *LEAF)
