"""Extensions the surveyed application plans: chunks, exact top-k, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Windows of ``size`` characters that share ``overlap`` with the one before; the last ends with the text."""
    step = size - overlap
    n = F.length(text_col)
    count = F.when(n > size, F.ceil((n - overlap) / F.lit(step))).otherwise(F.when(n > 0, 1).otherwise(0)).cast("int")
    at = F.explode(F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count))
    rows = docs.select(*keep, F.col(text_col).alias("__text"), at.alias("chunk_no"))
    return rows.select(*keep, "chunk_no", F.substring(F.col("__text"), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, vec_id, similarity, rank) by exact cosine of queries(query_id, query) with all vectors.

    Queries are broadcast in blocks of about ``block_bytes``, one for few of
    them; of each query no task passes on more than k vectors.
    """
    n, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("query")), F.lit(0))).first()
    blocks = max(1, -(-n * (8 * dim + 32) // block_bytes))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        own = queries.where(block == b) if blocks > 1 else queries
        pairs = vectors.crossJoin(F.broadcast(own)).where(F.col(id_col) != F.col("query_id"))
        scored = pairs.select("query_id", F.col(id_col).alias("vec_id"), cosine(F.col(vector_col), F.col("query")).alias("similarity"))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def with_citations(hits: DataFrame, sources: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Hits with where each came from: sources(id, source, ...)."""
    return hits.join(sources, id_col, "left").withColumn("citation", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("unknown"))))
