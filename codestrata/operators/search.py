"""Search over chunks: vector, text and fused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata import schemas
from codestrata.functions.vectors import with_scores


def vector_search(chunks: DataFrame, query: list[float], limit: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """The ``limit`` chunks most similar to a query vector, with ``score``; ties by key. Planned as a bounded heap in each task."""
    return with_scores(chunks, query, vector).orderBy(F.desc("score"), key).limit(limit)


def query_words(query: str) -> list[str]:
    """Lower-cased words of at least two bytes; repeated words stay."""
    return [w for w in query.lower().split() if len(w.encode()) >= 2]


def text_scores(chunks: DataFrame, query: str, text: str = "content") -> DataFrame:
    """Chunks that contain a word of the query, with ``score``: the share of words contained, and a half if all of it is."""
    words, low = query_words(query), F.lower(F.col(text))
    if not words:
        return chunks.withColumn("score", F.lit(0.0)).where(F.lit(False))
    matched = reduce(lambda a, b: a + b, (F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words))
    score = matched / F.lit(float(len(words))) + F.when(F.contains(low, F.lit(query.lower())), 0.5).otherwise(0.0)
    return chunks.where(matched > 0).withColumn("score", score)


def text_search(chunks: DataFrame, query: str, limit: int, key: str = "id", text: str = "content") -> DataFrame:
    return text_scores(chunks, query, text).orderBy(F.desc("score"), key).limit(limit)


def ranked(results: DataFrame, key: str = "id") -> DataFrame:
    """(key, rank): 0-based ranks of a list of results; the list is a top-k, so one task ranks it."""
    return results.select(key, (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], limit: int, k: float = schemas.RRF_K, key: str = "id") -> DataFrame:
    """(key, score): keys of all lists by the sum of 1 / (k + rank + 1), the best ``limit``; ties by key."""
    every = reduce(DataFrame.unionByName, [ranked(r, key) for r in lists])
    fused = every.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank") + 1)).alias("score"))
    return fused.orderBy(F.desc("score"), key).limit(limit)


def hybrid_search(chunks: DataFrame, query: str, vector: list[float], limit: int, k: float = schemas.RRF_K, key: str = "id") -> DataFrame:
    """The fused best of the vector and the text search, each asked for twice the limit."""
    lists = [vector_search(chunks, vector, 2 * limit, key), text_search(chunks, query, 2 * limit, key)]
    return reciprocal_rank_fusion(lists, limit, k, key)


def smart_search(chunks: DataFrame, query: str, vector: list[float], limit: int, hybrid: bool = True, key: str = "id", k: float = schemas.RRF_K) -> DataFrame:
    """(key, score) of the fused search, or of the vector search alone."""
    if hybrid:
        return hybrid_search(chunks, query, vector, limit, k, key)
    return vector_search(chunks, vector, limit, key).select(key, "score")
