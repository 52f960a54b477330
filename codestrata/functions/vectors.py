"""Similarity of vectors: exact expressions for single queries, blocks of matrix products for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 for null and empty vectors, different lengths, zero norms and numbers that aren't finite."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    zero = F.lit(0.0)

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), zero, lambda s, v: s + v)

    fits = (F.size(x) == F.size(y)) & (F.size(x) > 0)
    value = F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    return F.when(fits & ~F.isnan(value) & value.isNotNull() & (F.abs(value) < float("inf")), value).otherwise(zero)


def with_scores(vectors: DataFrame, query: list[float], column: str = "vector", score: str = "score") -> DataFrame:
    """``vectors`` with their cosine to one query, by blocks of matrix products; vectors that don't fit, are zero or aren't finite score 0."""
    q = np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch))
            fits = [i for i, v in enumerate(batch) if v is not None and len(v) == len(q) and len(q)]
            if fits and norm > 0:
                x = np.array([batch.iloc[i] for i in fits], dtype=np.float64)
                norms = np.sqrt(np.einsum("ij,ij->i", x, x))
                with np.errstate(divide="ignore", invalid="ignore"):
                    values = (x @ q) / (norms * norm)
                out[fits] = np.where(np.isfinite(values), values, 0.0)
            yield pd.Series(out)

    return vectors.withColumn(score, scores(F.col(column)))
