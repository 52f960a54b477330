"""Problem 9: mixing sources to target shares of tokens.

Records get hash-random keys; within each source they are sorted by key, in
ranges of the key, prefix sums of their tokens are computed over the ranges,
and the source is cut at its budget. A budget beyond a source's size is whole
epochs plus a cut, never more than ``max_repeats`` uses of a text.

Sources are compared trimmed and in lower case. Documents with a null, blank or
unlisted source take no part and are reported under ``(none)``; null and empty
texts have no tokens and are left out; a text that is posted several times is
one text, counted for the source of its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.tokens import VOCABULARY, encoding
from codestrata.shared import broadcast_if_small, keep

#: Rows that a range of keys holds about: the largest source decides how many ranges there are.
RANGE_ROWS = 4096
NOWHERE = "(none)"


def canonical_source(column: str = "source"):  # noqa: ANN201
    name = F.lower(F.trim(F.col(column)))
    return F.when(name == "", None).otherwise(name)


def token_counts(texts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row of (doc_id, source, text) as (doc_id, source, digest, n_tokens); the text stays in its task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(vocabulary)
        for b in batches:
            sizes = [len(own.encode_ordinary(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "digest": b["digest"], "n_tokens": sizes})

    return texts.select("doc_id", "source", "text", "digest").mapInPandas(rows, "doc_id bigint, source string, digest string, n_tokens bigint")


def sized_texts(documents: DataFrame, **options: str) -> DataFrame:
    """(doc_id, source, n_tokens): distinct texts with canonical source and size, one row per text."""
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    texts = texts.select("doc_id", F.coalesce(canonical_source(), F.lit(NOWHERE)).alias("source"), "text", F.sha2("text", 256).alias("digest"))
    counted = token_counts(texts, **options)
    first = F.min(F.struct("doc_id", "source", "n_tokens")).alias("first")
    return counted.groupBy("digest").agg(first).select("first.*").where("n_tokens > 0")


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget) of every target source.

    Without ``total_tokens`` the mixture is the largest in which every source meets its share within its repeats.
    """
    available = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    wanted = targets.select(canonical_source().alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    wanted = wanted.join(available, "source", "left").fillna(0, ["available"])
    if total_tokens is None:
        limit = F.when((F.col("target_share") > 0) & (F.col("available") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
        total = F.min(limit).over(Window.partitionBy())
    else:
        total = F.lit(float(total_tokens))
    budget = F.least(F.floor(total * F.col("target_share")), F.col("available") * F.col("max_repeats")).cast("bigint")
    return wanted.withColumn("budget", budget)


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, **options: str) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    chosen: (doc_id, source, n_tokens, copies) of every text that is used; copies is at most the source's max_repeats.
    report: (source, target_share, max_repeats, available, budget, used_tokens, n_texts, actual_share) of every source.

    The keys are uniform, so ranges of the key are of equal size whatever the skew of sources: as many as give
    the largest source about RANGE_ROWS rows in each. Only (source, range) totals are brought together for the prefix sums.
    """
    sized = keep(sized_texts(documents, **options), "sized")
    plan = keep(budgets(sized, targets, total_tokens), "budgets")
    key = F.xxhash64(F.lit(seed), "doc_id")
    rows = sized.join(broadcast_if_small(plan.select("source", "available", "budget", "max_repeats")), "source").withColumn("key", key)
    largest = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, (largest // RANGE_ROWS).bit_length())
    rows = rows.withColumn("range", F.shiftright("key", 64 - bits).cast("int") if bits else F.lit(0))
    totals = rows.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "range", F.coalesce(F.sum("range_tokens").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("through", F.sum("n_tokens").over(inside)).join(broadcast_if_small(offsets), ["source", "range"])
    through = F.col("offset") + F.col("through")
    epochs = F.floor(F.col("budget") / F.col("available"))
    rest = F.col("budget") - epochs * F.col("available")
    copies = F.least(epochs + F.when(through <= rest, 1).otherwise(0), F.col("max_repeats")).cast("int")
    chosen = keep(summed.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0"), "mixture")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("n_texts"))
    unlisted = sized.join(plan, "source", "left_anti").groupBy(F.lit(NOWHERE).alias("source")).agg(F.sum("n_tokens").alias("available"))
    unlisted = unlisted.select("source", F.lit(0.0).alias("target_share"), F.lit(0).alias("max_repeats"), "available", F.lit(0).cast("bigint").alias("budget"))
    listed = plan.unionByName(unlisted).join(used, "source", "left").fillna(0, ["used_tokens", "n_texts"])
    share = F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy())
    return chosen, listed.withColumn("actual_share", F.round(F.coalesce(share, F.lit(0.0)), 6))
