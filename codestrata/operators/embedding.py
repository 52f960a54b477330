"""Embedding of texts in batches by a provider; the provider that needs no service hashes words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that are given to a provider at once.
BATCH = 32


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...
    def dimensions(self) -> int: ...
    def health_check(self) -> None: ...


class HashingEmbedder:
    """Signed counts of hashed words and word pairs, of length 1; equal texts have equal vectors on every machine."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, text: str) -> list[float]:
        words = text.lower().split()
        v = np.zeros(self.width)
        for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
            h = crc32(term.encode("utf-8", "surrogatepass"))
            v[h % self.width] += 1.0 if h >> 31 else -1.0
        norm = np.sqrt(v @ v)
        return (v / norm if norm > 0 else v).tolist()

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def dimensions(self) -> int:
        return self.width

    def health_check(self) -> None:
        """Nothing can be missing."""


class HttpEmbedder:
    """A local embedding service that takes a model's name and texts, as JSON over HTTP."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "nomic-embed-text", width: int = 768, timeout: int = 120):
        self.url, self.model, self.width, self.timeout = url, model, width, timeout

    def _call(self, path: str, body: dict | None = None) -> dict:
        import json
        from urllib.request import Request, urlopen

        data = json.dumps(body).encode() if body is not None else None
        with urlopen(Request(f"{self.url}{path}", data, {"Content-Type": "application/json"}), timeout=self.timeout) as answer:
            return json.load(answer)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return self._call("/api/embed", {"model": self.model, "input": texts})["embeddings"]

    def dimensions(self) -> int:
        return self.width

    def health_check(self) -> None:
        """Raises unless the service lists the model."""
        names = [m["name"] for m in self._call("/api/tags").get("models", [])]
        if not any(n == self.model or n.startswith(f"{self.model}:") for n in names):
            raise RuntimeError(f"the service has no model {self.model}")


def embed_or_error(rows: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """``rows`` with ``vector`` and ``error``: texts that a provider fails on, alone as well as in their batch, have the message of the failure."""

    @F.pandas_udf("struct<vector:array<float>,error:string>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = [None] * len(batch)
            errors: list = [None] * len(batch)
            held = [i for i, t in enumerate(batch) if t is not None]
            for a in range(0, len(held), BATCH):
                part = held[a : a + BATCH]
                try:
                    found = embedder.embed_batch([batch.iloc[i] for i in part])
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} vectors of {len(part)} texts")
                    for i, v in zip(part, found, strict=True):
                        out[i] = v
                except Exception:  # noqa: BLE001 - whatever a provider raises concerns its texts, not the run
                    for i in part:
                        try:
                            out[i] = embedder.embed_batch([batch.iloc[i]])[0]
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"vector": out, "error": errors})

    return rows.withColumn("_embedded", vectors(F.col(text))).select(*rows.columns, "_embedded.vector", "_embedded.error")


def embed(rows: DataFrame, embedder: Embedder, text: str = "content", vector: str = "vector") -> DataFrame:
    """``rows`` with a vector of each text; null texts have null vectors; a text that the provider fails on fails the run."""
    found = embed_or_error(rows, embedder, text)
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("array<float>")).otherwise(F.col("vector"))
    return found.select(*rows.columns, checked.alias(vector))
