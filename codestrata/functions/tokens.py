"""Exact token counts by a public byte-pair vocabulary; ``token_estimate`` needs none."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A file of ranks, and how texts are cut before merging (letters, numbers, other marks, white space).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of each text, null for null. Every executor needs the vocabulary; where it is absent the task fails."""

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(path)
        for b in batches:
            yield pd.Series([None if t is None else len(own.encode_ordinary(t)) for t in b], dtype="Int64")

    return counted(text)
