"""Cutting files into chunks, by symbols and by windows of lines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import schemas

#: Bytes of a token, bytes of a line that an overlap is counted in.
TOKEN_BYTES, LINE_BYTES = 4, 80


@dataclass(frozen=True)
class ChunkSizes:
    max_bytes: int = 512 * TOKEN_BYTES
    overlap_bytes: int = 50 * TOKEN_BYTES

    @staticmethod
    def from_tokens(max_tokens: int, overlap_tokens: int) -> ChunkSizes:
        return ChunkSizes(max_tokens * TOKEN_BYTES, overlap_tokens * TOKEN_BYTES)


def text_lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def windows(sizes: list[int], limit: int, overlap_bytes: int) -> Iterator[tuple[int, int]]:
    """0-based half-open line ranges: lines are added while the bytes so far are under the limit, so the last may pass it.

    The next window steps back by the overlap's lines, but always by at least one line forward; the end of the file ends it.
    """
    back, start, n = overlap_bytes // LINE_BYTES, 0, len(sizes)
    while start < n:
        total, end = 0, start
        while end < n and total < limit:
            total += sizes[end] + 1
            end += 1
        yield start, end
        if end >= n:
            return
        start = max(end - back, start + 1)


def hash16(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


_NAMES = ["id", "file_path", "start_line", "end_line", "content", "hash", "chunk_type"]


def window_rows(path: str, lines: list[str], sizes: ChunkSizes, tag: str = "block", first: int = 1, kind: str = "Block") -> list[tuple]:
    """Chunks of the windows of some lines, of which the first is line ``first`` of the file; blank windows are left out."""
    rows = []
    for a, b in windows([len(x.encode("utf-8", "surrogatepass")) for x in lines], sizes.max_bytes, sizes.overlap_bytes):
        body = "\n".join(lines[a:b])
        if body.strip():
            start, end = first + a, first + b - 1
            rows.append((f"{path}:{tag}:{start}", path, start, end, f"File: {path}\nLines: {start}-{end}\n\n{body}", hash16(body), kind))
    return rows


def symbol_rows(path: str, lines: list[str], symbols: list, sizes: ChunkSizes) -> list[tuple]:
    """Chunks of functions, methods, classes and structs; larger ones in windows; a file without any in windows."""
    rows: list[tuple] = []
    for s in symbols:
        kind = schemas.CHUNK_TYPES.get(s["kind"])
        if kind is None or s["start"] is None or s["end"] is None:
            continue
        start, end = max(1, s["start"]), min(s["end"], len(lines))
        part = lines[start - 1 : end]
        body = "\n".join(part)
        if not body.strip():
            continue
        if len(body.encode("utf-8", "surrogatepass")) <= sizes.max_bytes:
            head = f"File: {path}\nSymbol: {s['name']}\nLines: {start}-{end}\n\n"
            rows.append((f"{path}:{s['name']}:{start}", path, start, end, head + body, hash16(body), kind))
        else:
            rows += window_rows(path, part, sizes, "split", start, kind)
    return rows or window_rows(path, lines, sizes)


def chunk_by_window(files: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """Window chunks of (relative_path, content); null and empty contents have none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for p, t in zip(b["relative_path"], b["content"], strict=True) if t for r in window_rows(p, text_lines(t), sizes)]
            yield pd.DataFrame(out, columns=_NAMES)

    return files.where("relative_path IS NOT NULL").select("relative_path", "content").mapInPandas(rows, schemas.CHUNKS)


def chunk_by_symbols(files: DataFrame, symbols: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """Chunks of the symbols of each file; files without any chunk are cut in windows. One shuffle by path."""
    part = F.struct(F.col("line_range.start").alias("start"), F.col("line_range.end").alias("end"), "kind", "name")
    grouped = symbols.where("file_path IS NOT NULL").groupBy(F.col("file_path").alias("relative_path")).agg(F.sort_array(F.collect_set(part)).alias("symbols"))
    joined = files.where("relative_path IS NOT NULL").select("relative_path", "content").join(grouped, "relative_path", "left")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for path, text, listed in zip(b["relative_path"], b["content"], b["symbols"], strict=True):
                if text:
                    out += symbol_rows(path, text_lines(text), listed if listed is not None else [], sizes)
            yield pd.DataFrame(out, columns=_NAMES)

    return joined.mapInPandas(rows, schemas.CHUNKS)
