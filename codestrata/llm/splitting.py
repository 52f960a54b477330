"""Problem 6: cutting oversized chunks at natural boundaries, with overlap.

Balanced targets: the least number of pieces that can hold the text is
computed, equally spaced cut targets are placed, and each is snapped to the
strongest boundary near it that keeps its piece within the limit. What a snap
gave away or took is shared out equally among the targets after it, and a piece
is added whenever those left can't hold the rest, so one pass cuts any text.
Each piece after the first begins with the end of the one before it, ``overlap``
bytes, or fewer, but at least half, where that lets it begin at the start of a line.

Only the current row of an id is cut. A null content has no pieces; a text
within the limit is one piece; a line longer than the limit is cut inside,
never inside a character. Limits under 8 bytes are 8; an overlap that would
leave a piece less than 8 bytes of its own is cut to what leaves them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.shared import broadcast_if_small, latest

#: Bytes that count as one token; the share of a piece's length within which a boundary may be sought.
BYTES_PER_TOKEN, REACH = 4, 0.25
#: Bytes that a piece has of its own at least: room for a character wherever it begins.
LEAST = 8
#: What a boundary is worth: blank line before a declaration, blank line, end of a block, line end, space, none.
_DECLARATION = re.compile(r"\s{0,4}(?:pub |export |public |private |protected |static |async |final |func |fn |def |class |struct |function |@|///|/\*\*|//|#)")


def boundaries(raw: bytes) -> tuple[list[int], list[int]]:
    """(byte offsets, strengths) of the places where a text can be cut between lines."""
    offsets, strengths, at = [], [], 0
    lines = raw.split(b"\n")
    for k, line in enumerate(lines[:-1]):
        at += len(line) + 1
        following = lines[k + 1].decode("utf-8", "replace")
        blank, closes = not line.strip(), line.strip() in (b"}", b"};", b"end", b"})", b"});")
        shallow = not following[:1].isspace()
        opens = bool(_DECLARATION.match(following))
        strength = 1 + (3 if blank else 0) + (2 if closes else 0) + (2 if opens and (blank or closes) else 0) + (1 if shallow else 0)
        offsets.append(at)
        strengths.append(strength)
    return offsets, strengths


def whole_character(raw: bytes, at: int, low: int) -> int:
    """The last place up to ``at`` that is not inside a character, or the first after it where that isn't over ``low``."""
    back = at
    while 0 < back < len(raw) and raw[back] & 0xC0 == 0x80:
        back -= 1
    if back > low:
        return back
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def snap(raw: bytes, offsets: list[int], strengths: list[int], target: int, low: int, high: int) -> int:
    """The strongest boundary after ``low`` up to ``high``, the nearest to ``target`` among equals; else a space; else the target."""
    a, b = bisect_right(offsets, low), bisect_right(offsets, high)
    if a < b:
        return offsets[max(range(a, b), key=lambda i: (strengths[i], -abs(offsets[i] - target)))]
    space = raw.rfind(b" ", low + 1, min(high, target) + 1)
    return space + 1 if space >= 0 and space + 1 <= high else whole_character(raw, min(target, high), low)


def overlap_start(raw: bytes, offsets: list[int], cut: int, overlap: int, floor: int) -> int:
    """Where the piece that follows ``cut`` begins: the earliest line start, or else character, within ``overlap`` bytes before it.

    A line start that would leave less than half of the overlap isn't taken.
    """
    least = max(cut - overlap, floor)
    i = bisect_left(offsets, least)
    if i < len(offsets) and offsets[i] <= cut - overlap // 2 and offsets[i] < cut:
        return offsets[i]
    at = least
    while at < cut and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def split_spans(raw: bytes, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Byte spans of the pieces of ``raw``, each within ``limit`` bytes and sharing at most ``overlap`` with the one before."""
    limit = max(limit, LEAST)
    overlap = max(0, min(overlap, limit - LEAST))
    offsets, strengths = boundaries(raw) if len(raw) > limit else ([], [])
    spans, start, left = [], 0, -(-(len(raw) - overlap) // (limit - overlap))
    while len(raw) - start > limit:
        left = max(left, -(-(len(raw) - start - overlap) // (limit - overlap)))
        size = (len(raw) - start + (left - 1) * overlap) / left
        low = max(round(start + size * (1 - REACH)), start + overlap + 1)
        high = min(round(start + size * (1 + REACH)), start + limit)
        cut = snap(raw, offsets, strengths, min(round(start + size), high), min(low, high) - 1, high)
        spans.append((start, cut))
        start = overlap_start(raw, offsets, cut, overlap, start + 1)
        left -= 1
    return [*spans, (start, len(raw))]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("id", "piece", "n_pieces", "start_line", "end_line", "shared_bytes", "n_bytes", "content")
    for b in batches:
        out: list[tuple] = []
        for key, code, first, tokens, shared in zip(b["id"], b["code"], b["start_line"], b["max_tokens"], b["overlap_tokens"], strict=True):
            raw = code.encode("utf-8", "surrogatepass")
            spans = split_spans(raw, BYTES_PER_TOKEN * int(tokens), BYTES_PER_TOKEN * int(shared))
            base, before = int(first), 0
            for k, (a, z) in enumerate(spans):
                start = base + raw.count(b"\n", 0, a)
                end = start + raw.count(b"\n", a, z) - (1 if z > a and raw[z - 1 : z] == b"\n" else 0)
                out.append((key, k, len(spans), start, end, max(0, before - a) if k else 0, z - a, raw[a:z].decode("utf-8", "replace")))
                before = z
        yield pd.DataFrame(out, columns=list(names))


def code_of(content: str = "content"):  # noqa: ANN201
    """The code of a chunk: all that follows the first empty line; null without one."""
    at = F.expr(f"locate('\\n\\n', {content})")
    return F.when(at > 0, F.expr(f"substring({content}, locate('\\n\\n', {content}) + 2)"))


def oversized_chunks(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """(id, start_line, max_tokens, overlap_tokens, code): current chunks whose code is over their repository's limit.

    Limits are those of the repository's row, or of row ``*``; sizes are bytes of UTF-8. Only the sizes and
    lines of all rows are shuffled to find the current ones; text moves for rows that are over a limit.
    """
    limits = config.groupBy("repo").agg(F.max(F.struct("max_tokens", "overlap_tokens")).alias("own"))
    default = config.where("repo = '*'").agg(F.max(F.struct("max_tokens", "overlap_tokens")).alias("default"))
    rows = chunks.where("id IS NOT NULL").select("id", "repo", "updated_at", "start_line", code_of().alias("code"))
    sized = rows.join(broadcast_if_small(limits), "repo", "left").join(F.broadcast(default)).withColumn("own", F.coalesce("own", "default"))
    over = F.octet_length("code") > BYTES_PER_TOKEN * F.col("own.max_tokens")
    sized = sized.select("id", "updated_at", F.coalesce("start_line", F.lit(1)).alias("start_line"), "own.max_tokens", "own.overlap_tokens", F.when(over, F.col("code")).alias("code"), F.xxhash64("repo", "code").alias("version"))
    current = latest(sized, "id", ["updated_at", "version"], ["start_line", "max_tokens", "overlap_tokens", "code"])
    return current.where("code IS NOT NULL")


def pieces_of(oversized: DataFrame) -> DataFrame:
    """(id, piece, n_pieces, start_line, end_line, shared_bytes, n_bytes, content): the pieces of oversized chunks."""
    schema = "id string, piece int, n_pieces int, start_line int, end_line int, shared_bytes int, n_bytes int, content string"
    return oversized.mapInPandas(_pieces, schema)
