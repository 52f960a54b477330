"""Comment markers, extracted by regular expressions in one pass over each text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import schemas
from codestrata.functions.text import marker_dimension, rank_of

#: Fixed values: (name, pattern, message for an empty one) of each pass, in order; group 1 is the keyword, group 2 the message.
PASSES = (
    ("annotation", r"(?://|#|/\*+|\*)\s*\b(TODO|FIXME|XXX|BUG|HACK|WARNING|NOTE|WARN)\b[:\s]*(.*)", None),
    ("safety", r"(?://|#|/\*+|\*)\s*\b(SAFETY|INVARIANT|GUARANTEES?)\b[:\s]*(.*)", None),
    ("rule", r"^\s*(?://|#|/\*+|\*)\s*\b(RULE|POLICY|ACCORDING\s+TO)[:!]?\s+(.+)", None),
    ("deprecated", r"(?://|#|/\*+|\*)\s*\b(DEPRECATED|@deprecated)\b[:\s]*(.*)", "Deprecated"),
)
#: Kind of a keyword; every other keyword of the rule pass is a business rule.
KINDS = {
    "TODO": "Todo", "FIXME": "Fixme", "XXX": "Fixme", "BUG": "Fixme", "HACK": "Hack", "WARNING": "Warning", "WARN": "Warning", "NOTE": "Note",
    "SAFETY": "Safety", "INVARIANT": "Invariant", "GUARANTEE": "Invariant", "GUARANTEES": "Invariant", "DEPRECATED": "Deprecated", "@DEPRECATED": "Deprecated",
}


_COMPILED = tuple(re.compile(pattern, re.I | re.M) for _, pattern, _ in PASSES)
#: A text without any of these words has no marker.
_WORDS = re.compile("|".join((*KINDS, "RULE", "POLICY", "ACCORDING")), re.I)


def markers_of(text: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, content, line, pass, ord) of every marker, pass by pass; ``ord`` counts the matches of a pass."""
    if not _WORDS.search(text):
        return []
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out = []
    for number, ((_, _, empty), pattern) in enumerate(zip(PASSES, _COMPILED, strict=True)):
        for n, m in enumerate(pattern.finditer(text)):
            content = m[2].strip() or empty
            if content:
                kind = KINDS.get(" ".join(m[1].upper().split()), "BusinessRule")
                out.append((kind, content, bisect_right(starts, m.start()), number, n))
    return out


def marker_rows(files: DataFrame, path: str, content: str, *carried: str) -> DataFrame:
    """(source_file, *carried, markers array<struct<kind, content, line_number, pass, ord>>): one row a file, by map tasks alone."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("kind", "content", "line_number", "pass", "ord")
        for b in batches:
            found = [[dict(zip(names, m, strict=True)) for m in markers_of(t)] if t else [] for t in b["_text"]]
            yield b.drop(columns="_text").assign(markers=found)

    picked = files.where(F.col(path).isNotNull()).select(F.col(path).alias("source_file"), *carried, F.col(content).alias("_text"))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name != "_text"]
    item = "struct<kind:string,content:string,line_number:int,pass:int,ord:int>"
    return picked.mapInPandas(rows, ", ".join([*columns, f"markers array<{item}>"]))


def unfolded(rows: DataFrame) -> DataFrame:
    """(kind, content, source_file, line_number, priority, pass, ord) of rows of marker_rows."""
    found = rows.select("source_file", F.inline("markers"))
    return found.select("kind", "content", "source_file", "line_number", marker_dimension("kind", "priority").alias("priority"), "pass", "ord")


def extract_markers(files: DataFrame, path: str = "relative_path", content: str = "content") -> DataFrame:
    """(kind, content, source_file, line_number, priority, pass, ord): markers of all passes; one comment may be found by several.

    Null paths and null or empty contents have no markers. Order within a file is (line_number, pass, ord).
    """
    return unfolded(marker_rows(files, path, content))


def summary_by_category(markers: DataFrame) -> DataFrame:
    """(category, total, high, medium, low, ord) in the fixed order of categories."""
    category = marker_dimension("kind", "category")
    counts = markers.groupBy(category.alias("category")).agg(
        F.count("*").alias("total"), *(F.count_if(F.col("priority") == p).alias(p.lower()) for p in schemas.PRIORITY_RANK)
    )
    return counts.withColumn("ord", rank_of("category", schemas.CATEGORY_ORDER))


def critical_files(markers: DataFrame) -> DataFrame:
    """(source_file, n): files with high-priority markers, most first, ties by path."""
    high = markers.where("priority = 'High'").groupBy("source_file").agg(F.count("*").alias("n"))
    return high.orderBy(F.desc("n"), "source_file")


def detail_order(markers: DataFrame) -> DataFrame:
    """Markers by priority, file, line and content."""
    return markers.orderBy(rank_of("priority", tuple(schemas.PRIORITY_RANK)), "source_file", "line_number", "content")
