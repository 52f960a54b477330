"""Problem 1: generated, minified, vendored and data files among source files.

Generated, minified, bundled and data files, and files in folders for other
people's packages, are found from a file's own path and content. Copies are
found from the whole collection, by winnowing two normalized token streams:

* the code, in which strings and numbers are alike. A file is a copy if its
  fingerprints mostly recur in many repositories, or if a few other repositories
  each hold one file with mostly the same fingerprints: those of idioms and
  shared functions recur too, but not together and in files of the same extent.
* the lines of the first comment that name a version or revision, in which
  versions, and the words that they belong to, are alike. What a packager writes
  at the head of a copied file says the same in unrelated repositories, whatever
  it says and whatever is copied; a repository's own notice names no version.

Nulls, empty and very long texts: a null or empty content has no finding from
content; a null path is dropped (it can't be listed); of several versions of a
path the newest mtime counts, null being oldest, and equal versions are one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.codelex import FAMILIES, family
from codestrata.shared import keep, latest

#: Winnowing of code: tokens of a fingerprint, fingerprints of a window, share of a file that must recur; a fingerprint of
#: more than REPOS repositories is common by itself, others count where COPIES other repositories hold them in one file each.
K, WINDOW, SHARE, REPOS, COPIES = 16, 12, 0.8, 12, 2
#: Winnowing of head lines: words of a fingerprint (each is kept), repositories that must hold it, share that must recur.
HEAD_K, HEAD_REPOS, HEAD_SHARE = 3, 3, 0.5

#: Folders that hold other people's packages, and output of tools.
VENDOR_DIRS = {"vendor", "third_party", "third-party", "deps", "external", "extern", "pods", "node_modules", "bower_components"}
TOOL_DIRS = {"gen", "generated", "__generated__"}
#: File names that generators and bundlers give.
TOOL_NAME = re.compile(
    r"(?:[._]generated\.\w+|\.gen\.\w+|\.g\.\w+|_pb2(?:_grpc)?\.pyi?|[._]pb(?:\.gw)?\.\w+|\.pb-c\.[ch]|_pb\.\w+|_grpc\.pb\.\w+"
    r"|\.pb\.(?:gw\.)?\w+|OuterClass\.java|\.tab\.[ch]|\.designer\.cs)$",
    re.I,
)
BUNDLE_NAME = re.compile(r"(?:[._]min\.(?:[mc]?js|css|jsx?)|\.bundle\.(?:[mc]?js|css))$", re.I)
#: How the first comment of a generated file begins.
TOOL_HEADER = re.compile(
    r"(?:@generated\b|<auto-?generated|(?:this (?:file|code|module|source) (?:was|is|has been) )?(?:auto(?:matically)?|machine)[- ]?"
    r"(?:generated|written|produced)\b(?!\s+stub)|code generated\b|generated (?:by|from|with|using)\b"
    r"|(?:please )?do not (?:edit|modify)\b|source: \S+\.(?:proto|idl|grammar|tmpl|schema\.json)$)",
    re.I,
)
#: A version of at least two numbers, or a revision.
VERSION = re.compile(r"(?<![\w.])v?\d+(?:\.\d+)+\b|(?<![\w.])(?=[0-9a-f]*\d)[0-9a-f]{7,40}\b")
#: Versions of licences, which every repository's own notice may name.
LICENCE = re.compile(r"\blicen[cs]es?\W+(?:version\W+)?v?\d+(?:\.\d+)*|\b(?:[al]?gpl|mpl|apache|cc)\W*v?\d+(?:\.\d+)*", re.I)
_MARKS = re.compile(r"^(?:/\*+!?|\*+/?|//+!?|#+!?|--|;+|<!--|\"\"\"|''')\s*|\s*(?:\*/|-->)$")
_DATA = re.compile(
    r"0x[0-9a-f]+[uUlL]*\s*,?\s*|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?[fFuUlL]*\s*,\s*|\"[A-Za-z0-9+/=\\x]{40,}\"\s*[,+]?\s*"
    r"|'[A-Za-z0-9+/=\\x]{40,}'\s*[,+.]?\s*|(?:\\x[0-9a-f]{2}){8,}",
    re.I,
)
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\s\w]")


def head_comment(text: str) -> list[str]:
    """Lines of the comments before the first line of code, without comment marks."""
    found, block = [], False
    for line in text.lstrip("\ufeff").split("\n"):
        s = line.strip()
        if not s or s.startswith(("#!", "<?php", "#include", "'use strict'", '"use strict"')):
            continue
        if not (block or re.match(r"//|#(?!\[|define|if|pragma)|/\*|\*|--|<!--|;;", s)):
            break
        block = (block or s.startswith("/*")) and "*/" not in s
        found.append(_MARKS.sub("", _MARKS.sub("", s)).strip())
    return found


def minified(text: str) -> bool:
    """Whether most bytes lie on long lines of code without white space."""
    long_lines = [x for x in text.split("\n") if len(x) >= 120]
    size = sum(map(len, long_lines))
    if size < 0.6 * max(1, len(text)):
        return False
    joined = "".join(long_lines)
    spaces = sum(joined.count(c) for c in " \t")
    marks = sum(joined.count(c) for c in ";{}()=,&|?:")
    return spaces < 0.09 * size and marks > 0.12 * size


def data_blob(text: str) -> bool:
    """Whether most bytes are numbers or encoded strings of a literal table."""
    return len(text) > 200 and sum(len(m) for m in _DATA.findall(text)) > 0.6 * len(text)


def own_findings(path: str, text: str) -> list[str]:
    """Findings from one file's path and content, in a fixed order."""
    *folders, name = path.split("/")
    folders = [x.lower() for x in folders[1:]]
    head = head_comment(text)
    found = []
    if any(x in TOOL_DIRS for x in folders) or TOOL_NAME.search(name) or any(TOOL_HEADER.match(x) for x in head):
        found.append("generated")
    if BUNDLE_NAME.search(name) or minified(text):
        found.append("minified")
    if any(x in VENDOR_DIRS for x in folders):
        found.append("vendored")
    if data_blob(text):
        found.append("data")
    return found


def _hash(word: str) -> int:
    raw = word.encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 32 | zlib.adler32(raw[::-1] + b"~")) * 0x9E3779B97F4A7C15 & (1 << 64) - 1


def grams(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` successive tokens."""
    out = np.zeros(max(0, len(tokens) - k + 1), dtype=np.uint64)
    for i in range(k):
        out += tokens[i : i + len(out)] * np.uint64(pow(0x9E3779B97F4A7C15, k - i, 1 << 64))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def head_words(line: str) -> list[str]:
    """The words of a head line that names a version or revision, each of these as ``#``; none of other lines.

    The word directly before a version, and wherever else it stands, is ``@``: it names what the version is of.
    """
    line = LICENCE.sub(" ", line.lower())
    if not VERSION.search(line):
        return []
    words = re.findall(r"[^\W_]+|#", VERSION.sub(" # ", line))
    named = {a for a, b in zip(words, words[1:], strict=False) if b == "#"} - {"revision", "version", "commit", "#"}
    return ["@" if w in named else w for w in words]


class TokenHashes(dict):
    """Hashes of tokens, odd ones of identifiers; numbers are alike. The first 500,000 tokens are remembered."""

    def __missing__(self, token: str) -> int:
        h = _hash("0" if token[0].isdigit() else token) & ~1 | (token[0].isalpha() or token[0] == "_")
        if len(self) < 500_000:
            self[token] = h
        return h


class Winnower:
    """Fingerprints of token streams; token hashes are kept between files."""

    def __init__(self) -> None:
        self.hashes = TokenHashes()

    def tokens(self, text: str, lexer: str) -> np.ndarray:
        """Hashes of the tokens of code, without comments; strings are alike, so are numbers."""
        bare = FAMILIES[lexer].sub(lambda m: " " if m.lastgroup == "comment" else ' "" ' if m.lastgroup == "string" else m[0], text)
        return np.array(list(map(self.hashes.__getitem__, _TOKEN.findall(bare))), dtype=np.uint64)

    def __call__(self, text: str, lexer: str) -> np.ndarray:
        """Fingerprints of code; grams of literals and marks alone tell nothing and are none."""
        t = self.tokens(text, lexer)
        if len(t) < K:
            return np.empty(0, dtype=np.int64)
        named = np.cumsum(np.concatenate([[0], (t & np.uint64(1)).astype(np.int64)]))
        found = grams(t, K)[named[K:] > named[:-K]]
        if len(found) > WINDOW:
            found = np.lib.stride_tricks.sliding_window_view(found, WINDOW).min(axis=1)
        return np.unique(found).astype(np.int64)

    def heads(self, text: str) -> np.ndarray:
        """Fingerprints of the head lines that name a version."""
        out = [grams(np.array([_hash(w) for w in words], dtype=np.uint64), HEAD_K) for words in map(head_words, head_comment(text)) if words]
        return np.unique(np.concatenate(out)).astype(np.int64) if out else np.empty(0, dtype=np.int64)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    winnow = Winnower()
    for b in batches:
        texts = [t or "" for t in b["content"]]
        yield pd.DataFrame({
            "relative_path": b["relative_path"], "repo": b["repo"], "mtime": b["mtime"], "scanned_at": b["scanned_at"],
            "found": [own_findings(p, t) for p, t in zip(b["relative_path"], texts, strict=True)],
            "prints": [winnow(t, family(lang, p)) for lang, p, t in zip(b["language"], b["relative_path"], texts, strict=True)],
            "heads": [winnow.heads(t) for t in texts],
        })


def copied_heads(newest: DataFrame, share: float = HEAD_SHARE, repos: int = HEAD_REPOS) -> DataFrame:
    """(relative_path, head_recurring): files of whose head fingerprints at least the share recurs in enough repositories."""
    heads = newest.where("size(heads) > 0").select("relative_path", "repo", F.size("heads").alias("size"), F.explode("heads").alias("print"))
    spread = heads.select("print", "repo").distinct().groupBy("print").count().where(F.col("count") >= repos).select("print")
    met = heads.join(spread, "print").groupBy("relative_path").agg((F.count("*") / F.first("size")).alias("head_recurring"))
    return met.where(F.col("head_recurring") >= share)


def copied_files(recurring: DataFrame, sizes: DataFrame, share: float, repos: int, copies: int) -> DataFrame:
    """(relative_path): files that at least ``copies`` other repositories hold too, apart from fingerprints of more than ``repos``.

    ``recurring`` has the fingerprints of more than one repository, ``sizes`` each file's count of fingerprints and
    of common ones. Only files of which the share recurs anywhere are compared: each copy of a file is such.
    """
    rare = recurring.where(F.col("count") <= repos)
    n_rare = rare.groupBy("relative_path").agg(F.count("*").alias("n_rare"))
    alike = sizes.join(n_rare, "relative_path").withColumn("own", F.col("size") - F.col("common")).where(F.col("n_rare") >= F.lit(share) * F.col("own"))
    a = rare.join(alike.select("relative_path", "own"), "relative_path").select("print", "repo", "relative_path", "own")
    b = a.select("print", F.col("repo").alias("other_repo"), F.col("relative_path").alias("other"), F.col("own").alias("other_own"))
    both = a.join(b, "print").where("repo != other_repo").groupBy("relative_path", "own", "other", "other_repo", "other_own").count()
    same = both.where(F.col("count") >= F.lit(share) * F.greatest("own", "other_own"))
    return same.groupBy("relative_path").agg(F.countDistinct("other_repo").alias("n")).where(F.col("n") >= copies).select("relative_path")


def file_origins(files: DataFrame, share: float = SHARE, repos: int = REPOS, copies: int = COPIES) -> DataFrame:
    """(relative_path, repo, found array<string>, recurring double, head_recurring double): one row per path.

    ``found`` is empty for hand-written files. ``recurring`` is the share of the code's fingerprints that more than
    ``repos`` repositories hold; ``head_recurring`` that of the head's that recur, 0 where it is under the least share.
    Shuffles one row of fingerprints per file, then (fingerprint, repository)
    pairs after a partial distinct; only fingerprints that recur in another
    repository are joined back, and files are compared by those only.
    """
    rows = files.where("relative_path IS NOT NULL").select(
        "relative_path", F.coalesce("repo", F.element_at(F.split("relative_path", "/"), 1)).alias("repo"), "language", "content", "mtime", "scanned_at"
    )
    schema = "relative_path string, repo string, mtime timestamp, scanned_at timestamp, found array<string>, prints array<bigint>, heads array<bigint>"
    newest = latest(rows.mapInPandas(_rows, schema), "relative_path", ["mtime", "scanned_at"], ["repo", "found", "prints", "heads"])
    newest = keep(newest, "origin")
    prints = newest.select("relative_path", "repo", F.explode("prints").alias("print"))
    counts = prints.select("print", "repo").distinct().groupBy("print").count().where("count > 1")
    again = keep(prints.join(counts, "print"), "recurring")
    common = again.where(F.col("count") > repos).groupBy("relative_path").agg(F.count("*").alias("n"))
    sizes = newest.select("relative_path", F.size("prints").alias("size")).join(common, "relative_path", "left")
    sizes = sizes.select("relative_path", "size", F.coalesce("n", F.lit(0)).alias("common"))
    copied = copied_files(again, sizes, share, repos, copies).withColumn("copied", F.lit(True))
    recurring = F.when(F.size("prints") > 0, F.coalesce("n", F.lit(0)) / F.size("prints")).otherwise(0.0)
    in_head = F.coalesce("head_recurring", F.lit(0.0))
    vendored = F.when((recurring >= share) | F.col("copied") | (in_head > 0), F.array(F.lit("vendored"))).otherwise(F.array().cast("array<string>"))
    met = newest.join(common, "relative_path", "left").join(copied, "relative_path", "left").join(copied_heads(newest), "relative_path", "left")
    return met.select("relative_path", "repo", F.array_union("found", vendored).alias("found"), recurring.alias("recurring"), in_head.alias("head_recurring"))
