"""Source trees as tables of files.

Trees are listed and read inside tasks, through the file system that the root's
scheme names, so a tree may lie in any store that all executors reach, and names
that begin with an underscore are files like others.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import schemas
from codestrata.functions import text as T
from codestrata.shared import keep

#: Bytes of contents that a task hands on at once, besides the last file.
READ_BYTES = 16 << 20
#: Files that state what is left out, besides ``.git/info/exclude`` and the user's own.
IGNORE_FILES = (".gitignore", ".ignore")


def open_root(root: str):  # noqa: ANN201
    """(file system, folder) of a path or URI."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))
    return system, base.rstrip("/")


def _expand(root: str, deep: bool):  # noqa: ANN202
    """Replaces folders by what they hold, or by all files below them; hidden folders are left out."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = open_root(root)
        for b in batches:
            files = b[~b["folder"]]
            out = list(zip(files["relative_path"], files["folder"], files["length"], files["mtime"], strict=True))
            left = b["relative_path"][b["folder"]].tolist()
            while left:
                folder = left.pop()
                for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, recursive=False, allow_not_found=True)):
                    path = f"{folder}/{info.base_name}" if folder else info.base_name
                    if info.type == fs.FileType.Directory:
                        if not info.base_name.startswith("."):
                            left.append(path) if deep else out.append((path, True, None, None))
                    elif info.type == fs.FileType.File:
                        out.append((path, False, info.size, (info.mtime_ns or 0) // 1000))
                if len(out) >= 10_000:
                    yield _listed(out)
                    out = []
            yield _listed(out)

    return rows


def _listed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["relative_path", "folder", "length", "mtime"])
    return out.astype({"folder": bool, "length": "Int64", "mtime": "Int64"})


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, length, mtime) of all files below a folder but those in hidden folders; stored.

    The first two levels are spread over tasks, each of which then walks what is below its folders.
    """
    schema, n = "relative_path string, folder boolean, length bigint, mtime bigint", spark.sparkContext.defaultParallelism
    found = spark.createDataFrame([("", True, None, None)], schema)
    for deep in (False, False, True):
        found = found.mapInPandas(_expand(root, deep), schema)
        found = found if deep else found.repartition(n, "relative_path")
    return keep(found.where("NOT folder").select("relative_path", "length", F.timestamp_micros("mtime").alias("mtime")), "listing")


def _rules(folder: str, text: str) -> list[tuple[str, bool, str]]:
    lines = [line.rstrip() for line in text.splitlines()]
    return [(folder, line.startswith("!"), line.lstrip("!")) for line in lines if line and not line.startswith("#")]


def ignore_rules(root: str, listed: DataFrame, gitignore: bool = True) -> list[tuple[str, bool, str]]:
    """(folder, negated, pattern) of every rule that a tree states, the strongest last.

    The user's own rules and the repository's ``info/exclude`` come first, then the ignore files of the tree,
    outer ones first; without ``gitignore`` only ``.ignore`` files count.
    """
    system, base = open_root(root)
    rules: list[tuple[str, bool, str]] = []
    if gitignore:
        user = os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")
        if os.path.isfile(user):
            with open(user, encoding="utf-8", errors="replace") as f:
                rules += _rules("", f.read())
        own = f"{base}/.git/info/exclude"
        if system.get_file_info(own).is_file:
            with system.open_input_stream(own) as f:
                rules += _rules("", f.read().decode("utf-8", "replace"))
    name = T.file_name("relative_path")
    names = IGNORE_FILES if gitignore else IGNORE_FILES[1:]
    paths = [r.relative_path for r in listed.where(name.isin(*names)).select("relative_path").collect()]  # the tree's ignore files
    for path in sorted(paths, key=lambda p: (p.count("/"), names.index(p.rpartition("/")[2]), p)):
        with system.open_input_stream(f"{base}/{path}") as f:
            rules += _rules(path.rpartition("/")[0], f.read().decode("utf-8", "replace"))
    return rules


def ignore_regex(folder: str, pattern: str) -> str:
    """A regular expression for the relative paths that one ignore pattern of a folder covers."""
    only_dir, anchored = pattern.endswith("/"), "/" in pattern.strip("/") or pattern.startswith("/")
    parts = []
    for piece in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", pattern.strip("/")):
        parts.append({"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(piece) or (piece if piece.startswith("[") else re.escape(piece)))
    head = re.escape(folder) + "/" if folder else ""
    return f"^{head}{'' if anchored else '(?:.*/)?'}{''.join(parts)}{'/.*' if only_dir else '(?:/.*)?'}$"


def not_ignored(path: Column, rules: list[tuple[str, bool, str]]) -> Column:
    """The last rule that matches a path decides whether it is ignored."""
    ignored = F.lit(False)
    for folder, negated, pattern in rules:
        ignored = F.when(path.rlike(ignore_regex(folder, pattern)), F.lit(not negated)).otherwise(ignored)
    return ~ignored


def included(path: Column, languages: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """Whether a path has one of the languages (all without any) and matches none of the glob patterns."""
    keep = F.lit(True)
    if languages:
        keep &= F.lower(T.language(T.extension(path))).isin(*[x.lower() for x in languages])
    for pattern in ignore or []:
        keep &= ~path.rlike(fnmatch.translate(pattern))
    return keep


def scan_directory(
    spark: SparkSession, root: str, threshold: int = schemas.LARGE_LINES, respect_gitignore: bool = True, max_depth: int | None = None, languages: list[str] | None = None,
    ignore: list[str] | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """The source files below a folder, with content, by path.

    Only files with known extensions are read. Hidden paths, ignored paths and binary
    and minified files are left out; files that aren't UTF-8 are in ``quarantine``. Files over ``max_bytes``,
    if it is given, are skipped by their listed length, before their content is read.
    """
    listed = listing(spark, root)
    path = F.col("relative_path")
    keep_ = ~path.rlike(r"(?:^|/)\.[^/]") & included(path, languages, ignore) & _known(path)
    if max_bytes is not None:
        keep_ &= F.col("length") <= max_bytes
    if max_depth is not None:
        keep_ &= F.size(F.split(path, "/")) <= max_depth
    keep_ &= not_ignored(path, ignore_rules(root, listed, respect_gitignore))
    kept = contents(listed.where(keep_), root).where(F.expr("is_valid_utf8(content)")).where(~T.is_binary("content"))
    decoded = kept.withColumn("content", F.decode("content", "UTF-8")).where(~T.is_minified("content"))
    return file_entries(decoded, threshold)


def _known(path: Column) -> Column:
    return F.lower(T.extension(path)).isin(*schemas.LANGUAGE_BY_EXTENSION)


def contents(listed: DataFrame, root: str) -> DataFrame:
    """(relative_path, content binary, length, mtime): listed files with what they hold, sorted before they are read.

    A file that can't be read is left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        for b in batches:
            at, held, size = 0, [], 0
            for k, path in enumerate(b["relative_path"]):
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        held.append(f.read())
                except OSError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= READ_BYTES or k + 1 == len(b):
                    yield b.iloc[at : k + 1].assign(content=held)
                    at, held, size = k + 1, [], 0

    schema = "relative_path string, length bigint, mtime timestamp, content binary"
    return listed.orderBy("relative_path").mapInPandas(rows, schema).where("content IS NOT NULL").select("relative_path", "content", "length", "mtime")


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, length, mtime) of the source files that aren't valid UTF-8."""
    wanted = listing(spark, root).where(_known(F.col("relative_path")))
    return contents(wanted, root).where(~F.expr("is_valid_utf8(content)")).drop("content")


def file_entries(texts: DataFrame, threshold: int = schemas.LARGE_LINES) -> DataFrame:
    """(relative_path, extension, language, size_bytes, line_count, is_large, mtime, content) from (relative_path, content, mtime)."""
    ext = T.extension("relative_path")
    n = T.line_count("content")
    return texts.select(
        "relative_path", ext.alias("extension"), T.language(ext).alias("language"), F.octet_length("content").cast("bigint").alias("size_bytes"), n.alias("line_count"),
        (n > threshold).alias("is_large"), "mtime", "content",
    )


def complex_files(files: DataFrame, symbols: DataFrame, lines: int = schemas.COMPLEX_LINES, publics: int = schemas.COMPLEX_SYMBOLS) -> DataFrame:
    """(relative_path, line_count, public_symbols): files of many lines or many public symbols."""
    counts = symbols.groupBy(F.col("file_path").alias("relative_path")).agg(F.count_if(F.col("visibility") == "Public").alias("public_symbols"))
    joined = files.join(counts, "relative_path", "left").fillna(0, ["public_symbols"])
    return joined.where((F.col("line_count") >= lines) | (F.col("public_symbols") >= publics)).select("relative_path", "line_count", "public_symbols")
