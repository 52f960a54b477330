"""Column expressions over paths, texts and sizes; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata import schemas


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(values: Mapping[str, str], key: Column) -> Column:
    """The value of a literal map; null without one."""
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))[key]


def lines(text: Column | str) -> Column:
    """Lines of a text: a final newline opens no line, carriage returns before newlines belong to the end of line."""
    t = _col(text)
    body = F.when(t.endswith("\n"), F.expr("1")).otherwise(F.lit(0))
    parts = F.split(t, "\n", -1)
    kept = F.slice(parts, 1, F.size(parts) - body)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(kept, lambda x: F.regexp_replace(x, "\r$", "")))


def line_count(text: Column | str) -> Column:
    t = _col(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(t == "", 0).otherwise(breaks + F.when(t.endswith("\n"), 0).otherwise(1)).cast("bigint")


def is_minified(text: Column | str) -> Column:
    """Whether the whole-number mean of the bytes of non-empty lines is over the limit."""
    sizes = F.transform(F.filter(lines(text), lambda x: F.trim(x) != ""), lambda x: F.octet_length(x))
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(F.size(sizes) > 0, F.floor(total / F.size(sizes)) > schemas.MINIFIED_MEAN).otherwise(F.lit(False))


def is_binary(content: Column | str) -> Column:
    """Whether a NUL stands in the first bytes of binary content."""
    return F.position(F.lit(b"\x00"), F.substring(_col(content), 1, schemas.BINARY_PREFIX)) > 0


def extension(path: Column | str) -> Column:
    """What follows the last dot of the file name; null for none and for names that begin with their only dot."""
    found = F.regexp_extract(_col(path), r"[^/]\.([^./]+)$", 1)
    return F.when(found != "", found)


def language(ext: Column | str) -> Column:
    return F.coalesce(lookup(schemas.LANGUAGE_BY_EXTENSION, F.lower(_col(ext))), F.lit("Unknown"))


def shebang_language(first_line: Column | str) -> Column:
    s = _col(first_line)
    named = F.when(s.contains("python"), "Python").when(s.rlike("node|deno|bun"), "JavaScript").when(s.contains("php"), "Php")
    return F.when(s.startswith("#!"), named)


def parent_dir(path: Column | str) -> Column:
    p = _col(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def path_slug(path: Column | str) -> Column:
    p = _col(path)
    return F.when(p.isin("", "."), "root").otherwise(F.translate(p, "/\\", "--"))


def file_slug(path: Column | str) -> Column:
    return F.regexp_replace(F.translate(path_slug(path), ".", "-"), "-+$", "")


def content_hash(text: Column | str) -> Column:
    """The first 16 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def mermaid_id(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[^\p{L}\p{N}]", "_")


def module_label(path: Column | str) -> Column:
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(_col(path))


def short_signature(signature: Column | str, limit: int = 50) -> Column:
    """One line, one pass of double spaces to single ones, at most ``limit`` characters with dots at the end."""
    s = F.replace(F.replace(_col(signature), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("..."))).otherwise(s)


def preview(text: Column | str, limit: int = 200) -> Column:
    return F.substring(_col(text), 1, limit)


def cli_preview(text: Column | str) -> Column:
    """The fourth to eighth line, at most 200 characters."""
    return F.substring(F.array_join(F.slice(lines(text), 4, 5), "\n"), 1, 200)


def params_preview(text: Column | str, limit: int = 100) -> Column:
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def strip_navigation(text: Column | str) -> Column:
    """A document without its first lines that are empty or begin with ``#`` or ``[``."""
    return F.regexp_replace(_col(text), r"\A(?:(?:[#\[][^\n]*)?(?:\n|\z))+", "")


def is_inline(text: Column | str) -> Column:
    size = F.octet_length(_col(text))
    return (size > 0) & (size < schemas.INLINE_BYTES)


def project_size(n_files: Column | str) -> Column:
    n = _col(n_files)
    return F.when(n < 20, "Small").when(n <= 100, "Medium").otherwise("Large")


def module_description(path: Column | str) -> Column:
    """What a module holds, by its last folder's name, else by parts of its path."""
    p = F.lower(_col(path))
    named = lookup(schemas.DESCRIPTIONS, F.substring_index(p, "/", -1))
    guessed = F.when(p.contains("test"), "Test files").when(p.contains("mock"), "Mock/fixture data").when(p.contains("error"), "Error handling")
    return F.coalesce(named, guessed.otherwise("Module"))


def marker_dimension(kind: Column | str, which: str) -> Column:
    """priority, category or sign of a marker kind; null for an unknown kind."""
    at = ("priority", "category", "sign").index(which)
    return lookup({k: v[at] for k, v in schemas.MARKER_KINDS.items()}, _col(kind))


def rank_of(value: Column | str, order: tuple[str, ...]) -> Column:
    """Position of a value in an order; the order's length for any other."""
    found = F.array_position(F.array(*(F.lit(x) for x in order)), _col(value))
    return F.when(found > 0, found - 1).otherwise(len(order))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the bytes, in whole tokens."""
    return F.floor(F.octet_length(_col(text)) / 4)


def ancestors(path: Column | str, strict: bool = False) -> Column:
    """Folders of a path from itself (or its parent) up to its top-level folder, as (dir, depth)."""
    parts = F.split(_col(path), "/")
    last = F.size(parts) - (1 if strict else 0)
    chain_ = F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.cast("int").alias("depth")),
    )
    return F.when((_col(path) != "") & (last > 0), chain_).otherwise(F.array().cast("array<struct<dir:string,depth:int>>"))


def normalize_path(path: Column | str) -> Column:
    """Forward slashes, single, without a leading ``./``."""
    p = F.replace(F.translate(_col(path), "\\", "/"), F.lit("//"), F.lit("/"))
    return F.regexp_replace(p, r"^(?:\./)+", "")


def resolve_import(from_file: Column | str, target: Column | str) -> Column:
    """The path that an import names: relative and bare names are joined with the importer's folder."""
    d, t = parent_dir(from_file), _col(target)
    relative = t.startswith("./") | t.startswith("../") | ~(t.contains("/") | t.contains("."))
    return F.when(relative, normalize_path(F.when(d == "", t).otherwise(F.concat(d, F.lit("/"), t)))).otherwise(t)
