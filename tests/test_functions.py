from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.vectors import cosine, with_scores


def values(spark: SparkSession, column, rows: list[str | None]) -> list:
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("make", "rows", "expected"),
    [
        (lambda: T.path_slug("x"), ["src/analyze", "src/analyze/lang", "", ".", None], ["src-analyze", "src-analyze-lang", "root", "root", None]),
        (lambda: T.file_slug("x"), ["src/analyze/parser.rs", "main.rs", "a."], ["src-analyze-parser-rs", "main-rs", "a"]),
        (lambda: T.module_description("x"), ["src", "src/cli", "src/api", "lib/utils", "src/analyze", "unknown/module", "a/mocks"], ["Source root", "Command-line interface", "API endpoints", "Utility functions", "Analysis/parsing logic", "Module", "Mock/fixture data"]),
        (lambda: T.line_count("x"), ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n"], [0, 1, 1, 2, 2, 1]),
        (lambda: T.is_minified("x"), ["", "a" * 200, "a" * 201, "a" * 400 + "\n\n" + "b" * 2, "a" * 400 + "\n" + "b" * 1], [False, False, True, True, False]),
        (lambda: T.language(T.extension("x")), ["a/b.RS", "x.h", "Makefile", ".py", "a.b.tsx"], ["Rust", "Cpp", "Unknown", "Unknown", "TypeScript"]),
        (lambda: T.shebang_language("x"), ["#!/usr/bin/env python3", "#!/usr/bin/env node", "# python", "#!/bin/php"], ["Python", "JavaScript", None, "Php"]),
        (lambda: T.mermaid_id("x"), ["a/b-c.é1"], ["a_b_c_é1"]),
        (lambda: T.module_label("x"), ["src/cli/a.rs", "a.rs"], ["cli", "a.rs"]),
        (lambda: T.short_signature("x"), ["fn a()", "f" * 60, "a\nb  c"], ["fn a()", "f" * 47 + "...", "a b c"]),
        (lambda: T.params_preview("x"), ["a" * 100, "b" * 101], ["a" * 100, "b" * 100 + "..."]),
        (lambda: T.strip_navigation("x"), ["# A\n\n[x](y)\nText\n# B", "Text", "# A"], ["Text\n# B", "Text", ""]),
        (lambda: T.parent_dir("x"), ["a/b/c.rs", "c.rs"], ["a/b", ""]),
        (lambda: T.normalize_path("x"), ["./a//b", "a\\b"], ["a/b", "a/b"]),
        (lambda: T.cli_preview("x"), ["1\n2\n3\n4\n5\n6\n7\n8\n9"], ["4\n5\n6\n7\n8"]),
        (lambda: T.token_estimate("x"), ["abcdefg", "", "ééé"], [1, 0, 1]),
    ],
)
def test_text(spark: SparkSession, make, rows: list, expected: list) -> None:
    assert values(spark, make(), rows) == expected


def test_hash_and_sizes(spark: SparkSession) -> None:
    a, b, c = values(spark, T.content_hash("x"), ["hello", "hello", "world"])
    assert a == b != c and len(a) == 16
    sizes = spark.createDataFrame([(n,) for n in (5, 19, 20, 50, 100, 101, 500)], "n int").select(T.project_size("n").alias("s"))
    assert [r.s for r in sizes.collect()] == ["Small", "Small", "Medium", "Medium", "Medium", "Large", "Large"]


def test_imports_resolve(spark: SparkSession) -> None:
    df = spark.createDataFrame([("src/a.rs", "./b"), ("src/a.rs", "b"), ("src/a.rs", "x/y"), ("a.rs", "b"), ("src/a.rs", "os.path")], "f string, t string")
    assert [r.r for r in df.select(T.resolve_import("f", "t").alias("r")).collect()] == ["src/./b", "src/b", "x/y", "b", "os.path"]


def test_cosine(spark: SparkSession) -> None:
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(pairs, "a array<float>, b array<float>")
    assert [round(r.s, 6) for r in df.select(cosine("a", "b").alias("s")).collect()] == [1, 0, -1, 0, 0, 0]
    both = spark.createDataFrame([(x,) for x, _ in pairs] + [(None,)], "vector array<float>")
    assert [round(r.score, 6) for r in with_scores(both, [2.0, 0.0]).collect()] == [1, 1, 1, 0, 0, 0, 0]


def test_ancestors(spark: SparkSession) -> None:
    df = spark.createDataFrame([("a/b/c",), ("a",), ("",)], "x string")
    rows = df.select(F.transform(T.ancestors("x"), lambda a: a["dir"]).alias("all"), F.transform(T.ancestors("x", strict=True), lambda a: a["dir"]).alias("strict")).collect()
    assert [(r.all, r.strict) for r in rows] == [(["a", "a/b", "a/b/c"], ["a", "a/b"]), (["a"], []), ([], [])]
