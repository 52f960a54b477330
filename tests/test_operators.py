from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codestrata.functions.vectors import cosine
from codestrata.operators import graph, incremental, markers, modules, rollups, search
from codestrata.operators.chunking import ChunkSizes, chunk_by_symbols, symbol_rows, window_rows, windows
from codestrata.operators.embedding import HashingEmbedder
from codestrata.operators.index import ChunkIndex
from codestrata.operators.symbols import extract_symbols, imports_of, symbols_of

NOW = datetime(2024, 1, 1)


def paths(spark: SparkSession, names: list[str]):
    return spark.createDataFrame([(n,) for n in names], "relative_path string")


def test_markers(spark: SparkSession) -> None:
    texts = [
        ("a", "// TODO:\nfoo()\n"), ("b", "x = a * note\n"), ("c", "// TODO a // FIXME b\n"), ("d", " * @deprecated use x\n"), ("e", "// deprecated: y\n"),
        ("f", "// According to spec\n"), ("g", "\n// SAFETY: held\n# WARN twice\n"), ("h", None), ("i", ""), ("j", "// DEPRECATED\n"),
    ]
    got = markers.extract_markers(spark.createDataFrame(texts, "relative_path string, content string")).collect()
    assert sorted((r.source_file, r.kind, r.content, r.line_number, r.priority) for r in got) == [
        ("a", "Todo", "foo()", 1, "Medium"), ("c", "Todo", "a // FIXME b", 1, "Medium"), ("e", "Deprecated", "y", 1, "High"), ("f", "BusinessRule", "spec", 1, "High"),
        ("g", "Safety", "held", 2, "High"), ("g", "Warning", "twice", 3, "High"), ("j", "Deprecated", "Deprecated", 1, "High"),
    ]
    rows = [("Warning", "x", "src/danger.rs", 1, "High"), ("Safety", "y", "src/danger.rs", 2, "High"), ("Todo", "z", "src/other.rs", 1, "Medium")]
    table = spark.createDataFrame(rows, "kind string, content string, source_file string, line_number int, priority string")
    assert [tuple(r) for r in markers.critical_files(table).collect()] == [("src/danger.rs", 2)]
    assert {(r.category, r.total, r.high) for r in markers.summary_by_category(table).collect()} == {("Warnings", 2, 2), ("Technical Debt", 1, 0)}


def test_graph(spark: SparkSession) -> None:
    edges = spark.createDataFrame([("a", "utils"), ("b", "utils"), ("c", "utils"), ("d", "utils"), ("d", "config"), (None, "utils2"), ("d", None)], "src string, dst string")
    assert [tuple(r) for r in graph.hub_files(edges).collect()] == [("utils", 4)]
    assert graph.hub_files(edges.limit(0)).count() == 0
    owners = spark.createDataFrame([("m", "a"), ("m", "utils"), ("n", "d"), ("n", "config")], "slug string, relative_path string")
    assert {tuple(r) for r in graph.module_dependencies(edges, owners).collect()} == {("n", "m")}
    assert {tuple(r) for r in graph.consumers(edges, owners).collect()} == {("m", "b"), ("m", "c"), ("m", "d")}
    assert {tuple(r) for r in graph.import_scopes(edges, owners).collect()} == {("m", "utils", True), ("n", "utils", False), ("n", "config", True)}


@pytest.mark.parametrize(
    ("names", "expected"),
    [
        (["src/lib.rs", "src/main.rs", "src/analyze/mod.rs", "src/analyze/parser.rs", "src/analyze/lang/mod.rs", "src/analyze/lang/rust.rs"], {"src": "RustModule", "src/analyze": "RustModule", "src/analyze/lang": "RustModule"}),
        (["mypackage/__init__.py", "mypackage/core.py", "mypackage/utils/__init__.py", "mypackage/utils/helpers.py"], {"mypackage": "PythonPackage", "mypackage/utils": "PythonPackage"}),
        (["src/index.ts", "src/app.ts", "src/components/index.ts", "src/components/Button.tsx", "src/utils/index.js", "src/utils/format.js"], {"src": "JsModule", "src/components": "JsModule", "src/utils": "JsModule"}),
        ([f"src/services/s{i}.py" for i in range(6)], {"src/services": "Implicit"}),
        ([f"src/small/s{i}.py" for i in range(3)], {"": "Root"}),
        ([f"a/f{i}.py" for i in range(5)] + [f"a/b/f{i}.py" for i in range(5)], {"a": "Implicit", "a/b": "Implicit"}),
        ([], {}),
    ],
)
def test_modules(spark: SparkSession, names: list[str], expected: dict[str, str]) -> None:
    found = modules.detect_modules(paths(spark, names)).collect()
    assert {r.path: r.boundary_type for r in found} == expected
    assert sorted(f for r in found for f in r.files) == sorted(names)


def test_module_nesting(spark: SparkSession) -> None:
    found = {r.slug: r for r in modules.detect_modules(paths(spark, ["src/lib.rs", "src/analyze/mod.rs", "src/analyze/lang/mod.rs", "README.md"])).collect()}
    assert found["src-analyze-lang"].parent == "src-analyze" and "src-analyze-lang" in found["src-analyze"].children
    assert found["root"].files == ["README.md"] and found["src"].parent is None


def test_entry_points(spark: SparkSession) -> None:
    got = modules.entry_points(paths(spark, ["src/domain.rs", "src/lib.rs", "src/mod.rs", "src/a/mod.rs", "x.py"])).collect()
    assert [r.relative_path for r in got] == ["src/domain.rs", "src/lib.rs", "src/mod.rs"]


def test_symbols() -> None:
    assert symbols_of("private static function foo() {\n}\n", "Php") == [("Function", "foo", "private static function foo(...)", 1, 2, "Public")]
    assert [s[:2] + s[5:] for s in symbols_of("return foo(x);\n", "Java")] == [("Method", "foo", "Internal")]
    assert symbols_of("\n\n  public void bar() {\n  }\n", "Java")[0][3] == 1
    assert symbols_of('int main(void) {\n  char *s = "}";\n  return 0;\n}\n', "C") == [("Function", "main", "int main(void)", 1, 4, "Public")]
    assert symbols_of("class A\n  attr_reader :x, :y\n  private\n  def foo\n  end\n  def self.bar\n  end\nend\n", "Ruby") == [
        ("Class", "A", "class A", 1, 8, "Public"), ("Const", "x", None, 2, 2, "Public"), ("Const", "y", None, 2, 2, "Public"),
        ("Method", "foo", "def foo", 4, 5, "Private"), ("Function", "self.bar", "def self.bar", 6, 7, "Private"),
    ]
    assert [s[1] for s in symbols_of("class A {\n}\nactor B {\n}\nfunc c(x: Int) -> Int {\n}\ninit() {\n}\n", "Swift")] == ["A", "B", "c", "init"]
    assert [(s[0], s[1], s[5]) for s in symbols_of("class _A extends B {\n}\nget x {\n}\n", "Dart")] == [("Class", "_A", "Private"), ("Method", "get x", "Public")]
    assert [(s[0], s[1]) for s in symbols_of("namespace n {\n}\nint A::f() {\n}\nvirtual int g();\n", "Cpp")] == [("Module", "n"), ("Method", "A::f"), ("Method", "g")]
    assert [(s[0], s[1], s[5]) for s in symbols_of("namespace N.M {\npublic class A {\n  int X { get; }\n}\n}\n", "CSharp")][:2] == [("Module", "N.M", "Public"), ("Class", "A", "Public")]
    assert [(s[1], s[4], s[5]) for s in symbols_of("def _a():\n    x\n\n    y\nclass B:\n    def __c(self):\n        pass\n", "Python")] == [("_a", 4, "Private"), ("B", 7, "Public"), ("__c", 7, "Public")]
    assert [(s[0], s[1], s[4]) for s in symbols_of("pub fn a() {\n}\nstruct B;\npub(crate) trait C {\n}\n", "Rust")] == [("Function", "a", 2), ("Struct", "B", 5), ("Trait", "C", 5)]
    assert [(s[1], s[5]) for s in symbols_of("func Run() {\n}\ntype t struct {\n}\n", "Go")] == [("Run", "Public"), ("t", "Private")]
    assert [s[1] for s in symbols_of("export default function x() {}\nexport const y = (a) => {}\nconst z = a => a\ntype T = string\n", "TypeScript")] == ["y", "z", "T"]
    assert symbols_of("", "Rust") == [] and symbols_of("x", "Unknown") == []


def test_imports() -> None:
    assert imports_of("from .x import y\nimport os.path\nimport os\n", "Python") == ["os"]
    assert imports_of('import "fmt"\nimport (\n "a/b"\n "c"\n)\n', "Go") == ["fmt", "b", "c"]
    assert imports_of("use crate::a;\nuse std::b;\nmod c;\n", "Rust") == ["a", "std", "c"]
    assert imports_of("import x from './x'\nconst y = require('y')\n", "JavaScript") == ["./x", "y"]


def test_symbols_of_table(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a.py", "Python", "def f():\n  pass\n"), ("b.py", "Python", None), (None, "Python", "def g(): pass")], "relative_path string, language string, content string")
    assert [(r.file_path, r.name, r.line_range.start) for r in extract_symbols(rows).collect()] == [("a.py", "f", 1)]


def test_windows_match_the_cases() -> None:
    assert [(a + 1, b) for a, b in windows([60] * 80, 2048, 200)] == [(1, 34), (33, 66), (65, 80)]
    assert len(window_rows("t.rs", [f"line {i}" for i in range(10)], ChunkSizes(100, 20))) >= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4000), max_size=120), st.integers(1, 3000), st.integers(0, 900))
def test_windows_cover_all_lines_and_end(sizes: list[int], limit: int, overlap: int) -> None:
    spans = list(windows(sizes, limit, overlap))
    assert {n for a, b in spans for n in range(a, b)} == set(range(len(sizes)))
    assert all(x[0] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_symbol_chunks(spark: SparkSession) -> None:
    body = "// head\nfn foo() {\n  x\n}\n\nfn bar() {\n  y\n}\n"
    symbols = [{"kind": "Function", "name": "foo", "start": 2, "end": 4}, {"kind": "Function", "name": "bar", "start": 6, "end": 8}, {"kind": "Const", "name": "c", "start": 1, "end": 1}]
    rows = symbol_rows("a.rs", body.split("\n")[:-1], symbols, ChunkSizes(500, 0))
    assert [r[0] for r in rows] == ["a.rs:foo:2", "a.rs:bar:6"] and rows[0][4].startswith("File: a.rs\nSymbol: foo\nLines: 2-4\n\nfn foo")
    files = spark.createDataFrame([("a.rs", body), ("b.rs", "x\n"), ("c.rs", "")], "relative_path string, content string")
    none = spark.createDataFrame([], "file_path string, kind string, name string, line_range struct<start:int,end:int>")
    assert sorted(r.id for r in chunk_by_symbols(files, none).collect()) == ["a.rs:block:1", "b.rs:block:1"]


def test_search(spark: SparkSession) -> None:
    chunks = spark.createDataFrame([("1", "user authentication here"), ("2", "nothing"), ("3", "authentication for user accounts")], "id string, content string")
    got = search.text_search(chunks, "user authentication", 5).collect()
    assert [r.id for r in got] == ["1", "3"] and got[0].score > got[1].score
    assert {r.id for r in search.text_search(chunks, "authentication", 5).collect()} == {"1", "3"}
    assert search.text_search(chunks, "foobar", 5).count() == 0 and search.text_search(chunks, "a", 5).count() == 0
    lists = [spark.createDataFrame([(x, s) for x, s in zip(ids, (2.0, 1.0), strict=True)], "id string, score double") for ids in ("ab", "bc")]
    assert search.reciprocal_rank_fusion(lists, 3).first().id == "b"
    assert [r.id for r in search.reciprocal_rank_fusion(lists[::-1], 3).collect()] == [r.id for r in search.reciprocal_rank_fusion(lists, 3).collect()]


def test_manifest(spark: SparkSession) -> None:
    schema = "slug string, latest_mtime bigint, file_count bigint, files_hash string"
    old = spark.createDataFrame([("same", 1000, 5, "h"), ("time", 1000, 5, "h"), ("count", 1000, 5, "h"), ("gone", 1, 1, "h")], schema)
    new = spark.createDataFrame([("same", 1000, 5, "h"), ("time", 2000, 5, "h"), ("count", 1000, 6, "h"), ("added", 1, 1, "h")], schema)
    assert {r.slug: r.status for r in incremental.staleness(old, new).collect()} == {"same": "fresh", "time": "stale", "count": "stale", "gone": "removed", "added": "new"}
    assert {r.slug for r in incremental.to_regenerate(old, new).collect()} == {"time", "count", "added"}
    assert {r.slug for r in incremental.pruned(old, new).collect()} == {"same", "time", "count"}
    check = incremental.check_result(old, new).first()
    assert check.is_stale and check.stale == ["count", "time"] and check.new == ["added"] and check.removed == ["gone"]
    assert not incremental.check_result(old.limit(0), new.limit(0)).first().is_stale


def test_index_is_incremental(spark: SparkSession, tmp_path: Path) -> None:
    store, schema = ChunkIndex(spark, f"file://{tmp_path}/index"), "relative_path string, content string, mtime timestamp"
    symbols = spark.createDataFrame([], "file_path string, kind string, name string, line_range struct<start:int,end:int>")
    first = spark.createDataFrame([("a", "one", NOW), ("b", "two", NOW), ("c", "", NOW)], schema)
    assert store.update(first, symbols, HashingEmbedder()) == {"processed": 3, "created": 2, "skipped": 0, "errors": 0}
    assert store.update(first, symbols, HashingEmbedder()) == {"processed": 0, "created": 0, "skipped": 3, "errors": 0}
    second = spark.createDataFrame([("a", "one", NOW), ("b", "2", NOW)], schema)
    assert store.update(second, symbols, HashingEmbedder())["processed"] == 1
    assert store.prune(second) == 1
    assert sorted(r.content.split("\n\n")[1] for r in store.chunks().collect()) == ["2", "one"]
    assert {r.path for r in store.documents().collect()} == {"a", "b"}


def test_index_goes_on_after_errors(spark: SparkSession, tmp_path: Path) -> None:
    class FailingEmbedder(HashingEmbedder):
        def embed_batch(self, texts: list[str]) -> list[list[float]]:
            if any("bad" in t for t in texts):
                raise ValueError("no vector")
            return [self.embed(t) for t in texts]

    store, schema = ChunkIndex(spark, f"file://{tmp_path}/index"), "relative_path string, content string, mtime timestamp"
    symbols = spark.createDataFrame([], "file_path string, kind string, name string, line_range struct<start:int,end:int>")
    texts = [(f"f{i}", f"text {i}", NOW) for i in range(40)]
    assert store.update(spark.createDataFrame(texts, schema), symbols, FailingEmbedder())["errors"] == 0
    changed = [("f1", "bad now", NOW), ("f2", "good now", NOW), *texts[3:]]
    done = store.update(spark.createDataFrame(changed, schema), symbols, FailingEmbedder())
    assert (done["processed"], done["errors"], done["skipped"]) == (1, 1, 37)
    assert [r.message for r in store.errors.collect()] == ["f1: ValueError: no vector"]
    held = {r.file_path: r.content for r in store.chunks().collect()}
    assert "text 1" in held["f1"] and "good now" in held["f2"] and len(held) == 40
    assert store.update(spark.createDataFrame(changed, schema), symbols, HashingEmbedder())["processed"] == 1  # it is tried again
    number, _ = store._current()
    assert len(list((tmp_path / "index/current").glob("0*"))) == 2 and len([p for p in (tmp_path / "index").iterdir() if p.name != "current"]) == 2
    with pytest.raises(RuntimeError, match="another run"):
        store.persist(store.chunks(), store.documents(), number - 1)


def test_rollups(spark: SparkSession) -> None:
    events = spark.createDataFrame([("s", "a", 1, 10, 5), ("s", "a", 1, 20, 5), ("s", "b", 1, 1, 1), ("t", "b", 0, 5, 2)], "session_id string, tool_name string, tokens_in bigint, tokens_out bigint, bytes_out bigint")
    s = {r.session_id: r for r in rollups.session_summaries(events).collect()}
    assert s["s"].total_calls == 3 and [t.tool_name for t in s["s"].tools_used] == ["a", "b"] and s["s"].total_tokens_out == 31
    assert rollups.telemetry_totals(rollups.session_summaries(events)).first().average_tokens == 18
    docs = spark.createDataFrame([("m", "x", "a" * 400), ("n", "x", "a" * 40)], "slug string, name string, content string")
    cost = rollups.token_costs(docs).first()
    assert (cost.total_tokens, cost.hierarchical_tokens, cost.saved_percent) == (110, 100, 9.1)
    assert rollups.token_costs(docs.limit(0)).first().total_tokens == 0
    parts = spark.createDataFrame([("m", p, "x" * 500) for p in ("outline", "memory", "imports")], "slug string, part string, content string")
    assert rollups.output_files(parts).first().n_files == 5
    owners = spark.createDataFrame([("m", "x.c")], "slug string, relative_path string")
    marks = spark.createDataFrame([("Warning", "w", "x.cpp", 1, "High")], "kind string, content string, source_file string, line_number int, priority string")
    assert rollups.warned_modules(owners, marks).count() == 0 and rollups.warned_modules(owners, marks, prefix=True).first().n == 1
    errors = spark.createDataFrame([(f"e{i:02}",) for i in range(12)], "message string")
    assert [r.message for r in rollups.error_report(errors).collect()][-1] == "... and 2 more"
    langs = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", "Z"), ("e", "W")], "relative_path string, language string")
    assert [r.language for r in rollups.language_histogram(langs).select(F.col("language")).collect()] == ["X", "W", "Y"]


@pytest.mark.parametrize("width", [64, 128])
def test_vectors_that_are_not_finite(spark: SparkSession, width: int) -> None:
    """Nothing but a similar vector is a hit, whatever the width: vectors that don't fit or aren't finite score 0."""
    nan, inf = float("nan"), float("inf")
    rows = [("nan", [nan] * width), ("one", [nan] + [1.0] * (width - 1)), ("inf", [inf] * width), ("zero", [0.0] * width), ("short", [1.0]), ("none", None), ("same", [2.0] * width), ("far", [-1.0] * width)]
    chunks = spark.createDataFrame(rows, "id string, vector array<float>")
    got = {r.id: r.score for r in search.vector_search(chunks, [1.0] * width, 20).collect()}
    assert got.pop("same") == pytest.approx(1) and got.pop("far") == pytest.approx(-1) and set(got.values()) == {0.0} and len(got) == 6
    assert search.vector_search(chunks, [1.0] * width, 1).first().id == "same"
    by_column = {r.id: r.s for r in chunks.select("id", cosine(F.array(*[F.lit(1.0)] * width), "vector").alias("s")).collect()}
    assert by_column.pop("same") == pytest.approx(1) and by_column.pop("far") == pytest.approx(-1) and set(by_column.values()) == {0.0}
    assert set(r.score for r in search.vector_search(chunks, [nan] * width, 20).collect()) == {0.0}
