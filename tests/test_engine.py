from __future__ import annotations

import json
import subprocess
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from codestrata.operators import graph
from codestrata.plans import reports
from codestrata.plans.engine import Engine
from codestrata.plans.queries import oracle_sql, queries
from codestrata.sources import files, git, state
from codestrata.streaming import watch

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def tree(tmp_path: Path) -> Path:
    root = tmp_path / "tree"
    for name, text in {
        "src/lib.rs": "mod a;\n// WARNING: careful\npub fn run() {\n}\n", "src/a/mod.rs": "pub struct A;\n", "README.md": "# no\n", "src/.hidden.rs": "fn h() {}\n",
        "build/out.rs": "fn o() {}\n", ".gitignore": "build/\n", "min.js": "x" * 500, "deep/a/b/c/d.py": "def f():\n    pass\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bin.py").write_bytes(b"a\x00b")
    (root / "bad.py").write_bytes(b"\xff\xfe")
    return root


def test_scan(spark: SparkSession, tree: Path) -> None:
    found = {r.relative_path: r for r in files.scan_directory(spark, str(tree), threshold=3).collect()}
    assert set(found) == {"src/lib.rs", "src/a/mod.rs", "deep/a/b/c/d.py"}
    assert found["src/lib.rs"].is_large and found["src/lib.rs"].line_count == 4
    assert "build/out.rs" in {r.relative_path for r in files.scan_directory(spark, str(tree), respect_gitignore=False).collect()}
    assert {r.relative_path for r in files.scan_directory(spark, str(tree), max_depth=2, languages=["rust"]).collect()} == {"src/lib.rs"}
    assert [r.relative_path for r in files.quarantine(spark, str(tree)).collect()] == ["bad.py"]


def test_scan_of_names_and_ignore_files(spark: SparkSession, tmp_path: Path) -> None:
    names = ("pkg/__init__.py", "pkg/_own.Py", "pkg/skip_a.py", "pkg/skip_b.py", "pkg/sub/skip_c.py", "pkg/sub/kept.py", ".venv/x.py", "a/b/c/d/e.rs")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".git/info").mkdir(parents=True)
    (tmp_path / ".git/info/exclude").write_text("skip_a.py\nskip_c.py\n")
    (tmp_path / ".ignore").write_text("skip_b.py\n")
    (tmp_path / "pkg/sub/.gitignore").write_text("!skip_c.py\n")
    want = ["a/b/c/d/e.rs", "pkg/__init__.py", "pkg/_own.Py", "pkg/sub/kept.py", "pkg/sub/skip_c.py"]
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert [r.relative_path for r in files.scan_directory(spark, root).collect()] == want
    assert {r.relative_path for r in files.scan_directory(spark, str(tmp_path), respect_gitignore=False).collect()} == {*want, "pkg/skip_a.py"}
    assert [r.path for r in Engine(spark, str(tmp_path)).modules.where("boundary_type = 'PythonPackage'").collect()] == ["pkg"]


def test_scan_of_a_large_file(spark: SparkSession, tmp_path: Path) -> None:
    lines = (64 << 20) // 32 + 1
    (tmp_path / "large.py").write_text("value = compute(value, 1234567)\n" * lines)
    assert [r.line_count for r in files.scan_directory(spark, str(tmp_path)).select("line_count").collect()] == [lines]
    assert files.scan_directory(spark, str(tmp_path), max_bytes=64 << 20).count() == 0


def test_engine(spark: SparkSession, tree: Path, tmp_path: Path) -> None:
    e, out = Engine(spark, str(tree)), str(tmp_path / "out")
    document = json.loads(e.to_json())
    assert document["project"]["total_files"] == 3 and {m["path"] for m in document["modules"]} == {"src", "src/a", ""} and "diff" not in document
    assert e.write(out) >= 4 and (tmp_path / "out/INDEX.md").read_text().count("| [src") == 2
    assert not e.check(out).first().is_stale
    (tree / "src/b.rs").write_text("fn b() {}\n")
    later = Engine(spark, str(tree))
    assert later.check(out).first().stale == ["src"]
    assert later.index(f"file://{out}/index")["processed"] == 4
    assert later.search(f"file://{out}/index", "struct A", 2).count() == 2
    assert later.outline("src/lib.rs") == "# src/lib.rs\n\n| Line | Kind | Name | Visibility |\n| ---- | ---- | ---- | ---------- |\n| 3 | Function | run | pub |\n"
    assert later.outline("none.rs") == "# none.rs\n\nNo symbols found."
    assert later.dry_run().where("n_bytes > 0").count() >= 4
    (tmp_path / "out/own.md").write_text("a reader's own")
    for path in (tree / "src/a").iterdir():
        path.unlink()
    last = Engine(spark, str(tree))
    assert (tmp_path / "out/modules/src-a/MODULE.md").exists() and last.write(out)
    assert not (tmp_path / "out/modules/src-a/MODULE.md").exists() and (tmp_path / "out/own.md").exists()
    assert not list((tmp_path / "out").rglob("*.tmp"))


def test_configuration_and_watching(spark: SparkSession, tree: Path, tmp_path: Path) -> None:
    (tree / "engine.toml").write_text('threshold = 2\n[search.chunking]\nmax_tokens = 100\noverlap_tokens = 10\n[search.search]\nhybrid_enabled = false\nhybrid_k = 10.0\ndefault_limit = 1\n[watch]\ndebounce_ms = 50\n')
    e, out = Engine.configured(spark, str(tree), "engine.toml"), str(tmp_path / "out")
    assert (e.threshold, e.sizes.max_bytes, e.sizes.overlap_bytes, e.hybrid, e.rrf_k, e.limit, e.debounce_ms) == (2, 400, 40, False, 10.0, 1, 50)
    assert Engine.configured(spark, str(tree), "engine.toml", limit=3).limit == 3 and Engine.configured(spark, str(tree), "none.toml").sizes.max_bytes == 2048
    index = f"file://{tmp_path}/index"
    e.watching(out, str(tmp_path / "cp"), index, once=True).awaitTermination()
    assert (tmp_path / "out/INDEX.md").exists() and e.search(index, "struct A").count() == 1
    (tree / "src/new.rs").write_text("pub struct Fresh;\n")
    (tree / "src/a/mod.rs").unlink()
    e.watching(out, str(tmp_path / "cp"), index, once=True).awaitTermination()
    assert not e.refresh().check(out).first().is_stale and "src/new.rs" in (tmp_path / "out/modules/src/MODULE.md").read_text()
    found = e.search(index, "pub struct Fresh;").first()
    assert found.file_path == "src/new.rs" and e.search(index, "struct A", 50).where("file_path = 'src/a/mod.rs'").count() == 0
    text = reports.search_text(e.search(index, "Fresh").selectExpr("*", "1 AS rank"), "Fresh").first().document
    assert text.startswith("Found 1 results for: Fresh\n\n1. src/new.rs (L1-1)\n   Score: ") and "pub struct Fresh;" in text
    answer = json.loads(reports.search_response(e.search(index, "Fresh").selectExpr("*", "1 AS rank"), "Fresh").first().document)
    assert answer["query"] == "Fresh" and answer["result_count"] == 1 and answer["results"][0]["file"] == "src/new.rs" and answer["results"][0]["lines"] == "1-1"
    assert reports.search_response(e.search(index, "x").where("false").selectExpr("*", "1 AS rank"), "x").first().document.startswith("No results found")
    assert reports.search_text(e.search(index, "x").where("false").selectExpr("*", "1 AS rank"), "x").first().document == "No results found for: x"


def sample_project(spark: SparkSession):
    modules = spark.createDataFrame(
        [("src", "src", ["src/a.rs", "src/lib.rs"], "src/lib.rs", "RustModule", None, ["src-b"]), ("src-b", "src/b", ["src/b/mod.rs"], "src/b/mod.rs", "RustModule", "src", [])],
        "slug string, path string, files array<string>, entry_point string, boundary_type string, parent string, children array<string>",
    )
    tree = spark.createDataFrame([("src/a.rs", 900, True), ("src/lib.rs", 4, False), ("src/b/mod.rs", 7, False)], "relative_path string, line_count bigint, is_large boolean")
    marks = spark.createDataFrame(
        [("Warning", "careful", "src/a.rs", 3, "High"), ("Todo", "later", "src/a.rs", 9, "Medium"), ("Safety", "held", "src/lib.rs", 1, "High")],
        "kind string, content string, source_file string, line_number int, priority string",
    )
    edges = spark.createDataFrame([("src/a.rs", "src/b/mod.rs"), ("src/a.rs", "lib"), ("src/lib.rs", "src/b/mod.rs"), ("x.rs", "src/b/mod.rs")], "src string, dst string")
    return modules, tree, marks, edges


def test_index_document(spark: SparkSession) -> None:
    modules, tree, marks, edges = sample_project(spark)
    hubs = spark.createDataFrame([("src/b/mod.rs", 3)], "dst string, importers bigint")
    text = reports.index_document(tree, marks, modules, edges, hubs, "demo").first().content
    assert text.startswith("# demo\n\n## Reading Protocol\n\n1. ") and "## Entry Points\n\n- `src/lib.rs`\n" in text and "**2** high-priority warnings across 1 modules." in text
    assert "| [src](modules/src/MODULE.md) | RustModule | 2 | 2 |  |\n| [src/b](modules/src-b/MODULE.md) | RustModule | 1 | - | ★ |\n" in text
    assert "## Module Dependencies\n\n```mermaid\ngraph TD\n    src[src] --> src_b[src-b]\n```\n" in text
    empty = reports.index_document(tree.limit(0), marks.limit(0), modules.limit(0), edges.limit(0), hubs.limit(0)).first().content
    assert "_No modules detected._" in empty and "Alerts" not in empty and "Entry Points" not in empty and "Dependencies" not in empty


def test_module_documents(spark: SparkSession) -> None:
    modules, tree, marks, edges = sample_project(spark)
    owners = graph.module_files(modules)
    memory = {r.slug: r.content for r in reports.module_memories(marks, owners).collect()}
    assert set(memory) == {"src"} and "| High 🔴 | Medium 🟡 | Low 🟢 |\n| 2 | 1 | 0 |\n" in memory["src"] and "🟢 Low Priority" not in memory["src"]
    assert "## 🔴 High Priority\n\n### `Warning` (src/a.rs:3)\n\n> careful\n\n### `Safety` (src/lib.rs:1)\n\n> held\n" in memory["src"]
    imports = {r.slug: r.content for r in reports.module_imports(edges, owners).collect()}
    assert "## Internal Dependencies\n\nImports that stay inside this module:\n\n- `lib`\n" in imports["src"] and "## External Dependencies" in imports["src"]
    assert "graph TD\n    src[src] --> b[b]\n```" in imports["src"] and "- `src/a.rs`\n- `src/lib.rs`\n- `x.rs`\n" in imports["src-b"]
    parts = reports.module_memories(marks, owners).unionByName(spark.createDataFrame([("src", "outline", "x" * 600), ("src-b", "outline", "")], "slug string, part string, content string"))
    got = {r.path: r.content for r in reports.module_documents(modules, tree, parts).collect()}
    assert set(got) == {"modules/src/MODULE.md", "modules/src-b/MODULE.md", "modules/src/outline.md"}
    main = got["modules/src/MODULE.md"]
    assert main.startswith("# Module: src\n\n[← Back to INDEX](../../INDEX.md)\n\n**Type:** RustModule | **Files:** 2\n\n**Entry point:** `src/lib.rs`\n")
    assert "| `src/a.rs` | 900 | 📊 |\n| `src/lib.rs` | 4 |  |\n" in main and "- [src-b](../src-b/MODULE.md)\n" in main and "- [outline.md](outline.md) - " in main
    assert main.split("---\n\n")[-1].startswith("| High 🔴") and "xxx" not in main and "Documentation" not in got["modules/src-b/MODULE.md"]


@pytest.mark.parametrize(("n_files", "size"), [(3, "Small"), (20, "Medium"), (101, "Large")])
def test_agent_document(spark: SparkSession, n_files: int, size: str) -> None:
    modules, _, marks, _ = sample_project(spark)
    tree = spark.range(n_files).selectExpr("concat('f', id) AS relative_path", "false AS is_large")
    text = reports.agent_document(tree, marks, modules, "demo", "abc1234", "2024-01-01T00:00:00Z").first().content
    assert "**demo**" in text and "**Git HEAD:** `abc1234`" in text and "**Generated:** 2024-01-01T00:00:00Z" in text
    assert ("- **src** (2 files)" in text) == (size == "Small") and ("| `src` | 2 | RustModule | Source root |" in text) == (size != "Small")
    assert ("| Total files | 101 |" in text) == ("5. " in text) == (size == "Large")


def test_clone(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    origin = tmp_path / "origin.git"
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    origin.mkdir()
    run("init", "-q", "-b", "main")
    (origin / "a.rs").write_text("fn a() {}\n")
    run("add", "-A"), run("commit", "-qm", "one")
    e = Engine.cloned(spark, f"file://{origin}", str(tmp_path))
    assert [r.relative_path for r in e.files.collect()] == ["a.rs"] and Path(e.root).parent == tmp_path
    with pytest.raises(RuntimeError):
        git.clone(f"file://{tmp_path}/none.git", str(tmp_path))
    git.remove_clone(e.root)
    assert not Path(e.root).exists()


def test_git(spark: SparkSession, tmp_path: Path) -> None:
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.rs").write_text("1\n")
    run("add", "-A"), run("commit", "-qm", "one"), run("checkout", "-qb", "work")
    (tmp_path / "a.rs").write_text("1\n2\n")
    (tmp_path / "b.rs").write_text("1\n")
    run("add", "-A"), run("commit", "-qm", "two")
    assert {tuple(r) for r in git.diff_files(spark, str(tmp_path), "main").collect()} == {("a.rs", "Modified", 1, 0), ("b.rs", "Added", 1, 0)}
    assert git.is_repository(str(tmp_path)) and git.head(str(tmp_path)) and git.default_branch(str(tmp_path)) == "main"
    assert git.is_remote_url("https://github.com/a/b") and not git.is_remote_url(".") and not git.is_remote_url("/a/b")
    assert git.normalize_url("github.com/a/b") == "https://github.com/a/b.git" and git.normalize_url("https://x/a.git") == "https://x/a.git"


def test_state(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "c.toml").write_text("[x]\ny = 1\n")
    assert state.load_config(str(tmp_path / "a/b"), "c.toml") == {"x": {"y": 1}} and state.load_config(str(tmp_path), "none.toml") == {}
    assert state.load_manifest(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log.json").write_text('{"session_id":"s","tool_name":"t","tokens_out":3}\nnot json\n')
    assert [r.tokens_out for r in state.load_telemetry(spark, str(tmp_path / "log.json")).collect()] == [3]


def test_stream_of_files(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x")
    (tmp_path / "in/.b.py").write_text("x")
    seen: list[str] = []
    events = watch.file_events(spark, str(tmp_path / "in"), "/out")
    for _ in range(2):
        q = watch.watch(events, lambda df, n: seen.extend(r.path.rsplit("/", 1)[1] for r in df.collect()), str(tmp_path / "cp"), once=True)
        q.awaitTermination()
    assert seen == ["a.py"]


def plain(value):
    """A value as text that is the same for both engines."""
    if value is None or value != value:
        return "-"
    if isinstance(value, float):
        return repr(round(value, 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark: SparkSession, name: str) -> None:
    """Every query runs; where SQL states its result, the values are the same."""
    got = queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name in oracle_sql():
        con = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        found = con.execute(oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry(spark: SparkSession) -> None:
    assert entry.entry(spark).count() == 10
    assert set(oracle_sql()) <= set(queries()) and set(queries()) <= set(entry.queries())
