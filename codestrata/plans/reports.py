"""Reports as columns of text: index, module documents, outlines, file documents and the project's JSON.

Every document is one row (path, content), made by aggregation; writers run where the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import schemas
from codestrata.functions import text as T
from codestrata.operators import graph, markers as marks, modules as mods, rollups
from codestrata.shared import keep
from codestrata.sources.files import open_root

NEWLINE = "\n"


def _table(order: Column, line: Column) -> Column:
    """Lines of a group in an order, as one text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), NEWLINE)


def outlines(symbols: DataFrame, owners: DataFrame, large: DataFrame) -> DataFrame:
    """(slug, part, content): the symbols of each module's large files."""
    kept = symbols.join(large.select(F.col("relative_path").alias("file_path")).distinct(), "file_path", "left_semi")
    row = F.format_string("| %d | %s | %s | %s |", F.col("line_range.start"), "kind", "name", F.coalesce("visibility", F.lit("")))
    body = _table(F.struct(F.col("line_range.start"), F.col("name")), row)
    per_file = kept.groupBy("file_path").agg(F.concat(F.lit("## "), F.first("file_path"), F.lit("\n\n| Line | Kind | Name | Visibility |\n| ---- | ---- | ---- | ---------- |\n"), body).alias("text"))
    placed = per_file.join(owners.withColumnRenamed("relative_path", "file_path"), "file_path")
    return placed.groupBy("slug").agg(_table(F.col("file_path"), F.concat("text", F.lit(NEWLINE))).alias("content")).select("slug", F.lit("outline").alias("part"), "content")


#: Signs of priorities, headings and navigation of the documents.
PRIORITY_SIGNS = {"High": "🔴", "Medium": "🟡", "Low": "🟢"}
TO_INDEX, TO_MODULE = "[← Back to INDEX](../../INDEX.md)\n\n", "[← Back to MODULE](MODULE.md) | [← Back to INDEX](../../INDEX.md)\n\n"


def _part(slug_text: DataFrame, part: str) -> DataFrame:
    return slug_text.select("slug", F.lit(part).alias("part"), "content")


def module_memories(markers: DataFrame, owners: DataFrame) -> DataFrame:
    """(slug, part, content): each module's markers in a section for each priority, with their numbers; modules without markers have none."""
    placed = markers.join(owners.withColumnRenamed("relative_path", "source_file"), "source_file")
    entry = F.format_string("### `%s` (%s:%d)\n\n> %s\n", "kind", "source_file", "line_number", F.coalesce("content", F.lit("")))
    order = F.struct("source_file", "line_number", F.coalesce("content", F.lit("")).alias("c"), "kind")
    found = [F.sort_array(F.collect_list(F.when(F.col("priority") == p, F.struct(order.alias("o"), entry.alias("l"))))).alias(p) for p in PRIORITY_SIGNS]
    grouped = placed.groupBy("slug").agg(*found)
    sections = [
        F.when(F.size(p) > 0, F.concat(F.lit(f"## {sign} {p} Priority\n\n"), F.array_join(F.transform(p, lambda x: x["l"]), NEWLINE), F.lit(NEWLINE))).otherwise("")
        for p, sign in PRIORITY_SIGNS.items()
    ]
    names = " | ".join(f"{p} {sign}" for p, sign in PRIORITY_SIGNS.items())
    counts = F.format_string(f"## Summary\n\n| {names} |\n| %d | %d | %d |\n\n", *(F.size(p) for p in PRIORITY_SIGNS))
    return _part(grouped.select("slug", F.concat(F.lit(f"# Memory\n\n{TO_MODULE}"), counts, *sections).alias("content")), "memory")


def module_imports(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(slug, part, content): imports inside and outside of each module and the files that use it, in lists and as a graph."""
    scopes = graph.import_scopes(edges, owners).select("slug", F.when(F.col("internal"), "internal").otherwise("external").alias("kind"), F.col("target").alias("name"))
    used = graph.consumers(edges, owners).select("slug", F.lit("consumers").alias("kind"), F.col("importer").alias("name"))
    rows = scopes.unionByName(used)
    lists = rows.groupBy("slug").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("name")))).alias(k) for k in ("internal", "external", "consumers")))
    every = owners.select("slug").distinct().join(lists, "slug", "left")

    def node(text: Column) -> Column:
        return F.concat(T.mermaid_id(text), F.lit("["), text, F.lit("]"))

    def drawn(column: str, line: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.array_distinct(F.transform(column, T.module_label)), line), "")

    own = node(F.col("slug"))
    arrows = F.concat(
        drawn("external", lambda x: F.concat(F.lit("    "), own, F.lit(" --> "), node(x), F.lit(NEWLINE))),
        drawn("consumers", lambda x: F.concat(F.lit("    "), node(x), F.lit(" --> "), own, F.lit(NEWLINE))),
    )
    diagram = F.when(F.size("external") + F.size("consumers") > 0, F.concat(F.lit("## Dependency Graph\n\n```mermaid\ngraph TD\n"), arrows, F.lit("```\n\n"))).otherwise("")

    def section(column: str, title: str, told: str) -> Column:
        items = F.array_join(F.transform(column, lambda x: F.concat(F.lit("- `"), x, F.lit("`\n"))), "")
        return F.when(F.size(column) > 0, F.concat(F.lit(f"## {title}\n\n{told}:\n\n"), items, F.lit(NEWLINE))).otherwise("")

    body = F.concat(
        diagram, section("internal", "Internal Dependencies", "Imports that stay inside this module"), section("external", "External Dependencies", "Imports that leave this module"),
        section("consumers", "Consumers", "Files elsewhere that import from this module"),
    )
    text = F.coalesce(F.when(F.length(body) > 0, body), F.lit("_No import relationships detected._\n"))
    return _part(every.select("slug", F.concat(F.lit(f"# Imports\n\n{TO_MODULE}"), text).alias("content")), "imports")


#: The parts of a module's document, in order, and what each is about.
PARTS = {"outline": "symbols of large files", "memory": "warnings and open tasks", "imports": "dependencies"}


def module_documents(modules: DataFrame, files: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, content): each module's document, its short parts inside it, its long parts beside it."""
    listed = graph.module_files(modules).join(files.select("relative_path", "line_count", "is_large"), "relative_path")
    row = F.format_string("| `%s` | %d | %s |", "relative_path", F.coalesce("line_count", F.lit(0)), F.when(F.col("is_large"), "📊").otherwise(""))
    tables = listed.groupBy("slug").agg(_table(F.col("relative_path"), row).alias("files_table"))
    held = parts.where(F.length("content") > 0).withColumn("inside", T.is_inline("content"))
    by_part = {p: F.max(F.when(F.col("part") == p, F.struct("inside", "content"))).alias(p) for p in PARTS}
    joined = modules.join(tables, "slug", "left").join(held.groupBy("slug").agg(*by_part.values()), "slug", "left")
    title = F.when((F.col("path") == "") | (F.col("slug") == "root"), "Root Module").otherwise(F.concat(F.lit("Module: "), "path"))
    head = F.concat(F.lit("# "), title, F.lit(f"\n\n{TO_INDEX}"), F.format_string("**Type:** %s | **Files:** %d\n\n", F.coalesce("boundary_type", F.lit("")), F.size("files")))
    entry = F.when(F.col("entry_point").isNotNull(), F.concat(F.lit("**Entry point:** `"), "entry_point", F.lit("`\n\n"))).otherwise("")
    table = F.when(F.col("files_table").isNotNull(), F.concat(F.lit("## Files\n\n| File | Lines | Large |\n| ---- | ----- | ----- |\n"), "files_table", F.lit("\n\n"))).otherwise("")
    kids = F.array_join(F.transform(F.coalesce("children", F.array().cast("array<string>")), lambda c: F.concat(F.lit("- ["), c, F.lit("](../"), c, F.lit("/MODULE.md)\n"))), "")
    children = F.when(F.size("children") > 0, F.concat(F.lit("## Child Modules\n\n"), kids, F.lit(NEWLINE))).otherwise("")
    links = F.concat(*(F.when(~F.col(p)["inside"], f"- [{p}.md]({p}.md) - {told}\n").otherwise("") for p, told in PARTS.items()))
    beside = F.when(F.length(links) > 0, F.concat(F.lit("## Documentation\n\n"), links, F.lit(NEWLINE))).otherwise("")
    inside = [F.when(F.col(p)["inside"], F.concat(F.lit("---\n\n"), T.strip_navigation(F.col(p)["content"]))).otherwise("") for p in PARTS]
    main = joined.select(F.concat(F.lit("modules/"), "slug", F.lit("/MODULE.md")).alias("path"), F.concat(head, entry, table, children, beside, *inside).alias("content"))
    apart = held.where("NOT inside").select(F.concat(F.lit("modules/"), "slug", F.lit("/"), "part", F.lit(".md")).alias("path"), "content")
    return main.unionByName(apart)


def file_documents(files: DataFrame, symbols: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, content): the document of each given file: overview, symbols, public signatures, markers."""
    row = F.format_string("| %s | %s | %d-%d |", "kind", "name", F.col("line_range.start"), F.col("line_range.end"))
    api = F.when((F.col("visibility") == "Public") & F.col("signature").isNotNull(), F.concat(F.lit("- `"), T.short_signature("signature"), F.lit("`")))
    order = F.struct(F.col("line_range.start"), F.col("name"))
    per = symbols.groupBy(F.col("file_path").alias("relative_path")).agg(_table(order, row).alias("symbols_table"), _table(order, F.coalesce(api, F.lit(""))).alias("api"))
    mark = F.format_string("- %s (line %d): %s", "kind", "line_number", F.coalesce("content", F.lit("")))
    notes = markers.groupBy(F.col("source_file").alias("relative_path")).agg(_table(F.struct("line_number", "kind"), mark).alias("notes"))
    joined = files.select("relative_path", "language", "line_count").join(per, "relative_path", "left").join(notes, "relative_path", "left")
    part = lambda title, c: F.when(F.length(c) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.col(c), F.lit(NEWLINE))).otherwise("")
    text = F.concat(F.lit("# "), "relative_path", F.lit("\n\n"), F.coalesce("language", F.lit("Unknown")), F.lit(", "), F.coalesce("line_count", F.lit(0)), F.lit(" lines\n"), part("Symbols", "symbols_table"), part("Public API", "api"), part("Markers", "notes"))
    return joined.select(F.concat(F.lit("files/"), T.file_slug("relative_path"), F.lit(".md")).alias("path"), text.alias("content"))


def index_document(files: DataFrame, markers: DataFrame, modules: DataFrame, edges: DataFrame, hubs: DataFrame, name: str = "Project") -> DataFrame:
    """(path, content): the index: how to read on, first entry points, alerts, modules with hubs starred, dependencies as a graph."""
    owners = graph.module_files(modules)
    entries = mods.entry_points(files).limit(5).agg(_table(F.col("relative_path"), F.concat(F.lit("- `"), "relative_path", F.lit("`"))).alias("entries"))
    high = markers.agg(F.count_if(F.col("priority") == "High").alias("high"))
    warned = rollups.warned_modules(owners, markers)
    star = owners.join(hubs.select(F.col("dst").alias("relative_path")).distinct(), "relative_path", "left_semi").select("slug").distinct().withColumn("star", F.lit("★"))
    listed = modules.join(warned, "slug", "left").join(star, "slug", "left")
    link = F.format_string("[%s](modules/%s/MODULE.md)", F.when(F.col("slug") == "root", "root").otherwise(F.col("path")), "slug")
    row = F.concat(
        F.lit("| "), link, F.lit(" | "), F.coalesce("boundary_type", F.lit("")), F.lit(" | "), F.size("files"), F.lit(" | "), F.coalesce(F.col("n").cast("string"), F.lit("-")), F.lit(" | "),
        F.coalesce("star", F.lit("")), F.lit(" |"),
    )
    table = listed.agg(_table(F.struct("path", "slug"), row).alias("table"), F.count("n").alias("warned"))
    deps = graph.module_dependencies(edges, owners)
    arrow = F.format_string("    %s[%s] --> %s[%s]", T.mermaid_id("src_module"), "src_module", T.mermaid_id("dst_module"), "dst_module")
    graph_text = deps.agg(_table(F.struct("src_module", "dst_module"), arrow).alias("deps"))

    def section(title: str, column: str, before: str = "", after: str = "\n\n") -> Column:
        return F.when(F.length(column) > 0, F.concat(F.lit(f"## {title}\n\n{before}"), F.col(column), F.lit(after))).otherwise("")

    alerts = F.when(F.col("high") > 0, F.format_string("## ⚠️ Critical Alerts\n\n**%d** high-priority warnings across %d modules. Each module's `memory.md` lists its own.\n\n", "high", "warned")).otherwise("")
    header = "| Module | Type | Files | Warnings | Hub |\n| ------ | ---- | ----- | -------- | --- |\n"
    none = F.when(F.length("table") == 0, "## Modules\n\n_No modules detected._\n\n").otherwise("")
    text = F.concat(
        F.lit(f"# {name}\n\n## Reading Protocol\n\n" + "\n".join(f"{n}. {x}" for n, x in enumerate(PROTOCOL[:4], 1)) + "\n\n"),
        section("Entry Points", "entries"), alerts, none, section("Modules", "table", header), section("Module Dependencies", "deps", "```mermaid\ngraph TD\n", "\n```\n\n"), F.lit("---\n"),
    )
    return entries.join(high).join(table).join(graph_text).select(F.lit("INDEX.md").alias("path"), text.alias("content"))


#: How to read the documents; the last two are told for large projects only.
PROTOCOL = (
    "Begin with this index: it names every module", "Open `modules/{name}/MODULE.md` of the part you work on", "Look for warnings in its `memory.md` before you edit",
    "Find symbols of large files in its `outline.md`", "See who depends on it in its `imports.md`", "Read `files/*.md` about files of high complexity",
)
#: Where the documents are.
STRUCTURE = (
    "INDEX.md", "AGENT.md", "modules/{module-slug}/MODULE.md", "modules/{module-slug}/outline.md", "modules/{module-slug}/memory.md", "modules/{module-slug}/imports.md", "files/{file-slug}.md",
)


def agent_document(files: DataFrame, markers: DataFrame, modules: DataFrame, name: str | None = None, head: str | None = None, generated: str | None = None) -> DataFrame:
    """(path, content): how a reader should use the documents, by the project's size: protocol, freshness, modules, what to do if they are stale.

    Small projects get a list of modules, larger ones a table, large ones more steps and a summary.
    """
    totals = rollups.project_rollup(files, markers, modules).withColumn("size", T.project_size("total_files"))
    listed = modules.agg(
        _table(F.struct("path", "slug"), F.format_string("- **%s** (%d files)", "path", F.size("files"))).alias("short"),
        _table(F.struct("path", "slug"), F.format_string("| `%s` | %d | %s | %s |", "path", F.size("files"), F.coalesce("boundary_type", F.lit("")), T.module_description("path"))).alias("long"),
    )
    large = F.col("size") == "Large"
    steps = "\n".join(f"{n}. {x}" for n, x in enumerate(PROTOCOL[:4], 1))
    more = "\n".join(f"{n}. {x}" for n, x in enumerate(PROTOCOL[4:], 5))
    when = generated or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    table = F.concat(F.lit("| Module | Files | Type | Description |\n| ------ | ----- | ---- | ----------- |\n"), F.col("long"))
    text = F.concat(
        F.lit("# AI Agent Instructions\n\n" + (f"How to work with **{name}**.\n\n" if name else "") + f"## Reading Protocol\n\n{steps}\n"), F.when(large, more + "\n").otherwise(""),
        F.lit("\n### Documentation Structure\n\n```\n" + "\n".join(STRUCTURE) + "\n```\n\n## Freshness Check\n\n" + f"**Generated:** {when}\n" + (f"**Git HEAD:** `{head}`\n" if head else "")),
        F.lit("\nThe documents may be outdated if `git rev-parse --short HEAD` tells another revision, or if files were changed after the time above.\n\n"),
        F.when(F.col("total_modules") > 0, F.concat(F.lit("## Available Modules\n\n"), F.when(F.col("size") == "Small", F.col("short")).otherwise(table), F.lit("\n\n"))).otherwise(""),
        F.lit("## When Docs Seem Stale\n\n1. `Engine.check` tells which modules are stale\n2. `Engine.write` writes all documents anew\n3. An engine with `diff_base` writes those of changed files only\n\n"),
        F.when(large, F.format_string("## Quick Reference\n\n| Metric | Value |\n| ------ | ----- |\n| Total files | %d |\n| Modules | %d |\n| Warnings | %d |\n\n", "total_files", "total_modules", "high_markers")).otherwise(""),
        F.lit("---\n"),
    )
    return totals.join(listed).select(F.lit("AGENT.md").alias("path"), text.alias("content"))


def project_json(files: DataFrame, markers: DataFrame, symbols: DataFrame, modules: DataFrame, edges: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """(document): the whole project as one JSON text; the diff is left out where there is none."""
    owners, hubs = graph.module_files(modules), graph.hub_files(edges)
    large = files.where("is_large")
    listed = modules.join(rollups.module_rollup(owners, markers, symbols, hubs, large), "slug", "left")
    keep = ("slug", "path", "boundary_type", "parent", "children", "file_count", "warning_count", "high_count", "symbol_count", "is_hub")
    sections = [
        rollups.project_rollup(files, markers, modules).select(F.struct("*").alias("project")),
        listed.agg(F.sort_array(F.collect_list(F.struct("path", *(k for k in keep if k != "path")))).alias("modules")),
        mods.entry_points(files).agg(F.sort_array(F.collect_list("relative_path")).alias("entry_points")),
        large.agg(F.sort_array(F.collect_list(F.struct("relative_path", "line_count"))).alias("large_files")),
        marks.critical_files(markers).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "source_file", "n"))).alias("c")).select(
            F.transform("c", lambda x: F.struct(x["source_file"].alias("path"), x["n"].alias("count"))).alias("critical_files")
        ),
        hubs.agg(F.sort_array(F.collect_list(F.struct((-F.col("importers")).alias("o"), "dst", "importers"))).alias("h")).select(
            F.transform("h", lambda x: F.struct(x["dst"].alias("path"), x["importers"].alias("importers"))).alias("hub_files")
        ),
    ]
    if diff is not None:
        sections.append(diff.agg(F.sort_array(F.collect_list(F.struct("path", "status", "additions", "deletions"))).alias("diff")))
    joined = sections[0]
    for s in sections[1:]:
        joined = joined.join(s)
    return joined.select(F.to_json(F.struct("*")).alias("document"))


def search_json(results: DataFrame) -> DataFrame:
    """(document): a line of JSON for each result, its score with three decimals."""
    return results.select(F.to_json(F.struct(F.format_number("score", 3).alias("score"), *(c for c in results.columns if c != "score"))).alias("document"))


def search_text(results: DataFrame, query: str) -> DataFrame:
    """(document): the results (rank, score, file_path, start_line, end_line, chunk_type, content) as lines for a terminal, best first."""
    shown = T.cli_preview("content")
    preview = F.when(F.length(shown) > 0, F.concat(F.lit("   "), F.replace(shown, F.lit(NEWLINE), F.lit("\n   ")), F.lit(NEWLINE))).otherwise("")
    entry = F.concat(F.format_string("%d. %s (L%d-%d)\n   Score: %.3f | Type: %s\n", "rank", "file_path", "start_line", "end_line", "score", "chunk_type"), preview)
    found = results.agg(F.count("*").alias("n"), _table(F.col("rank"), entry).alias("lines"))
    none = F.lit(f"No results found for: {query}")
    return found.select(F.when(F.col("n") == 0, none).otherwise(F.concat(F.lit("Found "), F.col("n"), F.lit(f" results for: {query}\n\n"), F.col("lines"))).alias("document"))


def search_response(results: DataFrame, query: str) -> DataFrame:
    """(document): one JSON text with the query, the number of results and each of (rank, score, file_path, start_line, end_line, chunk_type, content)."""
    item = F.struct(
        F.col("rank"), F.col("file_path").alias("file"), F.format_string("%.3f", "score").alias("score"), F.format_string("%d-%d", "start_line", "end_line").alias("lines"),
        F.col("chunk_type").alias("type"), T.preview("content").alias("content_preview"),
    )
    found = results.agg(F.sort_array(F.collect_list(item)).alias("r"))
    listed = F.transform("r", lambda x: F.struct(*(x[c].alias(c) for c in ("file", "score", "lines", "type", "content_preview"))))
    answer = F.to_json(F.struct(F.lit(query).alias("query"), F.size("r").alias("result_count"), listed.alias("results")))
    return found.select(F.when(F.size("r") == 0, "No results found. Is there an index?").otherwise(answer).alias("document"))


#: How visibilities are shown.
VISIBILITIES = {"Public": "pub", "Private": "(private)", "Protected": "(protected)", "Internal": "(internal)"}


def symbol_outlines(symbols: DataFrame) -> DataFrame:
    """(file_path, content): the symbols of each file as a table, by line and name."""
    shown = F.coalesce(T.lookup(VISIBILITIES, F.col("visibility")), F.lit(""))
    row = F.format_string("| %d | %s | %s | %s |", F.col("line_range.start"), "kind", "name", shown)
    order = F.struct(F.col("line_range.start").alias("s"), F.col("name"), F.col("kind"), shown.alias("v"))
    head = F.concat(F.lit("# "), F.first("file_path"), F.lit("\n\n| Line | Kind | Name | Visibility |\n| ---- | ---- | ---- | ---------- |\n"))
    return symbols.where("file_path IS NOT NULL").groupBy("file_path").agg(F.concat(head, _table(order, row), F.lit(NEWLINE)).alias("content"))


def symbol_outline(symbols: DataFrame, path: str) -> DataFrame:
    """(content): the outline of one file."""
    found = symbol_outlines(symbols.where(F.col("file_path") == path))
    return found.agg(F.coalesce(F.max("content"), F.lit(f"# {path}\n\nNo symbols found.")).alias("content"))


def dry_run(documents: DataFrame) -> DataFrame:
    """(path, n_bytes) of what would be written, by path."""
    return documents.select("path", F.octet_length("content").alias("n_bytes")).orderBy("path")


def write_documents(documents: DataFrame, root: str) -> int:
    """Writes documents (path, content) below a folder that all executors reach, and deletes what an earlier run wrote there and this one didn't; their number.

    Each task writes its own files through the file system of the root's scheme, under a temporary name first, so a
    task that is repeated does no harm. The paths written are kept in ``.written``; nothing else is ever deleted.
    """
    spark = documents.sparkSession

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{target}.tmp") as out:
                    out.write(content.encode("utf-8", "surrogatepass"))
                system.move(f"{target}.tmp", target)
            yield pd.DataFrame({"path": b["path"]})

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        for b in batches:
            for path in b["path"]:
                if system.get_file_info(f"{base}/{path}").is_file:
                    system.delete_file(f"{base}/{path}")
            yield pd.DataFrame({"path": b["path"]})

    listing = f"{root.rstrip('/')}/.written"
    system, base = open_root(root)
    system.create_dir(base, recursive=True)
    written = keep(documents.where("content <> ''").mapInPandas(write, "path string"), "written")
    if system.get_file_info(f"{base}/.written").type.name == "Directory":
        earlier = spark.read.schema("path string").parquet(listing)
        earlier.join(written, "path", "left_anti").mapInPandas(remove, "path string").count()
    written.write.mode("overwrite").parquet(listing)
    return written.count()
