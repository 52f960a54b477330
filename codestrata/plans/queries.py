"""The engine's queries by name, each over its whole tables, and the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import chunking, graph, incremental, markers, modules, rollups, search
from codestrata.operators.embedding import HashingEmbedder, embed
from codestrata.operators.index import ChunkIndex, changed_files, deleted_documents, index_stats
from codestrata.operators.symbols import import_rows, symbol_rows
from codestrata.plans import reports
from codestrata.shared import latest, shared_dir, table
from codestrata.sources import files as sources
from codestrata.sources import git
from codestrata.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: The words that the text queries look for.
WORDS = "the queue memory limit"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of the same result."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_NEWEST = """newest AS (
  SELECT * FROM files WHERE relative_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY mtime DESC NULLS LAST, scanned_at DESC NULLS LAST) = 1)"""
_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
_OWNERS = "owners AS (SELECT DISTINCT slug, relative_path FROM (SELECT slug, unnest(files) AS relative_path FROM modules))"
_MARKS = "marks AS (SELECT DISTINCT kind, content, source_file, line_number, priority FROM markers)"


def newest_files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The newest version of each path, as files are meant by every query here, with the columns that are asked for.

    Only these are read and shuffled: a column inside an aggregated row can't be pruned later.
    """
    return newest_of(table(spark, d, "files"), *columns)


def newest_of(files: DataFrame, *columns: str) -> DataFrame:
    """The newest row of each path; what can be computed of a row is computed before, so that texts aren't shuffled."""
    return latest(files.where("relative_path IS NOT NULL"), "relative_path", ["mtime", "scanned_at"], list(columns) or ["mtime"])


def module_owners(spark: SparkSession, d: str) -> DataFrame:
    return graph.module_files(table(spark, d, "modules")).distinct()


def distinct_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "markers").select("kind", "content", "source_file", "line_number", "priority").distinct()


def distinct_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").select("file_path", "kind", "name", "signature", "line_range", "visibility", "doc_comment").distinct()


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    first = rows.where("id = 0").select("vector").first()
    return rows, [float(x) for x in first.vector] if first else []


_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id AS id, round({_COSINE}, 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COSINE} DESC, id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, vector = _vectors(spark, d)
    return search.vector_search(rows, vector, 10).select("id", F.round("score", 5).alias("score"))


_WORDS_SQL = "['the', 'queue', 'memory', 'limit']"
_TEXT_SCORE = f"""(SELECT doc_id AS id, len(list_filter({_WORDS_SQL}, lambda w: contains(lower(text), w))) AS n,
  len(list_filter({_WORDS_SQL}, lambda w: contains(lower(text), w))) / 4.0 + CASE WHEN contains(lower(text), '{WORDS}') THEN 0.5 ELSE 0.0 END AS score
  FROM documents WHERE text IS NOT NULL)"""


@query(f"SELECT id, round(score, 5) AS score FROM {_TEXT_SCORE} WHERE n > 0 ORDER BY score DESC, id LIMIT 20")
def text_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.text_search(rows, WORDS, 20, text="text").select("id", F.round("score", 5).alias("score"))


@query(f"""WITH v AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY {_COSINE} DESC, e.vec_id) - 1 AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q QUALIFY r < 20),
t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM {_TEXT_SCORE} WHERE n > 0 QUALIFY r < 20)
SELECT id, round(sum(1.0 / (60 + r + 1)), 8) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM t) GROUP BY id ORDER BY sum(1.0 / (60 + r + 1)) DESC, id LIMIT 10""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    rows, vector = _vectors(spark, d)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    lists = [search.vector_search(rows, vector, 20), search.text_search(texts, WORDS, 20, text="text")]
    return search.reciprocal_rank_fusion(lists, 10).select("id", F.round("score", 8).alias("score"))


@query()
def embedded_search(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(table(spark, d, "chunks").where("id IS NOT NULL"), "id", ["updated_at"], ["content"])
    vector = HashingEmbedder().embed(WORDS)
    return search.smart_search(embed(rows, HashingEmbedder()), WORDS, vector, 20).select("id", F.round("score", 8).alias("score"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.content_hash("text").alias("hash"))


@query("SELECT substr(sha256(text), 1, 16) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = content_hash(spark, d).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return rows.where("n > 1")


@query(f"""WITH {_NEWEST}, l AS (SELECT relative_path, content, list_transform(CASE WHEN content = '' THEN [] WHEN content LIKE '%' || chr(10) THEN string_split(content, chr(10))[1:-2]
  ELSE string_split(content, chr(10)) END, lambda x: regexp_replace(x, '\\r$', '')) AS ls FROM newest),
s AS (SELECT *, list_filter(ls, lambda x: trim(x) <> '') AS full_lines FROM l)
SELECT relative_path, CAST(len(ls) AS BIGINT) AS line_count, strlen(content)::BIGINT AS size_bytes,
  CASE WHEN len(full_lines) = 0 THEN false ELSE list_sum(list_transform(full_lines, lambda x: strlen(x))) // len(full_lines) > 200 END AS minified FROM s""")
def line_stats(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(
        "relative_path", "mtime", "scanned_at", T.line_count("content").alias("line_count"), F.octet_length("content").cast("bigint").alias("size_bytes"),
        T.is_minified("content").alias("minified"),
    )
    return newest_of(f, "line_count", "size_bytes", "minified")


#: Languages as their definition lists them.
_LANGUAGE_SQL = """(SELECT coalesce(max(lang), 'Unknown') FROM (VALUES ('Rust', ['rs']), ('Python', ['py']), ('JavaScript', ['js', 'jsx', 'mjs', 'cjs']), ('TypeScript', ['ts', 'tsx', 'mts', 'cts']), ('Go', ['go']),
  ('Php', ['php', 'phtml']), ('Java', ['java']), ('CSharp', ['cs']), ('C', ['c']), ('Cpp', ['h', 'hpp', 'hh', 'hxx', 'cpp', 'cc', 'cxx']), ('Ruby', ['rb', 'rake']), ('Dart', ['dart']), ('Swift', ['swift'])) AS l(lang, exts)
  WHERE list_contains(exts, lower(nullif(regexp_extract(relative_path, '[^/]\\.([^./]+)$', 1), ''))))"""


@query(f"WITH {_NEWEST} SELECT relative_path, nullif(regexp_extract(relative_path, '[^/]\\.([^./]+)$', 1), '') AS extension, {_LANGUAGE_SQL} AS language, strlen(content)::BIGINT AS size_bytes FROM newest")
def file_entries(spark: SparkSession, d: str) -> DataFrame:
    f = sources.file_entries(table(spark, d, "files").select("relative_path", "content", "mtime")).drop("content")
    return latest(f.where("relative_path IS NOT NULL"), "relative_path", ["mtime"], ["extension", "language", "size_bytes"])


@query(f"""WITH {_NEWEST} SELECT relative_path, {_DIR.format('relative_path')} AS dir, translate(relative_path, '/\\', '--') AS slug,
  regexp_replace(translate(translate(relative_path, '/\\', '--'), '.', '-'), '-+$', '') AS file_slug, regexp_replace(relative_path, '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS mermaid_id,
  CASE WHEN len(string_split(relative_path, '/')) >= 2 THEN string_split(relative_path, '/')[-2] ELSE relative_path END AS label FROM newest""")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    f = newest_files(spark, d)
    return f.select(
        "relative_path", T.parent_dir("relative_path").alias("dir"), T.path_slug("relative_path").alias("slug"), T.file_slug("relative_path").alias("file_slug"),
        T.mermaid_id("relative_path").alias("mermaid_id"), T.module_label("relative_path").alias("label"),
    )


@query(f"WITH {_NEWEST} SELECT split_part(relative_path, '/', 1) AS repo, count(*) AS n_files, CASE WHEN count(*) < 20 THEN 'Small' WHEN count(*) <= 100 THEN 'Medium' ELSE 'Large' END AS size FROM newest GROUP BY 1")
def project_sizes(spark: SparkSession, d: str) -> DataFrame:
    counts = newest_files(spark, d).groupBy(F.element_at(F.split("relative_path", "/"), 1).alias("repo")).agg(F.count("*").alias("n_files"))
    return counts.withColumn("size", T.project_size("n_files"))


_DESCRIBED_SQL = """WITH names(description, names) AS (VALUES ('Source root', ['src', 'lib']), ('Command-line interface', ['cli', 'cmd']), ('API endpoints', ['api']), ('Authentication logic', ['auth', 'authentication']),
  ('Database layer', ['db', 'database']), ('Data models', ['models', 'entities']), ('Utility functions', ['utils', 'helpers', 'common']), ('Configuration', ['config', 'settings']), ('Test files', ['tests', 'test', '__tests__']),
  ('Type definitions', ['types']), ('Request handlers', ['handlers', 'controllers']), ('Business logic services', ['services']), ('Middleware functions', ['middleware']),
  ('Route definitions', ['routes', 'router']), ('UI components', ['components']), ('React hooks', ['hooks']), ('Page/view components', ['pages', 'views']), ('State management', ['store', 'state']),
  ('Styling', ['styles', 'css']), ('Static assets', ['assets', 'public', 'static']), ('Build/utility scripts', ['scripts']), ('Documentation', ['docs', 'documentation']),
  ('Analysis/parsing logic', ['analyze', 'analysis']), ('Generation logic', ['generate', 'generator']), ('Output/emission logic', ['emit', 'output']), ('File scanning', ['scan', 'scanner']),
  ('Language-specific handlers', ['lang']))
SELECT DISTINCT slug, coalesce((SELECT max(description) FROM names WHERE list_contains(names, lower(string_split(path, '/')[-1]))), CASE WHEN contains(lower(path), 'test') THEN 'Test files'
  WHEN contains(lower(path), 'mock') THEN 'Mock/fixture data' WHEN contains(lower(path), 'error') THEN 'Error handling' ELSE 'Module' END) AS description FROM modules"""


@query(_DESCRIBED_SQL)
def module_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "modules").select("slug", T.module_description("path").alias("description")).distinct()


@query("""SELECT DISTINCT file_path, name, CASE WHEN length(s) > 50 THEN substr(s, 1, 47) || '...' ELSE s END AS short
FROM (SELECT file_path, name, replace(replace(signature, chr(10), ' '), '  ', ' ') AS s FROM symbols WHERE signature IS NOT NULL)""")
def short_signatures(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("signature IS NOT NULL")
    return s.select("file_path", "name", T.short_signature("signature").alias("short")).distinct()


@query("""WITH RECURSIVE t AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents WHERE text IS NOT NULL AND text <> ''),
c AS (SELECT doc_id, list_transform(ls, lambda x: regexp_replace(x, '\\r$', '')) AS ls FROM t),
p AS (SELECT doc_id, ls, len(ls) AS n, list_transform(range(0, len(ls) + 1), lambda k: coalesce(list_sum(list_transform(ls[1:k], lambda x: strlen(x) + 1)), 0)) AS sums FROM c),
w AS (
  SELECT doc_id, 0::BIGINT AS a, 0::BIGINT AS b FROM p WHERE false
  UNION ALL
  SELECT * FROM (SELECT doc_id, 0::BIGINT AS a, len(list_filter(range(0, n), lambda k: sums[k + 1] < 2048))::BIGINT AS b FROM p)),
r AS (
  SELECT doc_id, a, b FROM w
  UNION ALL
  SELECT r.doc_id, greatest(r.b - 2, r.a + 1), greatest(r.b - 2, r.a + 1) + len(list_filter(range(greatest(r.b - 2, r.a + 1), p.n), lambda k: p.sums[k + 1] - p.sums[greatest(r.b - 2, r.a + 1) + 1] < 2048))
  FROM r JOIN p ON p.doc_id = r.doc_id WHERE r.b < p.n)
SELECT CAST(r.doc_id AS VARCHAR) || ':block:' || (a + 1) AS id, CAST(a + 1 AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, substr(sha256(array_to_string(ls[a + 1:b], chr(10))), 1, 16) AS hash
FROM r JOIN p ON p.doc_id = r.doc_id WHERE trim(array_to_string(ls[a + 1:b], ''), ' ' || chr(9) || chr(13)) <> ''""")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.col("text").alias("content"))
    return chunking.chunk_by_window(texts).select("id", "start_line", "end_line", "hash")


@query(f"""WITH RECURSIVE {_NEWEST}, f AS (SELECT relative_path AS p, list_transform(CASE WHEN content LIKE '%' || chr(10) THEN string_split(content, chr(10))[1:-2] ELSE string_split(content, chr(10)) END,
  lambda x: regexp_replace(x, '\\r$', '')) AS ls FROM newest WHERE content IS NOT NULL AND content <> ''),
s AS (SELECT DISTINCT file_path AS p, line_range.start AS a, line_range."end" AS z, kind, name FROM symbols WHERE kind IN ('Function', 'Method', 'Class', 'Struct') AND line_range.start IS NOT NULL AND line_range."end" IS NOT NULL),
b AS (SELECT p, greatest(a, 1) AS a, least(z, len(ls)) AS z, kind, name, ls[greatest(a, 1):least(z, len(ls))] AS part FROM s JOIN f USING (p)),
c AS (SELECT *, array_to_string(part, chr(10)) AS body FROM b WHERE regexp_matches(array_to_string(part, chr(10)), '\\S')),
seg AS (SELECT row_number() OVER () AS g, * FROM (SELECT p, 'split' AS tag, a AS first, kind, part AS ls FROM c WHERE strlen(body) > 2048 UNION ALL SELECT p, 'block', 1, 'Block', ls FROM f WHERE p NOT IN (SELECT p FROM c))),
n AS (SELECT *, len(ls) AS n, list_transform(range(0, len(ls) + 1), lambda k: coalesce(list_sum(list_transform(ls[1:k], lambda x: strlen(x) + 1)), 0)) AS sums FROM seg),
r AS (SELECT g, 0::BIGINT AS a, len(list_filter(range(0, n), lambda k: sums[k + 1] < 2048))::BIGINT AS b FROM n
  UNION ALL
  SELECT r.g, greatest(r.b - 2, r.a + 1), greatest(r.b - 2, r.a + 1) + len(list_filter(range(greatest(r.b - 2, r.a + 1), n.n), lambda k: n.sums[k + 1] - n.sums[greatest(r.b - 2, r.a + 1) + 1] < 2048))
  FROM r JOIN n ON n.g = r.g WHERE r.b < n.n)
SELECT p || ':' || name || ':' || a AS id, p AS file_path, CAST(a AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line, substr(sha256(body), 1, 16) AS hash, kind AS chunk_type FROM c WHERE strlen(body) <= 2048
UNION ALL SELECT p || ':' || tag || ':' || (first + a), p, CAST(first + a AS INTEGER), CAST(first + b - 1 AS INTEGER), substr(sha256(array_to_string(ls[a + 1:b], chr(10))), 1, 16), kind FROM r JOIN n ON n.g = r.g
WHERE regexp_matches(array_to_string(ls[a + 1:b], chr(10)), '\\S')""")
def symbol_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_by_symbols(newest_files(spark, d, "content"), distinct_symbols(spark, d)).select("id", "file_path", "start_line", "end_line", "hash", "chunk_type")


#: Priority and category of a marker, as their definition lists them.
_PRIORITY_SQL = "CASE WHEN kind IN ('Warning', 'Safety', 'BusinessRule', 'Invariant', 'Deprecated') THEN 'High' WHEN kind IN ('Todo', 'Fixme', 'Hack') THEN 'Medium' WHEN kind = 'Note' THEN 'Low' END"
_CATEGORY_SQL = """CASE WHEN kind IN ('Warning', 'Safety') THEN 'Warnings' WHEN kind IN ('BusinessRule', 'Invariant') THEN 'Business Rules' WHEN kind IN ('Deprecated', 'Todo', 'Fixme', 'Hack') THEN 'Technical Debt'
  WHEN kind = 'Note' THEN 'Notes' END"""
#: The markers as the definition words them: a comment mark, a keyword in any case, a colon or space, the rest of the line.
_MARKER_SQL = f"""WITH {_NEWEST},
p(pass, pattern, instead) AS (VALUES
  (0, '(?im)(?://|#|/\\*+|\\*)\\s*\\b(TODO|FIXME|XXX|BUG|HACK|WARNING|NOTE|WARN)\\b[:\\s]*(.*)', NULL),
  (1, '(?im)(?://|#|/\\*+|\\*)\\s*\\b(SAFETY|INVARIANT|GUARANTEES?)\\b[:\\s]*(.*)', NULL),
  (2, '(?im)^\\s*(?://|#|/\\*+|\\*)\\s*\\b(RULE|POLICY|ACCORDING\\s+TO)[:!]?\\s+(.+)', NULL),
  (3, '(?im)(?://|#|/\\*+|\\*)\\s*\\b(DEPRECATED|@deprecated)\\b[:\\s]*(.*)', 'Deprecated')),
m AS (SELECT relative_path AS source_file, pass, instead, regexp_extract_all(content, pattern, 0) AS a, regexp_extract_all(content, pattern, 1) AS k, regexp_extract_all(content, pattern, 2) AS t,
  string_split_regex(content, pattern) AS s FROM newest, p),
e AS (SELECT source_file, pass, upper(k[i]) AS k, coalesce(nullif(regexp_replace(t[i], '^\\s+|\\s+$', '', 'g'), ''), instead) AS content,
  1 + length(regexp_replace(array_to_string(s[1:i], '') || array_to_string(a[1:i - 1], ''), '[^\\n]', '', 'g')) AS line_number FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)),
n AS (SELECT *, CASE WHEN k = 'TODO' THEN 'Todo' WHEN k IN ('FIXME', 'XXX', 'BUG') THEN 'Fixme' WHEN k = 'HACK' THEN 'Hack' WHEN k IN ('WARNING', 'WARN') THEN 'Warning' WHEN k = 'NOTE' THEN 'Note'
  WHEN k = 'SAFETY' THEN 'Safety' WHEN k IN ('INVARIANT', 'GUARANTEE', 'GUARANTEES') THEN 'Invariant' WHEN k IN ('DEPRECATED', '@DEPRECATED') THEN 'Deprecated' ELSE 'BusinessRule' END AS kind FROM e WHERE content IS NOT NULL)
SELECT kind, content, source_file, CAST(line_number AS INTEGER) AS line_number, {{priority}} AS priority, CAST(pass AS INTEGER) AS pass FROM n"""


@query(_MARKER_SQL.replace("{priority}", _PRIORITY_SQL))
def extracted_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = markers.marker_rows(table(spark, d, "files"), "relative_path", "content", "mtime", "scanned_at")
    return markers.unfolded(latest(rows, "source_file", ["mtime", "scanned_at"], ["markers"])).select("kind", "content", "source_file", "line_number", "priority", "pass")


@query(f"""WITH {_MARKS} SELECT {_CATEGORY_SQL} AS category, count(*) AS total, count(*) FILTER (priority = 'High') AS high, count(*) FILTER (priority = 'Medium') AS medium, count(*) FILTER (priority = 'Low') AS low FROM marks GROUP BY 1""")
def marker_summary(spark: SparkSession, d: str) -> DataFrame:
    return markers.summary_by_category(distinct_markers(spark, d)).drop("ord")


@query(f"WITH {_MARKS} SELECT source_file, count(*) AS n FROM marks WHERE priority = 'High' GROUP BY 1")
def critical_files(spark: SparkSession, d: str) -> DataFrame:
    return markers.critical_files(distinct_markers(spark, d))


@query(f"WITH {_MARKS} SELECT source_file, line_number, kind, {_PRIORITY_SQL} AS expected, priority, content FROM marks")
def marker_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = markers.detail_order(distinct_markers(spark, d))
    return rows.select("source_file", "line_number", "kind", T.marker_dimension("kind", "priority").alias("expected"), "priority", "content")


@query("SELECT dst, count(*) AS importers FROM edges WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 3")
def hub_files(spark: SparkSession, d: str) -> DataFrame:
    return graph.hub_files(table(spark, d, "edges"))


@query("""SELECT coalesce(a.file, b.file) AS file, coalesce(imports, 0) AS imports, coalesce(importers, 0) AS importers
FROM (SELECT src AS file, count(*) AS imports FROM edges WHERE src IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT dst AS file, count(*) AS importers FROM edges WHERE dst IS NOT NULL GROUP BY 1) b ON a.file = b.file""")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(table(spark, d, "edges"))


@query(f"WITH {_OWNERS} SELECT DISTINCT a.slug AS src_module, b.slug AS dst_module FROM edges e JOIN owners a ON a.relative_path = e.src JOIN owners b ON b.relative_path = e.dst WHERE a.slug <> b.slug")
def module_deps(spark: SparkSession, d: str) -> DataFrame:
    return graph.module_dependencies(table(spark, d, "edges"), module_owners(spark, d))


@query(f"""WITH {_OWNERS} SELECT DISTINCT o.slug, e.src AS importer FROM edges e JOIN owners o ON o.relative_path = e.dst
WHERE e.src IS NOT NULL AND NOT EXISTS (SELECT 1 FROM owners x WHERE x.slug = o.slug AND x.relative_path = e.src)""")
def consumers(spark: SparkSession, d: str) -> DataFrame:
    return graph.consumers(table(spark, d, "edges"), module_owners(spark, d))


@query(f"""WITH {_OWNERS}, t AS (SELECT DISTINCT slug, dst AS target FROM edges e JOIN owners o ON o.relative_path = e.src WHERE dst IS NOT NULL)
SELECT slug, target, EXISTS (SELECT 1 FROM owners x WHERE x.slug = t.slug AND contains(x.relative_path, t.target)) AS internal FROM t""")
def internal_external(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_scopes(table(spark, d, "edges"), module_owners(spark, d))


@query("""SELECT DISTINCT src, dst, CASE WHEN dst LIKE './%' OR dst LIKE '../%' OR NOT (contains(dst, '/') OR contains(dst, '.'))
  THEN CASE WHEN contains(src, '/') THEN regexp_replace(src, '/[^/]*$', '') || '/' || dst ELSE dst END ELSE dst END AS resolved FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL""")
def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    return e.withColumn("resolved", T.resolve_import("src", "dst"))


_EXPLICIT = f"""explicit AS (SELECT dir, arg_max(boundary_type, relative_path) AS boundary_type, max(relative_path) AS entry_point FROM (
  SELECT relative_path, {_DIR.format('relative_path')} AS dir, CASE WHEN string_split(relative_path, '/')[-1] = 'lib.rs' AND {_DIR.format('relative_path')} IN ('', 'src') THEN 'RustModule'
    WHEN string_split(relative_path, '/')[-1] = 'mod.rs' THEN 'RustModule' WHEN string_split(relative_path, '/')[-1] = '__init__.py' THEN 'PythonPackage'
    WHEN string_split(relative_path, '/')[-1] IN ('index.js', 'index.jsx', 'index.ts', 'index.tsx', 'index.mjs', 'index.mts') THEN 'JsModule' END AS boundary_type FROM newest)
  WHERE boundary_type IS NOT NULL GROUP BY dir)"""


#: The test tables have no file that makes its folder a module, so names of some lengths are replaced by such names, in all rows.
_LAYOUT = """newest AS (SELECT DISTINCT CASE WHEN length(name) % 3 <> 0 THEN relative_path WHEN ends_with(name, '.py') THEN dir || '/__init__.py' WHEN ends_with(name, '.ts') THEN dir || '/index.ts'
  WHEN ends_with(name, '.rs') THEN dir || CASE WHEN length(name) % 2 = 0 THEN '/mod.rs' ELSE '/lib.rs' END WHEN ends_with(name, '.go') THEN dir || '/main.go' ELSE relative_path END AS relative_path
  FROM (SELECT relative_path, string_split(relative_path, '/')[-1] AS name, regexp_replace(relative_path, '/[^/]*$', '') AS dir FROM files WHERE relative_path IS NOT NULL))"""


def layout(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path): the paths of the files table, in which names of some lengths are names that open modules."""
    path = table(spark, d, "files").where("relative_path IS NOT NULL").select("relative_path").distinct()
    p, name = F.col("relative_path"), T.file_name("relative_path")
    opening = F.when(name.endswith(".py"), "__init__.py").when(name.endswith(".ts"), "index.ts").when(name.endswith(".go"), "main.go")
    opening = opening.when(name.endswith(".rs"), F.when(F.length(name) % 2 == 0, "mod.rs").otherwise("lib.rs"))
    renamed = F.when((F.length(name) % 3 == 0) & opening.isNotNull(), F.concat(T.parent_dir("relative_path"), F.lit("/"), opening)).otherwise(p)
    return path.select(renamed.alias("relative_path")).distinct()


@query(f"WITH {_LAYOUT}, {_EXPLICIT} SELECT * FROM explicit")
def explicit_modules(spark: SparkSession, d: str) -> DataFrame:
    return modules.explicit_boundaries(layout(spark, d))


_IMPLICIT = f"""implicit AS (SELECT dir FROM (SELECT {_DIR.format('relative_path')} AS dir, count(*) AS n FROM newest GROUP BY 1) c WHERE n >= 5 AND dir NOT IN (SELECT dir FROM explicit)
  AND NOT EXISTS (SELECT 1 FROM explicit e WHERE (c.dir = '' AND e.dir <> '') OR starts_with(e.dir, c.dir || '/')))"""


@query(f"WITH {_LAYOUT}, {_EXPLICIT}, {_IMPLICIT} SELECT dir FROM implicit")
def implicit_modules(spark: SparkSession, d: str) -> DataFrame:
    f = layout(spark, d)
    return modules.implicit_modules(f, modules.explicit_boundaries(f))


_ASSIGNED = f"""f AS (SELECT relative_path, {_DIR.format('relative_path')} AS dir FROM newest),
o AS (SELECT f.relative_path, arg_max(e.dir, length(e.dir)) AS module FROM f JOIN explicit e ON f.dir = e.dir OR (e.dir <> '' AND starts_with(f.dir, e.dir || '/')) GROUP BY 1),
assigned AS (SELECT f.relative_path, CASE WHEN i.dir IS NOT NULL THEN i.dir ELSE coalesce(o.module, '') END AS module FROM f LEFT JOIN o USING (relative_path) LEFT JOIN implicit i ON i.dir = f.dir)"""
_TREE = """m AS (SELECT dir FROM explicit UNION SELECT dir FROM implicit),
tree AS (SELECT c.dir, arg_max(p.dir, length(p.dir)) AS parent FROM m c JOIN m p ON p.dir <> '' AND starts_with(c.dir, p.dir || '/') GROUP BY 1)"""


@query(f"WITH {_LAYOUT}, {_EXPLICIT}, {_IMPLICIT}, {_ASSIGNED} SELECT * FROM assigned")
def owning_module(spark: SparkSession, d: str) -> DataFrame:
    return modules.assignments(layout(spark, d))[0]


@query(f"WITH {_LAYOUT}, {_EXPLICIT}, {_IMPLICIT}, {_TREE} SELECT * FROM tree")
def module_tree(spark: SparkSession, d: str) -> DataFrame:
    return modules.parent_modules(modules.assignments(layout(spark, d))[1])


_SLUG = "CASE WHEN {0} IN ('', '.') THEN 'root' ELSE translate({0}, '/' || chr(92), '--') END"


@query(f"""WITH {_LAYOUT}, {_EXPLICIT}, {_IMPLICIT}, {_ASSIGNED}, {_TREE},
l AS (SELECT module AS dir, list(relative_path ORDER BY relative_path) AS files FROM assigned GROUP BY 1),
k AS (SELECT parent AS dir, list(s ORDER BY s) AS children FROM (SELECT DISTINCT parent, {_SLUG.format('dir')} AS s FROM tree) GROUP BY 1),
a AS (SELECT dir, boundary_type, entry_point FROM explicit UNION ALL SELECT dir, 'Implicit', NULL FROM implicit),
b AS (SELECT coalesce(a.dir, l.dir) AS path, files, entry_point, coalesce(boundary_type, 'Root') AS boundary_type FROM a FULL JOIN l ON a.dir = l.dir)
SELECT {_SLUG.format('path')} AS slug, path, array_to_string(files, ',') AS files, entry_point, boundary_type, {_SLUG.format('parent')} AS parent, array_to_string(coalesce(children, []), ',') AS children
FROM (SELECT path, coalesce(files, []) AS files, entry_point, boundary_type FROM b) b LEFT JOIN tree ON tree.dir = path LEFT JOIN k ON k.dir = path""")
def detected_modules(spark: SparkSession, d: str) -> DataFrame:
    found = modules.detect_modules(layout(spark, d))
    return found.select("slug", "path", F.array_join("files", ",").alias("files"), "entry_point", "boundary_type", "parent", F.array_join("children", ",").alias("children"))


@query(f"""WITH {_LAYOUT}, e AS (SELECT DISTINCT relative_path FROM newest WHERE len(list_filter(['main.rs', 'lib.rs', 'mod.rs', 'index.js', 'index.ts', 'index.tsx', 'main.py', '__init__.py', 'app.py',
  'main.go', 'cmd/main.go'], lambda e: ends_with(relative_path, e))) > 0)
SELECT relative_path FROM e WHERE NOT (SELECT coalesce(bool_or(relative_path LIKE '%lib.rs'), false) FROM e) OR relative_path NOT LIKE '%mod.rs' OR relative_path = 'src/mod.rs'""")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return modules.entry_points(layout(spark, d))


@query("""SELECT file_path, name, kind, line_range.start AS start_line, CAST(row_number() OVER (PARTITION BY file_path ORDER BY line_range.start, name) AS INTEGER) AS rank
FROM (SELECT DISTINCT file_path, name, kind, line_range FROM symbols WHERE visibility = 'Public' AND kind IN ('Function', 'Class', 'Struct')) QUALIFY rank <= 5""")
def first_public_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("visibility = 'Public' AND kind IN ('Function', 'Class', 'Struct')").select("file_path", "name", "kind", "line_range", "visibility").distinct()
    return modules.first_per_file(s).select("file_path", "name", "kind", F.col("line_range.start").alias("start_line"), "rank")


@query(f"""WITH {_NEWEST}, {_OWNERS}, {_MARKS}, large AS (SELECT relative_path FROM newest WHERE line_count > 100),
m AS (SELECT source_file AS relative_path, count(*) AS w, count(*) FILTER (priority = 'High') AS h FROM marks GROUP BY 1),
s AS (SELECT file_path AS relative_path, count(*) AS c FROM (SELECT DISTINCT file_path, kind, name, signature, line_range, visibility, doc_comment FROM symbols) WHERE file_path IN (SELECT relative_path FROM large) GROUP BY 1),
h AS (SELECT dst AS relative_path FROM edges WHERE dst IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
SELECT slug, count(*) AS file_count, CAST(coalesce(sum(w), 0) AS BIGINT) AS warning_count, CAST(coalesce(sum(m.h), 0) AS BIGINT) AS high_count, CAST(coalesce(sum(c), 0) AS BIGINT) AS symbol_count,
  bool_or(h.relative_path IS NOT NULL) AS is_hub FROM owners o LEFT JOIN m USING (relative_path) LEFT JOIN s USING (relative_path) LEFT JOIN h USING (relative_path) GROUP BY slug""")
def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    large = newest_files(spark, d, "line_count").where("line_count > 100").select("relative_path")
    return rollups.module_rollup(module_owners(spark, d), distinct_markers(spark, d), distinct_symbols(spark, d), graph.hub_files(table(spark, d, "edges")), large)


@query(f"WITH {_OWNERS}, {_MARKS} SELECT slug, count(*) FILTER (priority = 'High') AS high, count(*) FILTER (priority = 'Medium') AS medium, count(*) FILTER (priority = 'Low') AS low FROM marks JOIN owners ON relative_path = source_file GROUP BY 1")
def module_priorities(spark: SparkSession, d: str) -> DataFrame:
    return rollups.module_priorities(module_owners(spark, d), distinct_markers(spark, d))


@query(f"WITH {_OWNERS}, {_MARKS}, h AS (SELECT row_number() OVER () AS m, source_file FROM marks WHERE priority = 'High') SELECT slug, count(DISTINCT m) AS n FROM h JOIN owners ON starts_with(source_file, relative_path) GROUP BY 1")
def prefix_warning_join(spark: SparkSession, d: str) -> DataFrame:
    return rollups.warned_modules(module_owners(spark, d), distinct_markers(spark, d), prefix=True)


@query(f"""WITH {_NEWEST}, {_MARKS} SELECT (SELECT count(*) FROM newest) AS total_files, (SELECT count_if(is_large) FROM newest) AS large_files, (SELECT count(*) FROM marks) AS total_markers,
  (SELECT count_if(priority = 'High') FROM marks) AS high_markers, (SELECT count(*) FROM modules) AS total_modules""")
def project_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollups.project_rollup(newest_files(spark, d, "is_large"), distinct_markers(spark, d), table(spark, d, "modules"))


@query(f"WITH {_NEWEST} SELECT language, count(*) AS n FROM newest WHERE len(string_split(relative_path, '/')) <= 5 GROUP BY 1 ORDER BY n DESC, language LIMIT 3")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rollups.language_histogram(newest_files(spark, d, "language"))


@query("SELECT file_path, count(*) FILTER (visibility = 'Public') AS public_symbols FROM (SELECT DISTINCT file_path, kind, name, signature, line_range, visibility, doc_comment FROM symbols) GROUP BY 1")
def public_symbols(spark: SparkSession, d: str) -> DataFrame:
    return rollups.public_symbols(distinct_symbols(spark, d))


@query(f"""WITH {_NEWEST}, s AS (SELECT file_path, count(*) FILTER (visibility = 'Public') AS public_symbols FROM (SELECT DISTINCT file_path, kind, name, signature, line_range, visibility, doc_comment FROM symbols) GROUP BY 1)
SELECT relative_path, line_count, coalesce(public_symbols, 0) AS public_symbols FROM newest LEFT JOIN s ON file_path = relative_path WHERE line_count >= 300 OR coalesce(public_symbols, 0) >= 10""")
def complex_files(spark: SparkSession, d: str) -> DataFrame:
    return sources.complex_files(newest_files(spark, d, "line_count"), distinct_symbols(spark, d), 300, 10)


@query(f"WITH {_NEWEST} SELECT {_DIR.format('relative_path')} AS dir, count(*) AS n FROM newest GROUP BY 1")
def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.folder_counts(newest_files(spark, d))


_STATES = """SELECT slug, max(epoch(mtime))::BIGINT AS latest_mtime, count(*) AS file_count, CAST(sum(CAST('0x' || substr(md5(relative_path), 1, 15) AS BIGINT)) AS VARCHAR) AS files_hash FROM {0} f JOIN owners USING (relative_path) GROUP BY slug"""
_OLDEST = "oldest AS (SELECT relative_path, min(mtime) AS mtime FROM files WHERE relative_path IS NOT NULL GROUP BY 1 HAVING min(mtime) < TIMESTAMP '2025-01-01')"


@query(f"WITH {_NEWEST}, {_OWNERS} {_STATES.format('newest').replace('epoch(mtime)', 'floor(epoch(mtime))')}")
def module_states(spark: SparkSession, d: str) -> DataFrame:
    return incremental.module_states(module_owners(spark, d), newest_files(spark, d, "mtime"))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Module states of the oldest versions before 2025, and of the newest versions."""
    old = table(spark, d, "files").where("relative_path IS NOT NULL").groupBy("relative_path").agg(F.min("mtime").alias("mtime")).where("mtime < TIMESTAMP '2025-01-01'")
    owners = module_owners(spark, d)
    return incremental.module_states(owners, old), incremental.module_states(owners, newest_files(spark, d, "mtime"))


_STALENESS = f"""WITH {_NEWEST}, {_OWNERS}, {_OLDEST}, a AS ({_STATES.format('oldest').replace('epoch(mtime)', 'floor(epoch(mtime))')}), b AS ({_STATES.format('newest').replace('epoch(mtime)', 'floor(epoch(mtime))')}),
named AS (SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN a.slug IS NULL THEN 'new' WHEN b.slug IS NULL THEN 'removed'
  WHEN a.latest_mtime IS NOT DISTINCT FROM b.latest_mtime AND a.file_count = b.file_count AND a.files_hash = b.files_hash THEN 'fresh' ELSE 'stale' END AS status FROM a FULL JOIN b ON a.slug = b.slug)"""


@query(f"{_STALENESS} SELECT * FROM named")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    return incremental.staleness(*_snapshots(spark, d))


@query(f"""{_STALENESS} SELECT coalesce(bool_or(status <> 'fresh'), false) AS is_stale, coalesce(string_agg(slug, ',' ORDER BY slug) FILTER (status = 'stale'), '') AS stale,
  coalesce(string_agg(slug, ',' ORDER BY slug) FILTER (status = 'new'), '') AS new, coalesce(string_agg(slug, ',' ORDER BY slug) FILTER (status = 'removed'), '') AS removed FROM named""")
def check_result(spark: SparkSession, d: str) -> DataFrame:
    found = incremental.check_result(*_snapshots(spark, d))
    return found.select("is_stale", *(F.array_join(c, ",").alias(c) for c in ("stale", "new", "removed")))


@query(f"""WITH {_NEWEST}, k AS (SELECT relative_path, substr(sha256(arg_min(content, mtime)), 1, 16) AS hash FROM files WHERE relative_path IS NOT NULL GROUP BY 1)
SELECT relative_path, substr(sha256(content), 1, 16) AS hash FROM newest n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.relative_path = n.relative_path AND k.hash = substr(sha256(n.content), 1, 16))""")
def index_cdc(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "files").where("relative_path IS NOT NULL").select("relative_path", "mtime", "scanned_at", T.content_hash("content").alias("hash"))
    documents = hashed.groupBy(F.col("relative_path").alias("path")).agg(F.min_by("hash", "mtime").alias("hash"))
    return changed_files(newest_of(hashed, "hash"), documents)


@query("SELECT DISTINCT dst AS path FROM edges WHERE dst IS NOT NULL AND dst NOT IN (SELECT relative_path FROM files WHERE relative_path IS NOT NULL)")
def index_prune(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "edges").where("dst IS NOT NULL").select(F.col("dst").alias("path")).distinct()
    return deleted_documents(documents, table(spark, d, "files"))


@query("SELECT count(DISTINCT file_path) AS total_files, count(*) AS total_chunks, CAST(coalesce(sum(strlen(content)), 0) AS BIGINT) AS index_bytes, max(updated_at) AS last_updated FROM chunks")
def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    return index_stats(table(spark, d, "chunks"))


_EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS tool_name, CAST(floor(value) AS BIGINT) AS tokens_out, CAST(strlen(props) AS BIGINT) AS bytes_out FROM events)"


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Events as telemetry: a user is a session, a type is a tool."""
    e = table(spark, d, "events")
    tokens = F.floor("value").cast("bigint")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), tokens.alias("tokens_in"), tokens.alias("tokens_out"), F.octet_length("props").cast("bigint").alias("bytes_out"))


@query(f"""WITH {_EVENTS}, t AS (SELECT session_id, tool_name, count(*) AS c, sum(tokens_out) AS o, sum(bytes_out) AS b FROM ev GROUP BY 1, 2)
SELECT session_id, CAST(sum(c) AS BIGINT) AS total_calls, CAST(sum(o) AS BIGINT) AS total_tokens_out, CAST(sum(b) AS BIGINT) AS total_bytes,
  string_agg(tool_name || ':' || c || ':' || CAST(o AS BIGINT), ',' ORDER BY c DESC, tool_name) AS tools_used FROM t GROUP BY 1""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    tools = F.array_join(F.transform("tools_used", lambda x: F.concat_ws(":", x["tool_name"], x["call_count"].cast("string"), x["total_tokens_out"].cast("string"))), ",")
    return rollups.session_summaries(telemetry(spark, d)).select("session_id", "total_calls", "total_tokens_out", "total_bytes", tools.alias("tools_used"))


@query(f"WITH {_EVENTS} SELECT session_id, tool_name, count(*) AS call_count, CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out FROM ev GROUP BY 1, 2")
def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    return rollups.session_tools(telemetry(spark, d))


@query(f"WITH {_EVENTS} SELECT count(DISTINCT session_id) AS sessions, count(*) AS total_calls, CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out, CAST(sum(tokens_out) AS BIGINT) // count(DISTINCT session_id) AS average_tokens FROM ev")
def telemetry_totals(spark: SparkSession, d: str) -> DataFrame:
    return rollups.telemetry_totals(rollups.session_summaries(telemetry(spark, d)))


def source_documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select(F.coalesce(F.lower(F.trim("source")), F.lit("(none)")).alias("slug"), F.coalesce("lang", F.lit("(none)")).alias("name"), F.col("text").alias("content"))


_TOKENS = "tk AS (SELECT coalesce(lower(trim(source)), '(none)') AS slug, coalesce(lang, '(none)') AS name, strlen(text) // 4 AS tokens, strlen(text) AS n_bytes FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_TOKENS} SELECT slug, name, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM tk GROUP BY ROLLUP (slug, name)")
def token_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollups.token_report(source_documents(spark, d))


@query(f"""WITH {_TOKENS}, p AS (SELECT slug, sum(tokens) AS t FROM tk GROUP BY 1)
SELECT count(*) AS modules, CAST(sum(t) + 777 AS BIGINT) AS total_tokens, round((sum(t) + 777) * 0.25 / 1e6, 6) AS cost, CAST(max(t) + 777 AS BIGINT) AS hierarchical_tokens,
  round((1.0 - (max(t) + 777)::DOUBLE / (sum(t) + 777)::DOUBLE) * 100, 1) AS saved_percent FROM p""")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    return rollups.token_costs(source_documents(spark, d), 777)


_LETTER = "CASE language WHEN 'Rust' THEN 'A' WHEN 'Go' THEN 'D' ELSE 'M' END"


@query(f"""WITH {_NEWEST} SELECT relative_path AS path, CASE {_LETTER} WHEN 'A' THEN 'Added' WHEN 'D' THEN 'Deleted' ELSE 'Modified' END AS status,
  coalesce(line_count, 0) AS additions, CASE WHEN line_count IS NULL THEN 0 ELSE 1 END AS deletions FROM newest""")
def diff_stat_join(spark: SparkSession, d: str) -> DataFrame:
    f = newest_files(spark, d, "language", "line_count")
    numbers = f.where("line_count IS NOT NULL").select(F.concat_ws("\t", F.col("line_count").cast("string"), F.lit("1"), "relative_path").alias("value"))
    return git.diff_stats(numbers, f.select(F.concat_ws("\t", F.expr(_LETTER), "relative_path").alias("value")))


@query(f"WITH {_NEWEST} SELECT relative_path FROM newest WHERE relative_path IN (SELECT source_file FROM markers)")
def diff_restriction(spark: SparkSession, d: str) -> DataFrame:
    diff = table(spark, d, "markers").select(F.col("source_file").alias("path"))
    return git.restrict_to(newest_files(spark, d).select("relative_path"), diff)


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").withColumn("language", T.language(T.extension("relative_path")))


@query()
def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(symbol_rows(_spoken(spark, d), "mtime", "scanned_at"), "file_path", ["mtime", "scanned_at"], ["symbols"]).select("file_path", F.inline("symbols"))
    return rows.select("file_path", "kind", "name", "signature", F.col("line_range.start").alias("start_line"), F.col("line_range.end").alias("end_line"), "visibility", "ord")


#: Declarations as their definition words them: (languages, order, kind, pattern with a marker or indent as group 1 and the name as group 2, visibility, signature, end of the block).
_DECLARED_SQL = f"""WITH {_NEWEST}, f AS (SELECT relative_path AS p, content AS c, {_LANGUAGE_SQL} AS lang, string_split(content, chr(10)) AS raw FROM newest WHERE content IS NOT NULL AND content <> ''),
l AS (SELECT p, c, CASE WHEN lang = 'TypeScript' THEN 'JavaScript' ELSE lang END AS lang, list_transform(CASE WHEN raw[-1] = '' THEN raw[1:-2] ELSE raw END, lambda x: regexp_replace(x, '\\r$', '')) AS ls FROM f),
t(lang, o, kind, pattern, vis, sig, fin) AS (VALUES
  ('Rust', 1, 'Function', '(?m)^[ \\t]*(pub(?:\\([^)]+\\))?\\s+)?(?:async\\s+)?fn\\s+(\\w+)', 'marked', 'line', 'naive'), ('Rust', 2, 'Struct', '(?m)^[ \\t]*(pub(?:\\([^)]+\\))?\\s+)?struct\\s+(\\w+)', 'marked', '', 'naive'),
  ('Rust', 3, 'Enum', '(?m)^[ \\t]*(pub(?:\\([^)]+\\))?\\s+)?enum\\s+(\\w+)', 'marked', '', 'naive'), ('Rust', 4, 'Trait', '(?m)^[ \\t]*(pub(?:\\([^)]+\\))?\\s+)?trait\\s+(\\w+)', 'marked', '', 'naive'),
  ('Rust', 5, 'Const', '(?m)^[ \\t]*(pub(?:\\([^)]+\\))?\\s+)?const\\s+(\\w+)\\s*:', 'marked', '', ''), ('Rust', 6, 'Type', '(?m)^[ \\t]*(pub(?:\\([^)]+\\))?\\s+)?type\\s+(\\w+)', 'marked', '', ''),
  ('Python', 1, 'Function', '(?m)^([ \\t]*)(?:async\\s+)?def\\s+(\\w+)\\s*\\(', 'dunder', 'line', 'indent'), ('Python', 2, 'Class', '(?m)^([ \\t]*)class\\s+(\\w+)', 'underscore', 'line', 'indent'),
  ('JavaScript', 1, 'Function', '(?m)^[ \\t]*(export\\s+)?(?:async\\s+)?function\\s+(\\w+)', 'marked', 'line', 'naive'), ('JavaScript', 2, 'Class', '(?m)^[ \\t]*(export\\s+)?(?:default\\s+)?class\\s+(\\w+)', 'marked', '', 'naive'),
  ('JavaScript', 3, 'Function', '(?m)^[ \\t]*(export\\s+)?(?:const|let|var)\\s+(\\w+)\\s*=\\s*(?:async\\s*)?\\([^)]*\\)\\s*=>', 'marked', 'line', 'naive'),
  ('JavaScript', 4, 'Function', '(?m)^[ \\t]*(export\\s+)?(?:const|let|var)\\s+(\\w+)\\s*=\\s*(?:async\\s*)?\\w+\\s*=>', 'marked', '', ''),
  ('JavaScript', 5, 'Interface', '(?m)^[ \\t]*(export\\s+)?interface\\s+(\\w+)', 'marked', '', 'naive'), ('JavaScript', 6, 'Type', '(?m)^[ \\t]*(export\\s+)?type\\s+(\\w+)\\s*=', 'marked', '', ''),
  ('Go', 1, 'Function', '(?m)^(f)unc\\s+(?:\\([^)]+\\)\\s+)?(\\w+)\\s*\\(', 'capital', 'line', 'naive'), ('Go', 2, 'Struct', '(?m)^(t)ype\\s+(\\w+)\\s+struct\\b', 'capital', '', 'naive'),
  ('Go', 3, 'Interface', '(?m)^(t)ype\\s+(\\w+)\\s+interface\\b', 'capital', '', 'naive'), ('Go', 4, 'Const', '(?m)^(c)onst\\s+(\\w+)\\s*=', 'capital', '', '')),
m AS (SELECT p, c, ls, kind, vis, sig, fin, regexp_extract_all(c, pattern, 0) AS a, regexp_extract_all(c, pattern, 1) AS v, regexp_extract_all(c, pattern, 2) AS n, string_split_regex(c, pattern) AS s FROM l JOIN t ON t.lang = l.lang),
e AS (SELECT p, c, ls, kind, vis, sig, fin, v[i] AS v, n[i] AS name, 1 + length(regexp_replace(array_to_string(s[1:i], '') || array_to_string(a[1:i - 1], ''), '[^\\n]', '', 'g')) AS line,
  length(regexp_replace(a[i], '[^\\n]', '', 'g')) AS inside, length(array_to_string(s[1:i], '')) + length(array_to_string(a[1:i], '')) AS past FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)),
b AS (SELECT *, CASE WHEN fin = 'naive' THEN regexp_extract_all(substr(c, past + 1), '[{{}}]') ELSE [] END AS br, CASE WHEN fin = 'naive' THEN string_split_regex(substr(c, past + 1), '[{{}}]') ELSE [] END AS pc FROM e),
k AS (SELECT *, list_filter(range(1, len(br) + 1), lambda x: br[x] = '}}' AND len(list_filter(br[1:x], lambda y: y = '{{')) * 2 = x)[1] AS shut,
  list_filter(range(line + 1, len(ls) + 1), lambda x: fin = 'indent' AND trim(ls[x]) <> '' AND NOT starts_with(ltrim(ls[x]), '#')) AS full_lines FROM b),
d AS (SELECT *, coalesce(list_filter(full_lines, lambda x: length(ls[x]) - length(ltrim(ls[x], ' ' || chr(9))) <= length(v))[1], 1000000000) AS out FROM k)
SELECT p AS file_path, kind, name, CASE WHEN sig = 'line' THEN trim(ls[line], ' ' || chr(9)) END AS signature, CAST(line AS INTEGER) AS start_line,
  CAST(CASE WHEN fin = 'naive' AND shut IS NOT NULL THEN line + inside + length(regexp_replace(array_to_string(pc[1:shut], ''), '[^\\n]', '', 'g')) WHEN fin = 'indent' THEN coalesce(list_max(list_filter(full_lines, lambda x: x < out)), line) ELSE line END AS INTEGER) AS end_line,
  CASE vis WHEN 'marked' THEN CASE WHEN v <> '' THEN 'Public' ELSE 'Private' END WHEN 'capital' THEN CASE WHEN regexp_matches(name, '^\\p{{Lu}}') THEN 'Public' ELSE 'Private' END
  WHEN 'dunder' THEN CASE WHEN starts_with(name, '_') AND NOT starts_with(name, '__') THEN 'Private' ELSE 'Public' END ELSE CASE WHEN starts_with(name, '_') THEN 'Private' ELSE 'Public' END END AS visibility FROM d"""


@query(_DECLARED_SQL)
def declared_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of the languages whose declarations SQL can state: Rust, Python, JavaScript, TypeScript and Go."""
    files = _spoken(spark, d).where(F.col("language").isin("Rust", "Python", "JavaScript", "TypeScript", "Go"))
    rows = latest(symbol_rows(files, "mtime", "scanned_at"), "file_path", ["mtime", "scanned_at"], ["symbols"]).select("file_path", F.inline("symbols"))
    return rows.select("file_path", "kind", "name", "signature", F.col("line_range.start").alias("start_line"), F.col("line_range.end").alias("end_line"), "visibility")


#: The same for languages whose blocks end by braces outside of quoted strings; group 1 is a marker, group 2 a type or nothing, group 3 the name.
_BRACED_SQL = f"""WITH {_NEWEST}, f AS (SELECT relative_path AS p, content AS c, {_LANGUAGE_SQL} AS lang FROM newest WHERE content IS NOT NULL AND content <> ''),
t(lang, o, kind, pattern, vis, sig, back) AS (VALUES
  ('Java', 1, 'Class', '(?m)^\\s*(public|private|protected)?\\s*(?:abstract|final)?\\s*()class\\s+(\\w+)', 'Internal', 'whole', 0), ('Java', 2, 'Interface', '(?m)^\\s*(public|private|protected)?\\s*(?:abstract|final)?\\s*()interface\\s+(\\w+)', 'Internal', 'whole', 0),
  ('Java', 3, 'Enum', '(?m)^\\s*(public|private|protected)?\\s*(?:abstract|final)?\\s*()enum\\s+(\\w+)', 'Internal', 'whole', 0), ('Java', 5, 'Interface', '(?m)^\\s*@()()interface\\s+(\\w+)', 'Public', '', NULL),
  ('Java', 4, 'Method', '(?m)^\\s*(public|private|protected)?\\s*(?:static)?\\s*(?:final)?\\s*(?:abstract)?\\s*(\\w+(?:<[^>]+>)?)\\s+(\\w+)\\s*\\(', 'Internal', 'calling', 0),
  ('Php', 1, 'Class', '(?m)^\\s*(abstract\\s+)?(?:final\\s+)?()class\\s+(\\w+)', 'Public', 'php', 0), ('Php', 2, 'Interface', '(?m)^\\s*()()interface\\s+(\\w+)', 'Public', 'interface ', 0),
  ('Php', 3, 'Trait', '(?m)^\\s*()()trait\\s+(\\w+)', 'Public', 'trait ', 0), ('Php', 4, 'Function', '(?m)^\\s*(public|private|protected|static|\\s)*\\s*()function\\s+(\\w+)\\s*\\(', 'Public', 'calling', 0),
  ('Php', 5, 'Const', '(?m)^\\s*(public|private|protected)?\\s*()const\\s+(\\w+)\\s*=', 'Public', '', NULL),
  ('C', 1, 'Function', '(?m)^(static\\s+)?(?:inline\\s+)?(?:const\\s+)?(\\w+(?:\\s*\\*)*)\\s+(\\w+)\\s*\\([^)]*\\)\\s*\\{{', 'static', '{{', 1),
  ('C', 2, 'Function', '(?m)^(?:extern\\s+)?(static\\s+)?(\\w+(?:\\s*\\*)*)\\s+(\\w+)\\s*\\([^)]*\\)\\s*;', 'static', ';', NULL),
  ('C', 3, 'Struct', '(?m)^()()(?:typedef\\s+)?struct\\s+(\\w+)?\\s*\\{{', 'Public', 'struct ', 1), ('C', 4, 'Enum', '(?m)^()()(?:typedef\\s+)?enum\\s+(\\w+)?\\s*\\{{', 'Public', 'enum ', 1), ('C', 5, 'Type', '(?m)^()()typedef\\s+.+?\\s+(\\w+)\\s*;', 'Public', '', NULL)),
m AS (SELECT p, c, f.lang, o, kind, vis, sig, back, regexp_extract_all(c, pattern, 0) AS a, regexp_extract_all(c, pattern, 1) AS v, regexp_extract_all(c, pattern, 2) AS x, regexp_extract_all(c, pattern, 3) AS n, string_split_regex(c, pattern) AS s FROM f JOIN t ON t.lang = f.lang),
e AS (SELECT p, c, lang, o, kind, vis, sig, back, regexp_replace(a[i], '^\\s+|\\s+$', '', 'g') AS head, trim(v[i], ' ' || chr(9) || chr(10) || chr(13)) AS v, x[i] AS x, coalesce(nullif(n[i], ''), 'anonymous') AS name,
  1 + length(regexp_replace(array_to_string(s[1:i], '') || array_to_string(a[1:i - 1], ''), '[^\\n]', '', 'g')) AS line, length(regexp_replace(substr(a[i], 1, length(a[i]) - coalesce(back, 0)), '[^\\n]', '', 'g')) AS inside,
  length(array_to_string(s[1:i], '')) + length(array_to_string(a[1:i], '')) - coalesce(back, 0) AS past FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)),
w AS (SELECT * FROM e WHERE NOT (lang = 'Java' AND o = 4 AND (x IN ('class', 'interface', 'enum', 'new') OR name IN ('if', 'for', 'while', 'switch', 'catch'))) AND NOT (lang = 'C' AND o = 1 AND name IN ('if', 'for', 'while', 'switch'))
  QUALIFY lang <> 'C' OR row_number() OVER (PARTITION BY p, name, line ORDER BY o) = 1),
q AS (SELECT *, '(?s)[{{}}]|"(?:[^"\\\\]|\\\\+[^\\\\])*(?:"|\\\\*\\z)|''(?:[^''\\\\]|\\\\+[^\\\\])*(?:''|\\\\*\\z)' AS quoted FROM w),
b AS (SELECT *, CASE WHEN back IS NULL THEN [] ELSE regexp_extract_all(substr(c, past + 1), quoted) END AS br, CASE WHEN back IS NULL THEN [] ELSE string_split_regex(substr(c, past + 1), quoted) END AS pc FROM q),
k AS (SELECT *, list_filter(range(1, len(br) + 1), lambda y: br[y] = '}}' AND len(list_filter(br[1:y], lambda z: z = '{{')) = len(list_filter(br[1:y], lambda z: z = '}}')))[1] AS shut FROM b)
SELECT p AS file_path, kind, name, CASE sig WHEN '' THEN NULL WHEN 'whole' THEN head WHEN 'calling' THEN rtrim(head, '(') || '(...)' WHEN 'php' THEN CASE WHEN v <> '' THEN 'abstract class ' || name ELSE head END
  WHEN '{{' THEN regexp_replace(rtrim(head, '{{'), '\\s+$', '') WHEN ';' THEN regexp_replace(rtrim(head, ';'), '\\s+$', '') ELSE sig || name END AS signature, CAST(line AS INTEGER) AS start_line,
  CAST(CASE WHEN shut IS NULL THEN line ELSE line + inside + length(regexp_replace(array_to_string(pc[1:shut], '') || array_to_string(br[1:shut - 1], ''), '[^\\n]', '', 'g')) END AS INTEGER) AS end_line,
  CASE WHEN vis = 'static' THEN CASE WHEN v <> '' THEN 'Private' ELSE 'Public' END WHEN v = 'public' THEN 'Public' WHEN v = 'private' THEN 'Private' WHEN v = 'protected' THEN 'Protected' ELSE vis END AS visibility FROM k"""


@query(_BRACED_SQL)
def braced_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of the languages whose blocks end by braces outside of strings, as SQL can state them: Java, PHP and C."""
    files = _spoken(spark, d).where(F.col("language").isin("Java", "Php", "C"))
    rows = latest(symbol_rows(files, "mtime", "scanned_at"), "file_path", ["mtime", "scanned_at"], ["symbols"]).select("file_path", F.inline("symbols"))
    return rows.select("file_path", "kind", "name", "signature", F.col("line_range.start").alias("start_line"), F.col("line_range.end").alias("end_line"), "visibility")


_RUBY_SQL = f"""WITH {_NEWEST}, f AS (SELECT relative_path AS p, content AS c, string_split(content, chr(10)) AS raw FROM newest WHERE content IS NOT NULL AND content <> '' AND {_LANGUAGE_SQL} = 'Ruby'),
l AS (SELECT p, c, list_transform(CASE WHEN raw[-1] = '' THEN raw[1:-2] ELSE raw END, lambda x: trim(x, ' ' || chr(9) || chr(13))) AS ls FROM f),
t(o, kind, pattern, scoped, sig) AS (VALUES (1, 'Class', '(?m)^class\\s+([A-Z]\\w*)(?:\\s*<\\s*\\w+)?', false, 'class '), (2, 'Module', '(?m)^module\\s+([A-Z]\\w*)', false, 'module '),
  (3, 'Function', '(?m)^\\s*def\\s+(self\\.\\w+[?!=]?)(?:\\s*\\(|$|\\s)', true, 'def '), (4, 'Method', '(?m)^\\s*def\\s+(\\w+[?!=]?)(?:\\s*\\(|$|\\s)', true, 'def '), (5, 'Const', '(?m)^\\s*attr_(?:reader|writer|accessor)\\s+(.+)', false, NULL)),
m AS (SELECT p, ls, o, kind, scoped, sig, regexp_extract_all(c, pattern, 0) AS a, regexp_extract_all(c, pattern, 1) AS n, string_split_regex(c, pattern) AS s FROM l, t),
e AS (SELECT p, ls, o, kind, scoped, sig, n[i] AS raw, 1 + length(regexp_replace(array_to_string(s[1:i], '') || array_to_string(a[1:i - 1], ''), '[^\\n]', '', 'g')) AS line FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m)),
u AS (SELECT p, ls, o, kind, scoped, sig, line, unnest(CASE WHEN o = 5 THEN list_transform(string_split(raw, ','), lambda x: trim(ltrim(trim(x), ':'))) ELSE [raw] END) AS name FROM e),
w AS (SELECT * FROM u WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY p, name, line ORDER BY o) = 1),
d AS (SELECT *, list_filter(range(line, len(ls) + 1), lambda y: o < 5 AND regexp_matches(ls[y], '^end(?:$| |#)') AND len(list_filter(ls[line:y], lambda z: regexp_matches(z, '^(?:class |module |def |do|if |unless |case |begin)')))
    = len(list_filter(ls[line:y], lambda z: regexp_matches(z, '^end(?:$| |#)'))))[1] AS shut,
  ls[list_filter(range(1, line), lambda y: scoped AND regexp_matches(ls[y], '^(?:(?:private|protected|public)(?:$| )|class |module )'))[-1]] AS scope FROM w)
SELECT p AS file_path, kind, name, sig || name AS signature, CAST(line AS INTEGER) AS start_line, CAST(coalesce(shut, line) AS INTEGER) AS end_line,
  CASE WHEN starts_with(scope, 'private') THEN 'Private' WHEN starts_with(scope, 'protected') THEN 'Internal' ELSE 'Public' END AS visibility FROM d"""


@query(_RUBY_SQL)
def ruby_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of Ruby, whose blocks end by a keyword and whose visibility is set by the lines above."""
    files = _spoken(spark, d).where("language = 'Ruby'")
    rows = latest(symbol_rows(files, "mtime", "scanned_at"), "file_path", ["mtime", "scanned_at"], ["symbols"]).select("file_path", F.inline("symbols"))
    return rows.select("file_path", "kind", "name", "signature", F.col("line_range.start").alias("start_line"), F.col("line_range.end").alias("end_line"), "visibility")


_IMPORTS_SQL = f"""WITH {_NEWEST},
f AS (SELECT relative_path AS p, content AS c, lower(nullif(regexp_extract(relative_path, '[^/]\\.([^./]+)$', 1), '')) AS x FROM newest WHERE content IS NOT NULL),
t(ext, ord, pattern) AS (VALUES
  ('rs', 1, '(?m)^[ \\t]*(?:pub\\s+)?use\\s+(?:crate::)?(\\w+)'), ('rs', 2, '(?m)^[ \\t]*(?:pub\\s+)?mod\\s+(\\w+)\\s*;'),
  ('py', 1, '(?m)^[ \\t]*import\\s+([\\w.]+)'), ('py', 2, '(?m)^[ \\t]*from\\s+([\\w.]+)\\s+import'),
  ('js', 1, '(?m)^[ \\t]*import\\s+(?:(?:\\{{[^}}]*\\}}|[\\w*]+)\\s+from\\s+)?[''"]([^''"]+)[''"]'), ('js', 2, 'require\\s*\\(\\s*[''"]([^''"]+)[''"]\\s*\\)'),
  ('go', 1, '(?m)^import\\s+"([^"]+)"')),
g AS (SELECT p, c, CASE WHEN x IN ('jsx', 'mjs', 'cjs', 'ts', 'tsx', 'mts', 'cts') THEN 'js' ELSE x END AS ext FROM f),
m AS (SELECT p, ext, ord * 1e9 + i AS o, l[i] AS raw FROM (SELECT p, g.ext, ord, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT p, g.ext, ord, regexp_extract_all(c, pattern, 1) AS l FROM g JOIN t ON t.ext = g.ext) g)
  UNION ALL SELECT p, 'go', 2e9 + i * 1e6 + j, k[j] FROM (SELECT p, i, k, unnest(range(1, len(k) + 1)) AS j FROM (SELECT p, i, regexp_extract_all(b[i], '(?m)^\\s*"([^"]+)"\\s*$', 1) AS k FROM
    (SELECT p, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT p, regexp_extract_all(c, '(?s)import\\s*\\(([^)]+)\\)', 1) AS b FROM g WHERE ext = 'go'))))),
n AS (SELECT p, min(o) AS o, CASE ext WHEN 'py' THEN split_part(raw, '.', 1) WHEN 'go' THEN string_split(raw, '/')[-1] ELSE raw END AS target FROM m GROUP BY p, 3 HAVING target <> ''),
r AS (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY o) - 1 AS INTEGER) AS ord, target FROM n)
SELECT p AS src, CASE WHEN target LIKE './%' OR target LIKE '../%' OR NOT (contains(target, '/') OR contains(target, '.')) THEN
  regexp_replace(replace(replace(CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') || '/' || target ELSE target END, chr(92), '/'), '//', '/'), '^(\\./)+', '') ELSE target END AS dst, ord FROM r"""


@query(_IMPORTS_SQL)
def extracted_imports(spark: SparkSession, d: str) -> DataFrame:
    f = _spoken(spark, d)
    rows = latest(import_rows(f, "mtime", "scanned_at"), "file_path", ["mtime", "scanned_at"], ["imports"]).select("file_path", F.posexplode("imports").alias("ord", "target"))
    return graph.import_edges(rows)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    f, owners = newest_files(spark, d, "line_count"), module_owners(spark, d)
    large = f.where("line_count > 100")
    every = reports.outlines(distinct_symbols(spark, d), owners, large).unionByName(reports.module_memories(distinct_markers(spark, d), owners))
    return every.unionByName(reports.module_imports(table(spark, d, "edges"), owners))


@query()
def module_documents(spark: SparkSession, d: str) -> DataFrame:
    return reports.module_documents(table(spark, d, "modules"), newest_files(spark, d, "line_count", "is_large"), _parts(spark, d))


#: How the documents tell to read on, and where they are.
_STEPS = """'1. Begin with this index: it names every module' || chr(10) || '2. Open `modules/{name}/MODULE.md` of the part you work on' || chr(10) || '3. Look for warnings in its `memory.md` before you edit' || chr(10)
  || '4. Find symbols of large files in its `outline.md`' || chr(10)"""
_INDEX_SQL = f"""WITH {_LAYOUT}, {_OWNERS}, {_MARKS}, ep AS (SELECT DISTINCT relative_path FROM newest WHERE len(list_filter(['main.rs', 'lib.rs', 'mod.rs', 'index.js', 'index.ts', 'index.tsx', 'main.py', '__init__.py', 'app.py',
  'main.go', 'cmd/main.go'], lambda e: ends_with(relative_path, e))) > 0),
en AS (SELECT string_agg('- `' || relative_path || '`', chr(10) ORDER BY relative_path) AS t FROM (SELECT * FROM ep WHERE NOT (SELECT bool_or(relative_path LIKE '%lib.rs') FROM ep) OR relative_path NOT LIKE '%mod.rs' ORDER BY 1 LIMIT 5)),
wn AS (SELECT slug, count(*) AS n FROM marks JOIN owners ON relative_path = source_file WHERE priority = 'High' GROUP BY 1),
hub AS (SELECT DISTINCT slug FROM owners JOIN (SELECT dst FROM edges WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 3) ON relative_path = dst),
mt AS (SELECT string_agg('| [' || CASE WHEN m.slug = 'root' THEN 'root' ELSE path END || '](modules/' || m.slug || '/MODULE.md) | ' || coalesce(boundary_type, '') || ' | ' || len(files) || ' | ' || coalesce(CAST(n AS VARCHAR), '-') || ' | '
  || CASE WHEN hub.slug IS NULL THEN '' ELSE '★' END || ' |', chr(10) ORDER BY path, m.slug) AS t FROM modules m LEFT JOIN wn ON wn.slug = m.slug LEFT JOIN hub ON hub.slug = m.slug),
dp AS (SELECT string_agg('    ' || regexp_replace(a, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || '[' || a || '] --> ' || regexp_replace(b, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || '[' || b || ']', chr(10) ORDER BY a, b) AS t FROM (
  SELECT DISTINCT x.slug AS a, y.slug AS b FROM edges e JOIN owners x ON x.relative_path = e.src JOIN owners y ON y.relative_path = e.dst WHERE x.slug <> y.slug))
SELECT 'INDEX.md' AS path, '# Project' || chr(10) || chr(10) || '## Reading Protocol' || chr(10) || chr(10) || """ + _STEPS + """ || chr(10) || coalesce('## Entry Points' || chr(10) || chr(10) || (SELECT t FROM en) || chr(10) || chr(10), '')
  || '## ⚠️ Critical Alerts' || chr(10) || chr(10) || '**' || (SELECT count(*) FROM marks WHERE priority = 'High') || '** high-priority warnings across ' || (SELECT count(*) FROM wn WHERE slug IN (SELECT slug FROM modules))
  || ' modules. Each module''s `memory.md` lists its own.' || chr(10) || chr(10) || '## Modules' || chr(10) || chr(10) || '| Module | Type | Files | Warnings | Hub |' || chr(10) || '| ------ | ---- | ----- | -------- | --- |' || chr(10)
  || (SELECT t FROM mt) || chr(10) || chr(10) || coalesce('## Module Dependencies' || chr(10) || chr(10) || '```mermaid' || chr(10) || 'graph TD' || chr(10) || (SELECT t FROM dp) || chr(10) || '```' || chr(10) || chr(10), '') || '---' || chr(10) AS content"""


@query(_INDEX_SQL)
def index_document(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    return reports.index_document(layout(spark, d), distinct_markers(spark, d), table(spark, d, "modules"), edges, graph.hub_files(edges))


@query(f"""WITH {_OWNERS}, {_MARKS}, k AS (SELECT slug, priority, source_file, line_number, coalesce(content, '') AS c, kind FROM marks JOIN owners ON relative_path = source_file),
s AS (SELECT slug, priority, string_agg('### `' || kind || '` (' || source_file || ':' || line_number || ')' || chr(10) || chr(10) || '> ' || c || chr(10), chr(10) ORDER BY source_file, line_number, c, kind) AS t FROM k GROUP BY 1, 2)
SELECT slug, 'memory' AS part, '# Memory' || chr(10) || chr(10) || '[← Back to MODULE](MODULE.md) | [← Back to INDEX](../../INDEX.md)' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || '| High 🔴 | Medium 🟡 | Low 🟢 |' || chr(10)
  || '| ' || count(*) FILTER (priority = 'High') || ' | ' || count(*) FILTER (priority = 'Medium') || ' | ' || count(*) FILTER (priority = 'Low') || ' |' || chr(10) || chr(10)
  || coalesce('## 🔴 High Priority' || chr(10) || chr(10) || (SELECT t FROM s WHERE s.slug = k.slug AND s.priority = 'High') || chr(10), '')
  || coalesce('## 🟡 Medium Priority' || chr(10) || chr(10) || (SELECT t FROM s WHERE s.slug = k.slug AND s.priority = 'Medium') || chr(10), '')
  || coalesce('## 🟢 Low Priority' || chr(10) || chr(10) || (SELECT t FROM s WHERE s.slug = k.slug AND s.priority = 'Low') || chr(10), '') AS content FROM k GROUP BY slug""")
def module_memories(spark: SparkSession, d: str) -> DataFrame:
    return reports.module_memories(distinct_markers(spark, d), module_owners(spark, d))


@query(f"""WITH {_OWNERS}, t AS (SELECT DISTINCT slug, dst AS name FROM edges e JOIN owners o ON o.relative_path = e.src WHERE dst IS NOT NULL),
r AS (SELECT slug, CASE WHEN EXISTS (SELECT 1 FROM owners x WHERE x.slug = t.slug AND contains(x.relative_path, t.name)) THEN 'internal' ELSE 'external' END AS kind, name FROM t
  UNION ALL SELECT DISTINCT o.slug, 'consumers', e.src FROM edges e JOIN owners o ON o.relative_path = e.dst WHERE e.src IS NOT NULL AND NOT EXISTS (SELECT 1 FROM owners x WHERE x.slug = o.slug AND x.relative_path = e.src)),
n AS (SELECT slug, kind, name, CASE WHEN contains(name, '/') THEN string_split(name, '/')[-2] ELSE name END AS label FROM r),
a AS (SELECT slug, string_agg(CASE WHEN kind = 'external' THEN '    ' || own || ' --> ' || node ELSE '    ' || node || ' --> ' || own END || chr(10), '' ORDER BY kind DESC, first) AS t FROM (
  SELECT slug, kind, min(name) AS first, regexp_replace(slug, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || '[' || slug || ']' AS own, regexp_replace(label, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || '[' || label || ']' AS node FROM n WHERE kind <> 'internal' GROUP BY slug, kind, label) GROUP BY slug),
l AS (SELECT slug, kind, string_agg('- `' || name || '`' || chr(10), '' ORDER BY name) || chr(10) AS t FROM n GROUP BY 1, 2), m AS (SELECT DISTINCT slug FROM owners),
b AS (SELECT m.slug, coalesce('## Dependency Graph' || chr(10) || chr(10) || '```mermaid' || chr(10) || 'graph TD' || chr(10) || (SELECT t FROM a WHERE a.slug = m.slug) || '```' || chr(10) || chr(10), '')
  || coalesce('## Internal Dependencies' || chr(10) || chr(10) || 'Imports that stay inside this module:' || chr(10) || chr(10) || (SELECT t FROM l WHERE l.slug = m.slug AND kind = 'internal'), '')
  || coalesce('## External Dependencies' || chr(10) || chr(10) || 'Imports that leave this module:' || chr(10) || chr(10) || (SELECT t FROM l WHERE l.slug = m.slug AND kind = 'external'), '')
  || coalesce('## Consumers' || chr(10) || chr(10) || 'Files elsewhere that import from this module:' || chr(10) || chr(10) || (SELECT t FROM l WHERE l.slug = m.slug AND kind = 'consumers'), '') AS t FROM m)
SELECT slug, 'imports' AS part, '# Imports' || chr(10) || chr(10) || '[← Back to MODULE](MODULE.md) | [← Back to INDEX](../../INDEX.md)' || chr(10) || chr(10) || CASE WHEN t = '' THEN '_No import relationships detected._' || chr(10) ELSE t END AS content FROM b""")
def module_imports(spark: SparkSession, d: str) -> DataFrame:
    return reports.module_imports(table(spark, d, "edges"), module_owners(spark, d))


@query()
def file_documents(spark: SparkSession, d: str) -> DataFrame:
    f = newest_files(spark, d, "language", "line_count")
    complex_ = sources.complex_files(f, distinct_symbols(spark, d), 300, 10).select("relative_path")
    return reports.file_documents(f.join(complex_, "relative_path", "left_semi"), distinct_symbols(spark, d), distinct_markers(spark, d))


@query()
def agent_document(spark: SparkSession, d: str) -> DataFrame:
    return reports.agent_document(newest_files(spark, d, "is_large"), distinct_markers(spark, d), table(spark, d, "modules"), "tables", "0000000", "2024-01-01T00:00:00Z")


@query()
def project_json(spark: SparkSession, d: str) -> DataFrame:
    return reports.project_json(newest_files(spark, d, "is_large", "line_count"), distinct_markers(spark, d), distinct_symbols(spark, d), table(spark, d, "modules"), table(spark, d, "edges"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; a pattern as path serves a single file as well as a folder."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def _checkpoint(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS tool_name, count(*) AS call_count, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_tokens_out FROM events GROUP BY 1, 2")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = _event_stream(spark, d)
    told = events.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), F.floor("value").cast("bigint").alias("tokens_out"))
    return watch.collected(watch.session_totals(told), _checkpoint(spark, "sessions"), ["session_id", "tool_name"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    events = _event_stream(spark, d)
    counts = watch.windowed_counts(events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type", "1 hour")
    return watch.collected(counts, _checkpoint(spark, "windows"), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT event_type, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 2 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events))
SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 2 MINUTE AS "end", count(*) AS n FROM g GROUP BY event_type, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows = watch.session_windows(events, "ts", "event_type", "2 minutes")
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"""WITH {_NEWEST}, oldest AS (SELECT relative_path, arg_min(content, mtime) AS content FROM files WHERE relative_path IS NOT NULL GROUP BY 1),
c AS (SELECT n.relative_path FROM newest n JOIN oldest o USING (relative_path) WHERE n.content IS DISTINCT FROM o.content)
SELECT (SELECT count(*) FROM c) AS processed, (SELECT count(*) FROM newest) - (SELECT count(*) FROM c) AS skipped, CAST(0 AS BIGINT) AS errors, (SELECT count(*) FROM newest) AS documents""")
def index_run(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("relative_path IS NOT NULL")
    old = f.groupBy("relative_path").agg(F.min_by(F.struct("content", "mtime"), "mtime").alias("r")).select("relative_path", "r.content", "r.mtime")
    store = ChunkIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    symbols = distinct_symbols(spark, d).limit(0)
    store.update(old, symbols, HashingEmbedder())
    done = store.update(newest_files(spark, d, "content", "mtime"), symbols, HashingEmbedder())
    numbers = spark.createDataFrame([(done["processed"], done["skipped"], done["errors"])], "processed bigint, skipped bigint, errors bigint")
    return numbers.join(store.documents().agg(F.count("*").alias("documents")))


@query(f"WITH {_NEWEST}, {_OWNERS} SELECT slug, relative_path, line_count, language FROM newest JOIN owners USING (relative_path)")
def files_of_modules(spark: SparkSession, d: str) -> DataFrame:
    return newest_files(spark, d, "line_count", "language").join(module_owners(spark, d), "relative_path").select("slug", "relative_path", "line_count", "language")


@query(f"""WITH {_NEWEST} SELECT DISTINCT n.relative_path, s.name, s.kind, s.line_range.start AS start_line FROM newest n JOIN symbols s ON s.file_path = n.relative_path WHERE n.is_large""")
def large_file_symbols(spark: SparkSession, d: str) -> DataFrame:
    large = newest_files(spark, d, "is_large").where("is_large").select("relative_path")
    s = table(spark, d, "symbols").select(F.col("file_path").alias("relative_path"), "name", "kind", F.col("line_range.start").alias("start_line"))
    return large.join(s, "relative_path").distinct()


@query(f"WITH {_OWNERS} SELECT dst, importers, slug FROM (SELECT dst, count(*) AS importers FROM edges WHERE dst IS NOT NULL GROUP BY dst HAVING count(*) >= 3) JOIN owners ON relative_path = dst")
def hub_modules(spark: SparkSession, d: str) -> DataFrame:
    hubs = graph.hub_files(table(spark, d, "edges"))
    return hubs.join(module_owners(spark, d).withColumnRenamed("relative_path", "dst"), "dst").select("dst", "importers", "slug")


@query(f"""WITH {_NEWEST}, m AS (SELECT DISTINCT path FROM modules), f AS (SELECT relative_path, {_DIR.format('relative_path')} AS dir FROM newest)
SELECT relative_path, coalesce(arg_max(path, length(path)), '') AS path FROM f LEFT JOIN m ON dir = path OR (path <> '' AND starts_with(dir, path || '/')) GROUP BY 1""")
def direct_files(spark: SparkSession, d: str) -> DataFrame:
    return modules.direct_files(newest_files(spark, d), table(spark, d, "modules").select("path").distinct())


@query(f"WITH {_OWNERS}, {_MARKS} SELECT slug, count(*) AS n FROM marks JOIN owners ON relative_path = source_file WHERE priority = 'High' GROUP BY 1")
def warned_modules(spark: SparkSession, d: str) -> DataFrame:
    return rollups.warned_modules(module_owners(spark, d), distinct_markers(spark, d))


@query("""SELECT doc_id, substr(text, 1, 200) AS preview, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS params, strlen(text) BETWEEN 1 AND 499 AS inline,
  strlen(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL""")
def previews(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", T.preview("text").alias("preview"), T.params_preview("text").alias("params"), T.is_inline("text").alias("inline"), T.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, regexp_replace(text, '\\A(?:(?:[#\\[][^\\n]*)?(?:\\n|\\z))+', '') AS body FROM documents WHERE text IS NOT NULL")
def stripped_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.strip_navigation("text").alias("body"))


@query()
def bpe_tokens(spark: SparkSession, d: str) -> DataFrame:
    from codestrata.functions.tokens import token_count

    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.token_estimate("text").alias("estimate"), token_count(F.col("text")).alias("tokens"))
    return t


@query(f"""WITH {_NEWEST} SELECT relative_path FROM newest WHERE lower({_LANGUAGE_SQL}) IN ('rust', 'python') AND NOT contains(relative_path, '/gen/')
  AND NOT regexp_matches(relative_path, '(?:^|/)\\.[^/]') AND len(string_split(relative_path, '/')) <= 6""")
def scan_filters(spark: SparkSession, d: str) -> DataFrame:
    f, p = newest_files(spark, d), F.col("relative_path")
    return f.where(sources.included(p, ["Rust", "Python"], ["*/gen/*"]) & ~p.rlike(r"(?:^|/)\.[^/]") & (F.size(F.split(p, "/")) <= 6)).select("relative_path")


@query()
def output_file_count(spark: SparkSession, d: str) -> DataFrame:
    return rollups.output_files(_parts(spark, d), sources.complex_files(newest_files(spark, d, "line_count"), distinct_symbols(spark, d), 300, 10), True)


@query(f"WITH {_TOKENS} SELECT slug, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM tk GROUP BY slug")
def largest_modules(spark: SparkSession, d: str) -> DataFrame:
    return rollups.largest_modules(rollups.token_report(source_documents(spark, d)))


@query("""WITH s AS (SELECT DISTINCT file_path, kind, name, signature, line_range, visibility, doc_comment FROM symbols WHERE file_path IS NOT NULL),
r AS (SELECT file_path, line_range.start AS a, name, kind, CASE visibility WHEN 'Public' THEN 'pub' WHEN 'Private' THEN '(private)' WHEN 'Protected' THEN '(protected)' WHEN 'Internal' THEN '(internal)' ELSE '' END AS v FROM s)
SELECT file_path, '# ' || file_path || chr(10) || chr(10) || '| Line | Kind | Name | Visibility |' || chr(10) || '| ---- | ---- | ---- | ---------- |' || chr(10)
  || string_agg('| ' || a || ' | ' || kind || ' | ' || name || ' | ' || v || ' |', chr(10) ORDER BY a, name, kind, v) || chr(10) AS content FROM r GROUP BY file_path""")
def symbol_outlines(spark: SparkSession, d: str) -> DataFrame:
    return reports.symbol_outlines(distinct_symbols(spark, d))


_LINES = "list_transform(CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END, lambda x: regexp_replace(x, '\\\\r$', ''))"


@query(f"""SELECT to_json({{'score': printf('%.3f', score), 'id': id, 'preview': substr(array_to_string(({_LINES})[4:8], chr(10)), 1, 200)}}) AS document
FROM (SELECT id, score FROM {_TEXT_SCORE} WHERE n > 0 ORDER BY score DESC, id LIMIT 20) JOIN documents ON doc_id = id""")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return reports.search_json(search.text_search(rows, WORDS, 20).select("id", "score", T.cli_preview("content").alias("preview")))
