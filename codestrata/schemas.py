"""Schemas of the relations, and the fixed values of their domains."""

from __future__ import annotations

FILES = "relative_path string, extension string, language string, size_bytes bigint, line_count bigint, is_large boolean, mtime timestamp, content string"
SYMBOLS = "file_path string, kind string, name string, signature string, line_range struct<start:int,end:int>, visibility string, doc_comment string"
MARKERS = "kind string, content string, source_file string, line_number int, priority string"
EDGES = "src string, dst string, ord int"
CHUNKS = "id string, file_path string, start_line int, end_line int, content string, hash string, chunk_type string"
MANIFEST = "slug string, latest_mtime bigint, file_count bigint, files_hash string"
TELEMETRY = "timestamp timestamp, session_id string, tool_name string, params_preview string, tokens_in bigint, tokens_out bigint, bytes_out bigint, duration_ms bigint"
DIFF = "path string, status string, additions bigint, deletions bigint"

#: Language of an extension (lower case).
LANGUAGE_BY_EXTENSION = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript",
    "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "go": "Go", "php": "Php", "phtml": "Php", "java": "Java", "cs": "CSharp",
    "c": "C", "h": "Cpp", "hpp": "Cpp", "hh": "Cpp", "hxx": "Cpp", "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "rb": "Ruby", "rake": "Ruby",
    "dart": "Dart", "swift": "Swift",
}

#: Priority, category and sign of a marker kind.
MARKER_KINDS = {
    "Warning": ("High", "Warnings", "⚠️"),
    "Safety": ("High", "Warnings", "⚠️"),
    "BusinessRule": ("High", "Business Rules", "📋"),
    "Invariant": ("High", "Business Rules", "📋"),
    "Deprecated": ("High", "Technical Debt", "🔧"),
    "Todo": ("Medium", "Technical Debt", "🔧"),
    "Fixme": ("Medium", "Technical Debt", "🔧"),
    "Hack": ("Medium", "Technical Debt", "🔧"),
    "Note": ("Low", "Notes", "📝"),
}
PRIORITY_RANK = {"High": 0, "Medium": 1, "Low": 2}
CATEGORY_ORDER = ("Warnings", "Business Rules", "Technical Debt", "Notes")

#: What a folder of a name holds.
DESCRIPTIONS = {
    "src": "Source root", "lib": "Source root",
    "cli": "Command-line interface", "cmd": "Command-line interface",
    "api": "API endpoints",
    "auth": "Authentication logic", "authentication": "Authentication logic",
    "db": "Database layer", "database": "Database layer",
    "models": "Data models", "entities": "Data models",
    "utils": "Utility functions", "helpers": "Utility functions", "common": "Utility functions",
    "config": "Configuration", "settings": "Configuration",
    "tests": "Test files", "test": "Test files", "__tests__": "Test files",
    "types": "Type definitions",
    "handlers": "Request handlers", "controllers": "Request handlers",
    "services": "Business logic services",
    "middleware": "Middleware functions",
    "routes": "Route definitions", "router": "Route definitions",
    "components": "UI components",
    "hooks": "React hooks",
    "pages": "Page/view components", "views": "Page/view components",
    "store": "State management", "state": "State management",
    "styles": "Styling", "css": "Styling",
    "assets": "Static assets", "public": "Static assets", "static": "Static assets",
    "scripts": "Build/utility scripts",
    "docs": "Documentation", "documentation": "Documentation",
    "analyze": "Analysis/parsing logic", "analysis": "Analysis/parsing logic",
    "generate": "Generation logic", "generator": "Generation logic",
    "emit": "Output/emission logic", "output": "Output/emission logic",
    "scan": "File scanning", "scanner": "File scanning",
    "lang": "Language-specific handlers",
}

#: Names of files that programs start from.
ENTRY_POINTS = ("main.rs", "lib.rs", "mod.rs", "index.js", "index.ts", "index.tsx", "main.py", "__init__.py", "app.py", "main.go", "cmd/main.go")
#: File names that make their folder a module, by type of module.
BOUNDARIES = {
    "RustModule": ("mod.rs",),
    "PythonPackage": ("__init__.py",),
    "JsModule": ("index.js", "index.jsx", "index.ts", "index.tsx", "index.mjs", "index.mts"),
}
#: Chunk type of a symbol kind.
CHUNK_TYPES = {"Function": "Function", "Method": "Method", "Class": "Class", "Struct": "Struct"}
#: Smallest number of direct files of an implicit module, importers of a hub, default limits.
IMPLICIT_FILES, HUB_IMPORTERS, MINIFIED_MEAN, BINARY_PREFIX = 5, 3, 200, 8192
LARGE_LINES, COMPLEX_LINES, COMPLEX_SYMBOLS, INLINE_BYTES, RRF_K = 500, 1000, 50, 500, 60
PRICE_PER_MILLION = 0.25
