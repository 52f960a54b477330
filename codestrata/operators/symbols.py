"""Symbols and imports of source files, by a table of rules for twelve languages.

One row of RULES is one kind of declaration: its pattern, what it emits and how
its visibility, signature and end are found. A file is one row, so the parser
runs in Arrow batches of files without any shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import schemas

Match = re.Match[str]
CONTROL = frozenset({"if", "for", "while", "switch", "catch"})
KEYWORDS = {"public": "Public", "private": "Private", "protected": "Protected", "internal": "Internal"}


class Text:
    """A file's content with its line starts, and the ends of its blocks."""

    def __init__(self, content: str):
        self.content = content
        self.breaks = [m.start() for m in re.finditer("\n", content)]
        self.lines = [x.removesuffix("\r") for x in content.split("\n")]
        if self.lines[-1] == "":
            self.lines.pop()

    def line(self, offset: int) -> int:
        """1-based line of an offset: one more than the newlines before it."""
        return bisect_right(self.breaks, offset - 1) + 1

    def _close(self, start: int, tokens: re.Pattern[str], need_open: bool) -> int | None:
        """Line of the closing brace that brings the depth back to zero; quoted stretches are single tokens."""
        depth, opened = 0, not need_open
        for m in tokens.finditer(self.content, start):
            if m[0] == "{":
                depth, opened = depth + 1, True
            elif m[0] == "}":
                depth -= 1
                if depth == 0 and opened:
                    return self.line(m.start())
        return None

    def naive_end(self, start: int) -> int | None:
        return self._close(start, _BRACES, True)

    def quoted_end(self, start: int) -> int | None:
        return self._close(start, _QUOTED, False)

    def double_quoted_end(self, start: int) -> int | None:
        return self._close(start, _DOUBLE_QUOTED, False)

    def indent_end(self, line: int, indent: int) -> int:
        """Last line of the block below a header: blank and comment lines belong to it only if more of it follows."""
        last = line
        for number, text in enumerate(self.lines[line:], line + 1):
            bare = text.strip()
            if bare and not bare.startswith("#"):
                if len(text) - len(text.lstrip()) <= indent:
                    break
                last = number
        return last

    def keyword_end(self, line: int) -> int:
        """Line of the ``end`` that closes the block opened on a line; the line itself without one."""
        depth = 0
        for number, text in enumerate(self.lines[line - 1 :], line):
            bare = text.strip()
            depth += bool(_RUBY_OPEN.match(bare))
            if _RUBY_END.match(bare):
                depth -= 1
                if depth == 0:
                    return number
        return line

    def ruby_visibility(self, line: int) -> str:
        """Set by the last visibility keyword above in the same class or module."""
        for text in reversed(self.lines[: max(0, line - 1)]):
            bare = text.strip()
            for word, value in (("private", "Private"), ("protected", "Internal"), ("public", "Public")):
                if bare == word or bare.startswith(word + " "):
                    return value
            if bare.startswith(("class ", "module ")):
                break
        return "Public"


_BRACES = re.compile(r"[{}]")
_QUOTED = re.compile(r"[{}]|\"(?:(?!(?<!\\)\").)*(?:\"|\Z)|'(?:(?!(?<!\\)').)*(?:'|\Z)", re.S)
_DOUBLE_QUOTED = re.compile(r"[{}]|\"(?:(?!(?<!\\)\").)*(?:\"|\Z)", re.S)
_RUBY_OPEN = re.compile(r"class |module |def |do|if |unless |case |begin")
_RUBY_END = re.compile(r"end(?:$| |#)")

Visibility = Callable[[Match, str, Text, int], str]
Signature = Callable[[Match, str, Text, int], str | None]
End = Callable[[Match, Text, int], int | None]


def marked(group: int, yes: str = "Public", no: str = "Private") -> Visibility:
    return lambda m, name, text, line: yes if m[group] is not None else no


def keyword(group: int, none: str) -> Visibility:
    return lambda m, name, text, line: KEYWORDS.get((m[group] or "").strip(), none)


def always(value: str) -> Visibility:
    return lambda m, name, text, line: value


def containing(group: int, *choices: tuple[str, str], none: str) -> Visibility:
    return lambda m, name, text, line: next((v for w, v in choices if w in (m[group] or "")), none)


def swift_visibility(group: int) -> Visibility:
    words = {"public": "Public", "open": "Public", "private": "Private", "fileprivate": "Private"}
    return lambda m, name, text, line: words.get((m[group] or "").strip(), "Internal")


def capital(m: Match, name: str, text: Text, line: int) -> str:
    return "Public" if name[:1].isupper() else "Private"


def underscore(m: Match, name: str, text: Text, line: int) -> str:
    return "Private" if name.startswith("_") else "Public"


def python_def(m: Match, name: str, text: Text, line: int) -> str:
    return "Private" if name.startswith("_") and not name.startswith("__") else "Public"


def ruby_scope(m: Match, name: str, text: Text, line: int) -> str:
    return text.ruby_visibility(line)


def source_line(m: Match, name: str, text: Text, line: int) -> str | None:
    return text.lines[line - 1].strip() if line <= len(text.lines) else None


def whole(m: Match, name: str, text: Text, line: int) -> str | None:
    return m[0].strip()


def calling(m: Match, name: str, text: Text, line: int) -> str | None:
    return m[0].strip().rstrip("(") + "(...)"


def without(mark: str) -> Signature:
    return lambda m, name, text, line: m[0].strip().rstrip(mark).strip()


def named(form: str) -> Signature:
    return lambda m, name, text, line: form.format(name=name, one=(m[1] or "") if m.re.groups else "")


def naive(m: Match, text: Text, line: int) -> int | None:
    return text.naive_end(m.end())


def after(m: Match, text: Text, line: int) -> int | None:
    return text.quoted_end(m.end())


def at_brace(m: Match, text: Text, line: int) -> int | None:
    return text.quoted_end(m.end() - 1)


def at_brace_double(m: Match, text: Text, line: int) -> int | None:
    return text.double_quoted_end(m.end() - 1)


def indented(m: Match, text: Text, line: int) -> int | None:
    return text.indent_end(line, len(m[1]))


def ended(m: Match, text: Text, line: int) -> int | None:
    return text.keyword_end(line)


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern[str]
    kind: str | Callable[[Match, str], str]
    name: int = 1
    visibility: Visibility = always("Public")
    signature: Signature | None = None
    end: End | None = None
    skip: Callable[[Match, str], bool] | None = None
    form: str = "{}"
    items: bool = False
    missing: str = ""


def rule(pattern: str, kind: str | Callable[[Match, str], str], name: int = 1, **options) -> Rule:  # noqa: ANN003
    return Rule(re.compile(pattern, re.M), kind, name, **options)


def by_word(group: int, other: str, **words: str) -> Callable[[Match, str], str]:
    return lambda m, name: words.get(m[group], other)


def skips(group: int | None, words: set[str], names: frozenset[str] = CONTROL) -> Callable[[Match, str], bool]:
    return lambda m, name: name in names or group is not None and (m[group] or "").strip() in words


_JAVA_KIND = by_word(3, "Class", interface="Interface", enum="Enum")
_CS_KIND = by_word(3, "Class", interface="Interface", enum="Enum", struct="Struct", record="Struct")


def _php_signature(m: Match, name: str, text: Text, line: int) -> str | None:
    return f"abstract class {name}" if m[1] else m[0].strip()


_SCRIPT = (
    rule(r"^[ \t]*(export\s+)?(async\s+)?function\s+(\w+)", "Function", 3, visibility=marked(1), signature=source_line, end=naive),
    rule(r"^[ \t]*(export\s+)?(default\s+)?class\s+(\w+)", "Class", 3, visibility=marked(1), end=naive),
    rule(r"^[ \t]*(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(async\s*)?\([^)]*\)\s*=>", "Function", 3, visibility=marked(1), signature=source_line, end=naive),
    rule(r"^[ \t]*(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(async\s*)?\w+\s*=>", "Function", 3, visibility=marked(1)),
    rule(r"^[ \t]*(export\s+)?interface\s+(\w+)", "Interface", 2, visibility=marked(1), end=naive),
    rule(r"^[ \t]*(export\s+)?type\s+(\w+)\s*=", "Type", 2, visibility=marked(1)),
)
#: The patterns decide what a declaration is, so they are stated as they are; only white space before the optional
#: words of Java is possessive (``\s*+``), which changes no match, since none of these words begins with it, and spares the search for one.
RULES: dict[str, tuple[Rule, ...]] = {
    "Rust": (
        rule(r"^[ \t]*(pub(?:\([^)]+\))?\s+)?(?:async\s+)?fn\s+(\w+)", "Function", 2, visibility=marked(1), signature=source_line, end=naive),
        rule(r"^[ \t]*(pub(?:\([^)]+\))?\s+)?struct\s+(\w+)", "Struct", 2, visibility=marked(1), end=naive),
        rule(r"^[ \t]*(pub(?:\([^)]+\))?\s+)?enum\s+(\w+)", "Enum", 2, visibility=marked(1), end=naive),
        rule(r"^[ \t]*(pub(?:\([^)]+\))?\s+)?trait\s+(\w+)", "Trait", 2, visibility=marked(1), end=naive),
        rule(r"^[ \t]*(pub(?:\([^)]+\))?\s+)?const\s+(\w+)\s*:", "Const", 2, visibility=marked(1)),
        rule(r"^[ \t]*(pub(?:\([^)]+\))?\s+)?type\s+(\w+)", "Type", 2, visibility=marked(1)),
    ),
    "Python": (
        rule(r"^([ \t]*)(async\s+)?def\s+(\w+)\s*\(", "Function", 3, visibility=python_def, signature=source_line, end=indented),
        rule(r"^([ \t]*)class\s+(\w+)", "Class", 2, visibility=underscore, signature=source_line, end=indented),
    ),
    "JavaScript": _SCRIPT,
    "TypeScript": _SCRIPT,
    "Go": (
        rule(r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", "Function", visibility=capital, signature=source_line, end=naive),
        rule(r"^type\s+(\w+)\s+struct\b", "Struct", visibility=capital, end=naive),
        rule(r"^type\s+(\w+)\s+interface\b", "Interface", visibility=capital, end=naive),
        rule(r"^const\s+(\w+)\s*=", "Const", visibility=capital),
    ),
    "Java": (
        rule(r"^\s*+(public|private|protected)?\s*+(abstract|final)?\s*+(class|interface|enum)\s+(\w+)", _JAVA_KIND, 4, visibility=keyword(1, "Internal"), signature=whole, end=after),
        rule(
            r"^\s*+(public|private|protected)?\s*+(static)?\s*+(final)?\s*+(abstract)?\s*+(\w+(?:<[^>]+>)?)\s+(\w+)\s*\(", "Method", 6, visibility=keyword(1, "Internal"),
            signature=calling, end=after, skip=skips(5, {"class", "interface", "enum", "new"}),
        ),
        rule(r"^\s*@interface\s+(\w+)", "Interface"),
    ),
    "CSharp": (
        rule(r"^\s*namespace\s+([\w.]+)", "Module", signature=named("namespace {name}"), end=after),
        rule(r"^\s*(public|private|protected|internal)?\s*(abstract|sealed|static|partial)?\s*(class|interface|enum|struct|record)\s+(\w+)", _CS_KIND, 4, visibility=keyword(1, "Internal"), signature=whole, end=after),
        rule(
            r"^\s*(public|private|protected|internal)?\s*(static|virtual|override|abstract|async)?\s*([\w<>\[\],\s]+?)\s+(\w+)\s*\(", "Method", 4, visibility=keyword(1, "Private"), signature=calling,
            end=after, skip=skips(3, {"class", "interface", "enum", "struct", "new", "namespace"}, CONTROL | {"foreach"}),
        ),
        rule(r"^\s*(public|private|protected|internal)?\s*(static|virtual|override)?\s*([\w<>\[\]?]+)\s+(\w+)\s*\{\s*(get|set)", "Const", 4, visibility=keyword(1, "Private")),
    ),
    "Php": (
        rule(r"^\s*(abstract\s+)?(final\s+)?class\s+(\w+)", "Class", 3, signature=_php_signature, end=after),
        rule(r"^\s*interface\s+(\w+)", "Interface", signature=named("interface {name}"), end=after),
        rule(r"^\s*trait\s+(\w+)", "Trait", signature=named("trait {name}"), end=after),
        rule(
            r"^\s*(public|private|protected|static|\s)*\s*function\s+(\w+)\s*\(", "Function", 2,
            visibility=containing(1, ("private", "Private"), ("protected", "Protected"), none="Public"), signature=calling, end=after,
        ),
        rule(r"^\s*(public|private|protected)?\s*const\s+(\w+)\s*=", "Const", 2, visibility=keyword(1, "Public")),
    ),
    "C": (
        rule(
            r"^(static\s+)?(inline\s+)?(const\s+)?(\w+(?:\s*\*)*)\s+(\w+)\s*\([^)]*\)\s*\{", "Function", 5, visibility=marked(1, "Private", "Public"),
            signature=without("{"), end=at_brace, skip=skips(None, set(), CONTROL - {"catch"}),
        ),
        rule(r"^(extern\s+)?(static\s+)?(\w+(?:\s*\*)*)\s+(\w+)\s*\([^)]*\)\s*;", "Function", 4, visibility=marked(2, "Private", "Public"), signature=without(";")),
        rule(r"^(typedef\s+)?struct\s+(\w+)?\s*\{", "Struct", 2, signature=named("struct {name}"), end=at_brace, missing="anonymous"),
        rule(r"^(typedef\s+)?enum\s+(\w+)?\s*\{", "Enum", 2, signature=named("enum {name}"), end=at_brace, missing="anonymous"),
        rule(r"^typedef\s+.+?\s+(\w+)\s*;", "Type"),
    ),
    "Cpp": (
        rule(
            r"^(?:template\s*<[^>]*>\s*)?(class|struct)\s+(\w+)(?:\s*:\s*[^{]+)?\s*\{", by_word(1, "Class", struct="Struct"), 2,
            signature=named("{one} {name}"), end=at_brace,
        ),
        rule(r"^namespace\s+(\w+)\s*\{", "Module", signature=named("namespace {name}"), end=at_brace),
        rule(r"^enum(?:\s+class)?\s+(\w+)\s*\{", "Enum", signature=named("enum {name}"), end=at_brace),
        rule(
            r"^(virtual\s+|static\s+|inline\s+|constexpr\s+|explicit\s+)*(\w+(?:\s*[*&])?(?:\s*<[^>]+>)?)\s+(\w+(?:::\w+)?)\s*\([^)]*\)(?:\s*(?:const|override|noexcept|final))*\s*\{", lambda m, name: "Method" if "::" in name else "Function", 3,
            visibility=containing(1, ("static", "Private"), none="Public"), signature=without("{"), end=at_brace, skip=skips(None, set()),
        ),
        rule(
            r"^\s*(virtual\s+|static\s+|inline\s+|constexpr\s+|explicit\s+)*(\w+(?:\s*[*&])?(?:\s*<[^>]+>)?)\s+(\w+)\s*\([^)]*\)(?:\s*(?:const|override|noexcept|final))*\s*;", "Method", 3, visibility=containing(1, ("virtual", "Public"), none="Internal"),
            signature=without(";"), skip=skips(None, set(), CONTROL | {"return"}),
        ),
    ),
    "Ruby": (
        rule(r"^class\s+([A-Z]\w*)(?:\s*<\s*\w+)?", "Class", signature=named("class {name}"), end=ended),
        rule(r"^module\s+([A-Z]\w*)", "Module", signature=named("module {name}"), end=ended),
        rule(r"^\s*def\s+self\.(\w+[?!=]?)(?:\s*\(|$|\s)", "Function", visibility=ruby_scope, signature=named("def {name}"), end=ended, form="self.{}"),
        rule(r"^\s*def\s+(\w+[?!=]?)(?:\s*\(|$|\s)", "Method", visibility=ruby_scope, signature=named("def {name}"), end=ended),
        rule(r"^\s*attr_(reader|writer|accessor)\s+(.+)", "Const", 2, items=True),
    ),
    "Dart": (
        rule(
            r"^(abstract\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+(?:with|implements)\s+[^{]+)?\s*\{", "Class", 2, visibility=underscore,
            signature=lambda m, name, text, line: ("abstract class " if m[1] else "class ") + name, end=at_brace,
        ),
        rule(r"^mixin\s+(\w+)(?:\s+on\s+\w+)?\s*\{", "Trait", visibility=underscore, signature=named("mixin {name}"), end=at_brace),
        rule(r"^extension\s+(\w+)\s+on\s+\w+[^{]*\{", "Module", visibility=underscore, signature=named("extension {name}"), end=at_brace),
        rule(r"^enum\s+(\w+)\s*\{", "Enum", visibility=underscore, signature=named("enum {name}"), end=at_brace),
        rule(
            r"^(static\s+)?(\w+(?:<[^>]+>)?)\s+(\w+)\s*\([^)]*\)(?:\s*async)?\s*\{", lambda m, name: "Function" if m[1] else "Method", 3,
            visibility=underscore, signature=without("{"), end=at_brace, skip=skips(None, set(), CONTROL | {"try"}),
        ),
        rule(r"^\s*(?:\w+\s+)?get\s+(\w+)\s*\{", "Method", visibility=underscore, end=at_brace, form="get {}"),
        rule(r"^\s*set\s+(\w+)\s*\([^)]*\)\s*\{", "Method", visibility=underscore, end=at_brace, form="set {}"),
    ),
    "Swift": (
        rule(r"^(?:@\w+\s+)*(public\s+|internal\s+|fileprivate\s+|private\s+|open\s+)?(?:final\s+)?class\s+(\w+)(?:\s*:\s*[^{]+)?\s*\{", "Class", 2, visibility=swift_visibility(1), signature=named("class {name}"), end=at_brace_double),
        rule(r"^(?:@\w+\s+)*(public\s+|internal\s+|fileprivate\s+|private\s+)?struct\s+(\w+)(?:\s*:\s*[^{]+)?\s*\{", "Struct", 2, visibility=swift_visibility(1), signature=named("struct {name}"), end=at_brace_double),
        rule(r"^(?:@\w+\s+)*(public\s+|internal\s+|fileprivate\s+|private\s+)?enum\s+(\w+)(?:\s*:\s*[^{]+)?\s*\{", "Enum", 2, visibility=swift_visibility(1), signature=named("enum {name}"), end=at_brace_double),
        rule(r"^(?:@\w+\s+)*(public\s+|internal\s+|fileprivate\s+|private\s+)?protocol\s+(\w+)(?:\s*:\s*[^{]+)?\s*\{", "Trait", 2, visibility=swift_visibility(1), signature=named("protocol {name}"), end=at_brace_double),
        rule(r"^(?:@\w+\s+)*(public\s+|internal\s+|fileprivate\s+|private\s+)?extension\s+(\w+)(?:\s*:\s*[^{]+)?\s*\{", "Module", 2, visibility=swift_visibility(1), end=at_brace_double, form="extension {}"),
        rule(r"^(?:@\w+\s+)*(public\s+|internal\s+|fileprivate\s+|private\s+)?actor\s+(\w+)(?:\s*:\s*[^{]+)?\s*\{", "Class", 2, visibility=swift_visibility(1), signature=named("actor {name}"), end=at_brace_double),
        rule(
            r"^(?:\s*)(?:@\w+\s+)*(public\s+|internal\s+|fileprivate\s+|private\s+|open\s+)?(?:static\s+|class\s+)?(?:override\s+)?func\s+(\w+)\s*\([^)]*\)(?:\s*(?:async\s+)?(?:throws\s+)?(?:->\s*[^{]+)?)?\s*\{", "Function", 2, visibility=swift_visibility(1), signature=without("{"), end=at_brace_double,
        ),
        rule(
            r"^(?:\s*)(?:@\w+\s+)*(public\s+|internal\s+|fileprivate\s+|private\s+)?(?:convenience\s+|required\s+)?init\??\s*\([^)]*\)(?:\s*throws)?\s*\{", "Method", 0,
            visibility=swift_visibility(1), signature=without("{"), end=at_brace_double, form="init",
        ),
    ),
}
#: Languages in which a symbol directly after one of the same name and line is dropped.
ADJACENT = frozenset({"C", "Cpp", "Ruby", "Dart", "Swift"})

#: Fixed values: (pattern, what becomes of the match) of import statements, in order.
IMPORTS: dict[str, tuple[tuple[re.Pattern[str], Callable[[str], str]], ...]] = {
    "Rust": (
        (re.compile(r"^[ \t]*(?:pub\s+)?use\s+(?:crate::)?(\w+)", re.M), str),
        (re.compile(r"^[ \t]*(?:pub\s+)?mod\s+(\w+)\s*;", re.M), str),
    ),
    "Python": (
        (re.compile(r"^[ \t]*import\s+([\w.]+)", re.M), lambda t: t.split(".")[0]),
        (re.compile(r"^[ \t]*from\s+([\w.]+)\s+import", re.M), lambda t: t.split(".")[0]),
    ),
    "JavaScript": (
        (re.compile(r"""^[ \t]*import\s+(?:(?:\{[^}]*\}|[\w*]+)\s+from\s+)?['"]([^'"]+)['"]""", re.M), str),
        (re.compile(r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""), str),
    ),
    "Go": ((re.compile(r'^import\s+"([^"]+)"', re.M), lambda t: t.rsplit("/", 1)[-1]),),
}
IMPORTS["TypeScript"] = IMPORTS["JavaScript"]
_GO_BLOCK, _GO_LINE = re.compile(r"import\s*\(([^)]+)\)", re.S), re.compile(r'^\s*"([^"]+)"\s*$', re.M)


def symbols_of(content: str, language: str) -> list[tuple]:
    """(kind, name, signature, start, end, visibility) of every declaration, by line; ties in the order of rules and matches."""
    rules = RULES.get(language)
    if not rules or not content:
        return []
    text = Text(content)
    out: list[tuple] = []
    for r in rules:
        for m in r.pattern.finditer(content):
            raw = (m[r.name] if r.name else "init") or r.missing
            if r.skip is not None and r.skip(m, raw):
                continue
            line = text.line(m.start())
            if r.items:
                names = [x.strip().lstrip(":").strip() for x in raw.split(",")]
                out += [(r.kind, n, None, line, line, "Public") for n in names if n]
                continue
            name = r.form.format(raw)
            kind = r.kind if isinstance(r.kind, str) else r.kind(m, raw)
            end = r.end(m, text, line) if r.end is not None else None
            signature = r.signature(m, name, text, line) if r.signature is not None else None
            out.append((kind, name, signature, line, end if end is not None else line, r.visibility(m, raw, text, line)))
    out.sort(key=lambda s: s[3])
    if language in ADJACENT:
        out = [s for i, s in enumerate(out) if i == 0 or (s[1], s[3]) != (out[i - 1][1], out[i - 1][3])]
    return out


def imports_of(content: str, language: str) -> list[str]:
    """Distinct imports of a file in the order of their first appearance, single forms before blocks."""
    found = [use(m[1]) for pattern, use in IMPORTS.get(language, ()) for m in pattern.finditer(content or "")]
    if language == "Go":
        found += [x.rsplit("/", 1)[-1] for block in _GO_BLOCK.findall(content or "") for x in _GO_LINE.findall(block)]
    return [x for x in dict.fromkeys(found) if x]


_SYMBOL = "struct<kind:string,name:string,signature:string,line_range:struct<start:int,end:int>,visibility:string,doc_comment:string,ord:int>"


def _per_file(files: DataFrame, carried: tuple[str, ...], find: Callable[[str, str], list], pack: Callable[[list], pa.Array], column: str, item: str) -> DataFrame:
    """(file_path, *carried, column array): what ``find`` finds in each file's content and language, by map tasks alone, in Arrow's own layout."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t or "", lang or "") for t, lang in zip(b.column("_text").to_pylist(), b.column("_language").to_pylist(), strict=True)]
            ends = [0, *accumulate(map(len, found))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pack([x for f in found for x in f]))
            kept = [n for n in b.schema.names if not n.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), lists], [*kept, column])

    picked = files.where("relative_path IS NOT NULL").select(F.col("relative_path").alias("file_path"), *carried, F.col("content").alias("_text"), F.col("language").alias("_language"))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if not f.name.startswith("_")]
    return picked.mapInArrow(rows, ", ".join([*columns, f"{column} array<{item}>"]))


def _numbered(text: str, language: str) -> list[tuple]:
    return [(*s, k) for k, s in enumerate(symbols_of(text, language))]


def _packed_symbols(found: list[tuple]) -> pa.Array:
    kind, name, signature, start, end, visibility, order = zip(*found, strict=True) if found else [()] * 7
    text, number = pa.string(), pa.int32()
    span = pa.StructArray.from_arrays([pa.array(start, number), pa.array(end, number)], ["start", "end"])
    parts = [pa.array(kind, text), pa.array(name, text), pa.array(signature, text), span, pa.array(visibility, text), pa.nulls(len(found), text), pa.array(order, number)]
    return pa.StructArray.from_arrays(parts, ["kind", "name", "signature", "line_range", "visibility", "doc_comment", "ord"])


def symbol_rows(files: DataFrame, *carried: str) -> DataFrame:
    """(file_path, *carried, symbols): one row a file of (relative_path, language, content); null contents have no symbols."""
    return _per_file(files, carried, _numbered, _packed_symbols, "symbols", _SYMBOL)


def extract_symbols(files: DataFrame) -> DataFrame:
    """The symbols of (relative_path, language, content), with ``ord`` in the file; null contents have none."""
    return symbol_rows(files).select("file_path", F.inline("symbols"))


def import_rows(files: DataFrame, *carried: str) -> DataFrame:
    """(file_path, *carried, imports): one row a file."""
    return _per_file(files, carried, imports_of, lambda found: pa.array(found, pa.string()), "imports", "string")


def extract_imports(files: DataFrame) -> DataFrame:
    """(file_path, target, ord): the imports of (relative_path, language, content)."""
    return import_rows(files.where(F.col("language").isin(*IMPORTS))).select("file_path", F.posexplode("imports").alias("ord", "target")).select("file_path", "target", "ord")
