"""Problem 3: functions and methods paired with their documentation.

Files are lexed by a string- and comment-aware state machine; braces (or, in
Python and Ruby, indentation and keywords) delimit the function that a symbol's
first line opens; the comment directly before it, or the docstring at its head,
is attached, without the lines that a file's head gives to its tool, package or
licence. Symbols give name, signature and place. The attached comment decides;
the one that a symbol carries is compared with it, and decides only where none
can be attached: the file is missing, or another version than the symbol's.
Functions without a description are dropped.

Only the newest version of a file counts; repeated symbols are one. Symbols
with a null path, name or line are dropped; a null or empty comment is no
documentation; a symbol of a missing file keeps a null code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.codelex import Source, family
from codestrata.llm.located import beside_files
from codestrata.llm.origin import TOOL_HEADER, head_words

#: Words besides the name's that a description needs.
NEW_WORDS = 3
#: Lines at the beginning of a file that may belong to its head.
HEAD_LINES = 12

_OPENERS = re.compile(r"^\s*(?:[rRbBuU]{0,2}(?:\"\"\"|''')|/\*+!?|//+!?|#+!?|--+|=begin\b|\*(?!/))[ \t]?|\s*(?:\*+/|\"\"\"|'''|=end\b)\s*$")
_TAG = re.compile(r"^\s*(?:@\w+|\\(?:param|return|brief)\b|:(?:param|type|returns?|rtype|raises)\b|(?:Args|Arguments|Parameters|Returns?|Raises|Throws|Yields|Params?)\s*:?\s*$)")
_RULE = re.compile(r"^[\W_]*$")
#: Texts that stand where a description should be.
_POSTPONED = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|wip|hack)\b|^\W*auto-?\s?generated\b.*\bstub\b|(?:missing|write|add|needs?|no) (?:documentation|docs?|description)\b|to be (?:filled|written|documented|completed|done)"
    r"|description (?:to be|goes here|pending)|not (?:yet )?documented|documentation (?:pending|to follow)|lorem ipsum|^\W*(?:placeholder|undocumented|n/?a|none|dummy)\W*$|^\W*(?:non-)?javadoc\W*$",
    re.I,
)
_ELSEWHERE = re.compile(
    r"^\W*(?:\{@inheritDoc\}|inherit(?:s|ed)?(?:doc| documentation)|see (?:above|below|also\b|the\b|\{?@|\w+(?:[.#/]\w+)*\W*$)|(?:refer|cf\.?|compare) (?:to )?|same as\b|as above|ditto|copied from\b|@(?:see|link|copydoc|override)\b|\{@(?:link|see))",
    re.I,
)
#: Words that add nothing to a name.
_EMPTY_WORDS = frozenset(
    "a an the this that these it its is are was be of for to in on at by with from and or function functions method methods func fn def class procedure routine helper"
    " description describes describe documentation docs doc comment name named implementation implements returns return does do given new object value values void self static public private".split()
)
_NOTICE = re.compile(r"(?:copyright\b|\(c\)|licen[cs]ed under\b|spdx-)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def clean_comment(raw: str) -> str:
    """The text of a comment without its marks; lines stay apart."""
    lines = []
    for line in raw.replace("\r\n", "\n").split("\n"):
        for _ in range(3):
            stripped = _OPENERS.sub("", line)
            if stripped == line:
                break
            line = stripped
        lines.append(line.strip())
    return "\n".join(lines).strip()


def without_head(raw: str) -> str:
    """A comment without the lines that name the file's tool, package or licence."""
    def head(line: str) -> bool:
        bare = clean_comment(line)
        return bool(TOOL_HEADER.match(bare) and not re.search(r"\bstub\b", bare, re.I) or head_words(bare) or _NOTICE.match(bare))

    return "\n".join(x for x in raw.split("\n") if not head(x))


def description(raw: str | None) -> str:
    """The prose of a comment: its lines before and between tags, without rules and tags."""
    if not raw:
        return ""
    kept, in_tag = [], False
    for line in clean_comment(raw).split("\n"):
        if _TAG.match(line):
            in_tag = True
        elif not line:
            in_tag = False
        elif not _RULE.match(line) and not in_tag:
            kept.append(line)
    return " ".join(kept).strip()


def stem(word: str) -> str:
    """A crude stem, so that ``builds`` and ``build``, ``entries`` and ``entry`` are the same word."""
    for end, put in (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if word.endswith(end) and len(word) > len(end) + 2:
            return (word[: -len(end)] + put).rstrip("e")
    return word.rstrip("e")


def name_words(text: str) -> set[str]:
    return {stem(w.lower()) for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", text)}


def says_something(text: str, name: str | None, signature: str | None = None, new_words: int = NEW_WORDS) -> bool:
    """Whether a description tells what ``name`` does, in whatever language."""
    if not text or _POSTPONED.search(text) or _ELSEWHERE.search(text):
        return False
    flat = re.sub(r"\W+", "", text).lower()
    if signature and flat and flat in re.sub(r"\W+", "", signature).lower():
        return False
    if name and re.match(r"(?:export |public |private |static |async |pub |default |final )*(?:fn|func|function|def|int|void|bool|char|long)\b", text) and re.search(rf"\b{re.escape(name)}\s*\(", text):
        return False
    if len(_CJK.findall(text)) >= 6:
        return True
    known = name_words(name or "") | name_words(signature or "")
    fresh = {stem(w.lower()) for w in _WORD.findall(text)} - known - {stem(w) for w in _EMPTY_WORDS}
    return len({w for w in fresh if len(w) > 1 or not w.isascii()}) >= new_words


def function_text(source: Source, start: int, end: int | None) -> tuple[str, int]:
    """The lines of the function that opens on line ``start`` and its last line."""
    stop = source.indent_end(start) if source.lexer in ("python", "ruby") else source.block_end(start)
    if source.lexer == "ruby" and stop is not None and source.line(stop + 1).strip() == "end":
        stop += 1
    if stop is None or stop < start:
        stop = end if end and end >= start else start
    stop = min(stop, len(source.starts))
    begin = source.starts[start - 1]
    close = source.starts[stop] - 1 if stop < len(source.starts) else len(source.text)
    return source.text[begin:close].rstrip("\r\n"), stop


def attached(source: Source, start: int) -> str | None:
    """The documentation of the function that opens on a line: its docstring, else the comment before it."""
    found = source.docstring_after(start) if source.lexer == "python" else None
    before = None if found else source.comment_before(start)
    if before and start - before.count("\n") - 1 <= HEAD_LINES:
        before = without_head(before)
    return found or before or None


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("file_path", "start_line", "end_line", "kind", "name", "signature", "documentation", "code", "origin", "agrees")
    for b in batches:
        out: list[tuple] = []
        for path, content, language, symbols in zip(b["file_path"], b["content"], b["language"], b["items"], strict=True):
            source = Source(content, family(language, path)) if isinstance(content, str) else None
            for s in symbols:
                start, code, end, lexed = s["start"], None, s["end"], None
                if source is not None and 0 < start <= len(source.starts):
                    code, end = function_text(source, start, s["end"])
                    lexed = attached(source, start)
                told = description(s["doc_comment"])
                text = description(lexed) if lexed else told
                if says_something(text, s["name"], s["signature"]):
                    out.append((path, start, end, s["kind"], s["name"], s["signature"], text, code, "symbol" if s["doc_comment"] else "file", text == told if s["doc_comment"] else None))
        yield pd.DataFrame(out, columns=list(names)).astype({"agrees": "boolean"})


def documented_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row per documented function: file_path, start_line, end_line, kind, name, signature, documentation, code, origin, agrees.

    ``origin`` is ``symbol`` where the symbol carries a comment too, ``file`` where only the lexed file has it;
    ``agrees`` tells whether both say the same, null without the symbol's.
    """
    item = F.struct(F.col("line_range.start").alias("start"), F.col("line_range.end").alias("end"), "kind", "name", "signature", "doc_comment")
    known = "kind IN ('Function', 'Method') AND file_path IS NOT NULL AND name IS NOT NULL AND line_range.start IS NOT NULL"
    rows = beside_files(symbols.where(known).select("file_path", item.alias("item")), files)
    schema = "file_path string, start_line int, end_line int, kind string, name string, signature string, documentation string, code string, origin string, agrees boolean"
    return rows.mapInPandas(_pairs, schema)
