"""Lexers that tell code from comments and strings, for the languages of the files table.

One regular expression per language family walks a text from token to token, so
a quote inside a comment or a comment mark inside a string never changes state.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

_DOUBLE = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'
_SINGLE = r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_LINE = r"//[^\n]*"
_HASH = r"#[^\n]*"
_TRIPLE = r'[rRbBuUfF]{0,2}(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|' r"'''(?:\\.|[^\\])*?(?:'''|\Z))"
_TEMPLATE = r"`(?:\\.|[^`\\])*(?:`|\Z)"
_CHAR = r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"


def _scanner(comment: str, string: str) -> re.Pattern[str]:
    return re.compile(f"(?P<comment>{comment})|(?P<string>{string})|(?P<open>\\{{)|(?P<close>\\}})", re.S)


FAMILIES = {
    "c": _scanner(f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}"),
    "script": _scanner(f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}|{_TEMPLATE}"),
    "go": _scanner(f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|`[^`]*(?:`|\\Z)|{_CHAR}"),
    "rust": _scanner(f"{_LINE}|{_BLOCK}", f'r#+".*?"#+|{_DOUBLE}|{_CHAR}'),
    "php": _scanner(f"{_LINE}|{_BLOCK}|#(?!\\[)[^\\n]*", f"{_DOUBLE}|{_SINGLE}"),
    "python": _scanner(_HASH, f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}"),
    "ruby": _scanner(r"(?<![^\n])=begin.*?(?:\n=end[^\n]*|\Z)|#(?!\{)[^\n]*", f"{_DOUBLE}|{_SINGLE}"),
}

#: Lexer family by language name and by file extension.
BY_LANGUAGE = {
    "rust": "rust", "python": "python", "javascript": "script", "typescript": "script", "go": "go",
    "java": "c", "csharp": "c", "php": "php", "c": "c", "cpp": "c", "ruby": "ruby", "dart": "script", "swift": "c",
}
BY_EXTENSION = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script",
    "ts": "script", "tsx": "script", "go": "go", "java": "c", "cs": "c", "php": "php", "c": "c", "h": "c", "cc": "c",
    "cpp": "c", "cxx": "c", "hpp": "c", "rb": "ruby", "dart": "script", "swift": "c",
}


def family(language: str | None, path: str | None) -> str:
    """The lexer of a file: by its extension, else by its language, else the C family."""
    extension = (path or "").rpartition("/")[2].rpartition(".")[2].lower()
    return BY_EXTENSION.get(extension) or BY_LANGUAGE.get((language or "").lower(), "c")


def tokens(text: str, lexer: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every comment, string and brace of ``text``."""
    for m in FAMILIES[lexer].finditer(text):
        yield m.lastgroup or "", m.start(), m.end()


#: Comments that speak to tools.
DIRECTIVE = re.compile(r"(?://+|#+|/\*+)\s*(?:nolint|noqa|pylint:|type:\s*ignore|eslint-|tslint:|@ts-|prettier-ignore|rubocop:|clang-format|phpcs:|go:|swiftlint:|istanbul|coverage:|fmt:|mypy:|NOSONAR)", re.I)
_MARK = re.compile(r"//+!?|#+!?|/\*+|=begin|--+|")


class Source:
    """A lexed file: its lines, comments and the braces that are neither comment nor string."""

    def __init__(self, text: str, lexer: str):
        self.text, self.lexer = text, lexer
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.comments: list[tuple[int, int]] = []
        self.strings: list[tuple[int, int]] = []
        self.braces: list[tuple[int, int]] = []
        for kind, a, b in tokens(text, lexer):
            if kind == "comment":
                self.comments.append((a, b))
            elif kind == "string":
                self.strings.append((a, b))
            else:
                self.braces.append((a, 1 if kind == "open" else -1))

    @cached_property
    def ends(self) -> dict[int, tuple[int, int]]:
        """The comments with nothing but space before them, by the line on which they end."""
        return {self.line_of(max(a, b - 1)): (a, b) for a, b in self.comments if self._alone(a)}

    def line_of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def line(self, number: int) -> str:
        """Text of a 1-based line, without its end."""
        if not 0 < number <= len(self.starts):
            return ""
        end = self.starts[number] - 1 if number < len(self.starts) else len(self.text)
        return self.text[self.starts[number - 1] : end].rstrip("\r")

    def block_end(self, line: int) -> int | None:
        """Line of the brace that closes the first block opened on ``line`` or after it."""
        at = self.starts[line - 1]
        depth = 0
        for offset, step in self.braces[bisect_right(self.braces, (at - 1, 2)) :]:
            if depth == 0 and step < 0:
                return None
            depth += step
            if depth == 0:
                return self.line_of(offset)
        return None

    def indent_end(self, line: int) -> int:
        """Last line of the indented block that belongs to ``line``; lines inside strings are part of it."""
        base = len(self.line(line)) - len(self.line(line).lstrip())
        inside = {n for a, b in self.strings for n in range(self.line_of(a) + 1, self.line_of(b - 1) + 1)}
        last, header_open = line, True
        for number in range(line + 1, len(self.starts) + 1):
            text = self.line(number)
            if number in inside:
                last = number
                continue
            if not text.strip() or text.lstrip().startswith("#"):
                continue
            depth = len(text) - len(text.lstrip())
            if depth <= base and not (header_open and text.lstrip()[:1] in ")]"):
                break
            header_open = header_open and depth <= base
            last = number
        return last

    def comment_before(self, line: int) -> str | None:
        """The comment that ends on the line before ``line``; attributes, decorators and directives to tools may stand between.

        Line comments belong together while they have the same mark and stand in the same column; lines that
        name the file's tool, package or licence at its head are no part of it.
        """
        ends = self.ends
        number = line - 1
        while number > 0 and (re.match(r"\s*(@|#\[|\[\w|#!\[)", self.line(number)) if number not in ends else DIRECTIVE.match(self.text[slice(*ends[number])])):
            number -= 1
        parts: list[str] = []
        look = None
        while number in ends:
            a, b = ends[number]
            part, mark = self.text[a:b], (_MARK.match(self.text, a)[0], a - self.starts[self.line_of(a) - 1])  # type: ignore[index]
            if (look is not None and mark != look) or DIRECTIVE.match(part):
                break
            parts.append(part)
            look = mark
            number = self.line_of(a) - 1
            if part.startswith("/*"):
                break
        return "\n".join(reversed(parts)) if parts else None

    def _alone(self, offset: int) -> bool:
        start = self.starts[self.line_of(offset) - 1]
        return not self.text[start:offset].strip()

    def docstring_after(self, line: int) -> str | None:
        """The string that is the first statement of the block whose header starts on ``line``."""
        at = self.starts[line - 1]
        header = re.compile(r"\s*(?:async\s+def|def|class)\b").match(self.text, at)
        if not header:
            return None
        depth, strings = 0, self.strings[bisect_right(self.strings, (at, 0)) :]
        first = iter(strings)
        inside = next(first, None)
        k = header.end()
        while k < len(self.text):  # the colon that ends the header: outside of brackets, strings and comments
            if inside is not None and k >= inside[0]:
                k, inside = max(k, inside[1]), next(first, None)
                continue
            c = self.text[k]
            if c == "#":
                end = self.text.find("\n", k)
                k = end if end >= 0 else len(self.text)
                continue
            depth += (c in "([{") - (c in ")]}")
            k += 1
            if c == ":" and depth == 0:
                break
        body = re.compile(r"(?:\s|#[^\n]*)*").match(self.text, k).end()  # type: ignore[union-attr]
        return next((self.text[a:b] for a, b in strings if a == body), None)
