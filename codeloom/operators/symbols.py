"""Symbols of source files: one row for each definition, with its block's end and its parent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import pandas as pd
from pyspark.sql import DataFrame

from codeloom.functions.text import LANGUAGES

#: Rows of symbols that a task gathers before it passes them on, a file's in one piece.
ROWS = 10_000
SCHEMA = "file string, ordinal int, name string, kind string, line int, end_line int, signature string, parent_name string"

#: Definition patterns by language, in order; the first that matches gives the name and kind.
SCRIPT = (
    (r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(<[^>]*>)?\s*\(([^)]*)\)(?:\s*:\s*([^\n{]+))?", "function"),
    (r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?", "class"),
    (r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "enum"),
    (r"(?:export\s+)?interface\s+(\w+)(?:\s+extends\s+[\w,\s<>]+)?", "interface"),
    (r"(?:export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*=", "type"),
    (r"(?:export\s+)?const\s+(\w+)\s*(?::\s*[^=]+)?\s*=", "const"),
)
PYTHON = (
    (r"(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*(\S+))?", "function"),
    (r"class\s+(\w+)(?:\(([^)]*)\))?", "class"),
)
RUST = (
    (r"(?:pub(?:\(crate\))?\s+)?(?:async\s+)?fn\s+(\w+)(?:<[^>]*>)?\s*\(([^)]*)\)(?:\s*->\s*([^\n{]+))?", "function"),
    (r"(?:pub(?:\(crate\))?\s+)?struct\s+(\w+)(?:<[^>]*>)?", "struct"),
    (r"(?:pub(?:\(crate\))?\s+)?enum\s+(\w+)(?:<[^>]*>)?", "enum"),
    (r"(?:pub(?:\(crate\))?\s+)?trait\s+(\w+)(?:<[^>]*>)?", "trait"),
    (r"impl(?:<[^>]*>)?\s+(\w+)", "class"),
)
GO = (
    (r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(([^)]*)\)(?:\s*(?:\(([^)]*)\)|(\w+)))?", "function"),
    (r"type\s+(\w+)\s+struct", "struct"),
    (r"type\s+(\w+)\s+interface", "interface"),
)
JAVA = (
    (r"(?:public|private|protected)?\s*(?:static\s+)?(?:abstract\s+)?(?:final\s+)?(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*\(", "method"),
    (r"(?:public|private|protected)?\s*(?:abstract\s+)?(?:final\s+)?class\s+(\w+)", "class"),
    (r"(?:public|private|protected)?\s*(?:abstract\s+)?interface\s+(\w+)", "interface"),
    (r"(?:public|private|protected)?\s*enum\s+(\w+)", "enum"),
)
GENERIC = (
    (r"(?:pub\s+)?(?:export\s+)?(?:async\s+)?(?:fn|func|function|def)\s+(\w+)", "function"),
    (r"(?:pub\s+)?(?:export\s+)?(?:class|struct)\s+(\w+)", "class"),
    (r"(?:pub\s+)?(?:export\s+)?(?:enum|interface|type|trait)\s+(\w+)", "enum"),
)
SCRIPT_METHOD = r"(?:public|private|protected|static|async|readonly|\s)*\s*(?:get|set\s+)?(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)(?:\s*:\s*([^\n{]+))?"
NO_METHODS = frozenset("if for while switch return throw new delete".split())


@cache
def ascii_words(pattern: str) -> re.Pattern:
    """The pattern with word characters of ASCII alone, but white space of any kind."""
    out, inside = "", False
    for part in re.findall(r"\\.|.", pattern, re.DOTALL):
        inside = part == "[" or (inside and part != "]")
        out += part if part != r"\w" else "A-Za-z0-9_" if inside else "[A-Za-z0-9_]"
    return re.compile(out)


@dataclass(frozen=True)
class Grammar:
    """How a language's definitions are found: where they may start and how their blocks end."""

    patterns: tuple[tuple[str, str], ...]
    any_indent: bool = True
    prefix_at_any_indent: str | None = None
    method: str | None = None
    method_indent: int = 2
    method_start: str = ""
    blocks: str = "braces"
    one_line: frozenset[str] = frozenset()
    methods_by_kind: bool = False

    def definition(self, text: str) -> tuple[str, str] | None:
        for pattern, kind in self.patterns:
            found = ascii_words(pattern).match(text)
            if found and found[1]:
                return found[1], kind
        return None


GRAMMARS = {
    "typescript": Grammar(SCRIPT, False, "export ", SCRIPT_METHOD, 2, one_line=frozenset(("type", "const"))),
    "python": Grammar(PYTHON, False, None, PYTHON[0][0], 4, "def ", "indent"),
    "rust": Grammar(RUST),
    "go": Grammar(GO),
    "java": Grammar(JAVA, False, methods_by_kind=True),
}
GRAMMARS |= {"javascript": GRAMMARS["typescript"], "csharp": GRAMMARS["java"], "kotlin": GRAMMARS["java"]}


BRACES = re.compile("[{}]")


class Blocks:
    """Block ends of a file's lines."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.indents = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]

    @cached_property
    def _closed(self) -> list[int | None]:
        """For each line, the line whose brace closes the first one opened from it on: one pass for all."""
        first, closed, opened = [None] * len(self.lines), {}, []
        for i, line in enumerate(self.lines):
            for sign in BRACES.findall(line):
                if sign == "{":
                    key = len(closed) + len(opened)
                    if first[i] is None:
                        first[i] = key
                    opened.append(key)
                elif opened:
                    closed[opened.pop()] = i + 1
        for i in reversed(range(len(first) - 1)):
            if first[i] is None:
                first[i] = first[i + 1]
        return [closed.get(key) for key in first]

    def braces(self, at: int) -> int:
        """The line whose brace closes the first one opened from here on; this line if none does."""
        return self._closed[at] or at + 1

    def indent(self, at: int) -> int:
        """The line before the next one that is indented no more, blank lines in between included."""
        own = self.indents[at] or 0
        return next((i for i in range(at + 1, len(self.lines)) if self.indents[i] is not None and self.indents[i] <= own), len(self.lines))


def symbols_of(path: str, content: str) -> list[tuple]:
    """(ordinal, name, kind, line, end_line, signature, parent_name) of a file in order."""
    extension = "." + path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    grammar = GRAMMARS.get(LANGUAGES.get(extension, ""), Grammar(GENERIC))
    lines = content.split("\n")
    blocks, out, owner = Blocks(lines), [], None
    end_of = blocks.indent if grammar.blocks == "indent" else blocks.braces
    tail = r"\s*:\s*$" if grammar.blocks == "indent" else r"\s*\{?\s*$"

    def add(name: str, kind: str, i: int, parent: str | None) -> None:
        end = i + 1 if kind in grammar.one_line else end_of(i)
        signature = re.sub(r"\s*\{?\s*$" if parent is None else tail, "", lines[i].strip())
        out.append((len(out), name, kind, i + 1, end, signature, parent))

    for i, line in enumerate(lines):
        text = line.lstrip()
        depth = len(line) - len(text)
        may_start = grammar.any_indent or depth == 0 or (grammar.prefix_at_any_indent and text.startswith(grammar.prefix_at_any_indent))
        found = grammar.definition(text) if may_start else None
        if found and not (grammar.methods_by_kind and found[1] == "method"):
            add(*found, i, None)
            owner = found[0] if found[1] == "class" or grammar.methods_by_kind else None
        elif grammar.methods_by_kind:
            inside = grammar.definition(text) if owner and depth >= grammar.method_indent else None
            if inside and inside[1] == "method":
                add(*inside, i, owner)
        elif owner and grammar.method and depth >= grammar.method_indent and text.startswith(grammar.method_start):
            method = ascii_words(grammar.method).match(text)
            if method and method[1] and method[1] not in NO_METHODS:
                add(method[1], "method", i, owner)
    return out


def extract_symbols(files: DataFrame, path: str = "relative_path", content: str = "content") -> DataFrame:
    """Symbols of (path, content) rows, a file in one piece, files in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for p, c in zip(batch[path], batch[content], strict=True):
                rows += [(p, *s) for s in symbols_of(p, c or "")]
                if len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return files.select(path, content).mapInPandas(run, SCHEMA)
