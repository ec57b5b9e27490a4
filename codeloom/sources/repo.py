"""A source tree as DataFrames: files that ignore rules leave, their content, hubs."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Names that are never walked into.
ALWAYS_IGNORED = frozenset(
    "node_modules .git .svn .hg __pycache__ .DS_Store dist build .next .nuxt target .mcp_data .mcp-shadow-history coverage .cache .turbo .parcel-cache".split()
)
ENTRIES = "path string, relative_path string, is_directory boolean, depth int"
FILES = "relative_path string, content string, modified double"


class IgnoreRules:
    """Patterns of an ignore file: ! takes back, a trailing / is for folders, a / inside anchors."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            rule = re.sub(r"(?<!\\)\s+$", "", line)
            if not rule or rule.startswith("#"):
                continue
            takes_back = rule.startswith("!")
            rule = rule[1:] if takes_back else rule
            folders, rule = rule.endswith("/"), rule.rstrip("/")
            anchored, rule = "/" in rule, rule.lstrip("/")
            if rule:
                self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self.pattern(rule) + r"\Z"), takes_back, folders))

    @staticmethod
    def pattern(rule: str) -> str:
        """A rule as a regular expression: *, ?, **, classes such as [a-z] and [!a-z], and \\ before a sign
        that stands for itself."""
        forms = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        out = ""
        for part in re.findall(r"\\.|\[[!^]?\]?[^\]]*\]|\*\*/|/\*\*|\*\*|\*|\?|.", rule, re.DOTALL):
            if len(part) > 2 and part[0] == "[":
                inner = part[1:-1]
                taken = inner[:1] in ("!", "^")
                inner = inner[1:] if taken else inner
                inner = re.sub(r"([\\\[\]^&|~])", r"\\\1", inner)
                out += f"(?!/)[{'^' if taken else ''}{inner}]"
            elif len(part) == 2 and part[0] == "\\":
                out += re.escape(part[1])
            else:
                out += forms.get(part) or re.escape(part)
        return out

    def ignores(self, path: str) -> bool:
        """Whether a path is left out, itself or by a folder above it.  The path's own name is tested as
        a file, so a rule for folders leaves their entry and drops what is in them."""
        names = path.split("/")
        for i in range(1, len(names) + 1):
            part, out = "/".join(names[:i]), False
            for pattern, takes_back, folders in self.rules:
                if pattern.match(part) and (i < len(names) or not folders):
                    out = not takes_back
            if out:
                return True
        return False


def walk(root: str, target: str = "", depth_limit: int = 0) -> Iterator[tuple[str, str, bool, int]]:
    """Entries below a folder, sorted, with paths relative to the root and depths to the target."""
    rules = IgnoreRules("")
    ignore_file = os.path.join(root, ".gitignore")
    if os.path.isfile(ignore_file):
        with open(ignore_file, encoding="utf-8", errors="replace") as f:
            rules = IgnoreRules(f.read())
    pending = [(os.path.join(root, target) if target else root, 0)]
    while pending:
        folder, depth = pending.pop()
        try:
            names = sorted(os.listdir(folder), reverse=True)
        except OSError:
            continue
        below = []
        for name in reversed(names):
            path = os.path.join(folder, name)
            relative = os.path.relpath(path, root).replace(os.sep, "/")
            if name in ALWAYS_IGNORED or name.startswith(".") or rules.ignores(relative):
                continue
            is_folder = os.path.isdir(path)
            yield path, relative, is_folder, depth
            if is_folder and (not depth_limit or depth < depth_limit):
                below.append((path, depth + 1))
        pending += reversed(below)


class Span(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def read_files(files: list[tuple[str, str]]) -> Iterator[tuple[str, str, float]]:
    for path, relative in files:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                yield relative, f.read(), os.path.getmtime(path)
        except OSError:
            continue


class RepoReader(DataSourceReader):
    """Lists on the driver, reads in tasks of about 64 files."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        o = self.options
        found = [(p, r) for p, r, folder, _ in walk(o["path"], o.get("target", ""), int(o.get("depth", 0))) if not folder]
        return [Span(found[at : at + 64]) for at in range(0, len(found), 64)] or [Span([])]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from read_files(partition.files)


class RepoStream(SimpleDataSourceStreamReader):
    """Changed files since the last offset, which holds every file's time of change: files edited in
    place come again, as the built-in file source would not give them."""

    def __init__(self, options: dict):
        self.options = options
        self.most = max(5, min(10, int(options.get("files_per_tick", 8))))

    def initialOffset(self) -> dict:
        return {}

    def _now(self) -> dict[str, float]:
        return {r: os.path.getmtime(p) for p, r, folder, _ in walk(self.options["path"]) if not folder}

    def _rows(self, relative: list[str]) -> list[tuple]:
        root = self.options["path"]
        there = [(os.path.join(root, r), r) for r in relative if os.path.exists(os.path.join(root, r))]
        gone = [(r, None, None) for r in relative if not os.path.exists(os.path.join(root, r))]
        return [*read_files(there), *gone]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._now()
        changed = sorted(r for r in now.keys() | start.keys() if now.get(r) != start.get(r))[: self.most]
        end = dict(start)
        for r in changed:
            end.pop(r, None)
            if r in now:
                end[r] = now[r]
        return iter(self._rows(changed)), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(sorted(r for r in start.keys() | end.keys() if start.get(r) != end.get(r))))


class RepoSource(DataSource):
    """spark.read.format("repo").option("path", root): a source tree's text files."""

    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> RepoReader:
        return RepoReader(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> RepoStream:
        return RepoStream(dict(self.options))


def entries(spark: SparkSession, root: str, target: str = "", depth_limit: int = 0) -> DataFrame:
    """Files and folders of a tree; none for a target that is not there."""
    return spark.createDataFrame(list(walk(root, target, depth_limit)), ENTRIES)


def files(spark: SparkSession, root: str, target: str = "") -> DataFrame:
    spark.dataSource.register(RepoSource)
    return spark.read.format("repo").option("path", root).option("target", target).load()


def lines(found: DataFrame) -> DataFrame:
    """(file, line, text) of files."""
    split = found.select(F.col("relative_path").alias("file"), F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    return split.select("file", (F.col("at") + 1).cast("long").alias("line"), "text")
