"""Lines, usages, definitions, calls and rules over source lines (file, line, text)."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T


def explode_lines(files: DataFrame, path: str, content: str) -> DataFrame:
    """(file, line, text) of each line, counted from 1."""
    return files.select(F.col(path).alias("file"), F.posexplode(T.lines_of(F.col(content))).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def lines_with(files: DataFrame, path: str, content: str, words: list[str]) -> DataFrame:
    """The rows of explode_lines that have one of the words as a whole word.  Lines are held against the
    words inside the row of their file, so that only those that match become rows; files that do not
    contain a word at all are not split."""
    holds = lambda text: functools.reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])
    pattern = "|".join(T.whole_word(w) for w in words)
    kept = files.filter(holds(F.col(content))).select(F.col(path).alias("file"), T.lines_of(F.col(content)).alias("lines"))
    numbered = F.transform("lines", lambda text, at: F.when(holds(text) & text.rlike(pattern), F.struct((at + 1).alias("line"), text.alias("text"))))
    return kept.select("file", F.inline_outer(F.array_compact(numbered))).filter("line is not null")


def usages(lines: DataFrame, word: str, context: str | None = None) -> DataFrame:
    """One row per line that has the word; definition lines in the context file are left out."""
    found = lines.filter(F.col("text").rlike(T.whole_word(word)))
    if context is not None:
        found = found.filter(~(F.col("file").eqNullSafe(F.lit(context)) & T.is_definition(F.col("text"), word)))
    return found.select("file", "line", F.substring(T.trimmed(F.col("text")), 1, 120).alias("context"))


def blast_radius(lines: DataFrame, word: str, context: str | None = None) -> DataFrame:
    """Usages of a word by file."""
    return usages(lines, word, context).groupBy("file").agg(F.count(F.lit(1)).alias("usages"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def blast_summary(lines: DataFrame, words: list[str]) -> DataFrame:
    """Usage lines and files of each word, in one scan."""
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike(T.whole_word(w)), F.lit(w)) for w in words]))
    found = lines.filter(F.col("text").rlike("|".join(T.whole_word(w) for w in words))).select("file", F.explode(hit).alias("word"))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("usages"), F.countDistinct("file").alias("files")).withColumn("low_usage", F.col("usages") <= 1)


def calls(lines: DataFrame) -> DataFrame:
    """(file, line, ordinal, callee): each name once a line, where it first stands."""
    each = lines.select("file", "line", F.posexplode(T.calls_of(F.col("text"))).alias("ordinal", "callee"))
    return each.groupBy("file", "line", "callee").agg(F.min("ordinal").cast("long").alias("ordinal"))


def definitions(lines: DataFrame) -> DataFrame:
    """(file, line, kind, name) of lines that start a function or class."""
    return lines.select("file", "line", F.regexp_extract("text", r"^(?:export )?(function|class) (\w+)", 1).alias("kind"), F.regexp_extract("text", r"^(?:export )?(function|class) (\w+)", 2).alias("name")).filter("name <> ''")


def folder_of(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def best_definition(candidates: DataFrame, by: list[str], path: Column, from_dir: Column, *ordinal: str) -> DataFrame:
    """One candidate for each key: no test file if there is another, then one whose path starts with the
    caller's folder, then the first."""
    order = Window.partitionBy(*by).orderBy(T.is_test_path(path), ~path.startswith(from_dir), *ordinal)
    return candidates.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def resolve_calls(called: DataFrame, defined: DataFrame) -> DataFrame:
    """Calls with the best definition of their name; a name without one is external."""
    names = called.select("file", "callee").distinct()
    found = names.join(defined.select(F.col("file").alias("def_file"), F.col("line").alias("def_line"), "name"), F.col("callee") == F.col("name"))
    best = best_definition(found, ["file", "callee"], F.col("def_file"), folder_of(F.col("file")), "def_file", "def_line")
    return called.join(best.select("file", "callee", "def_file", "def_line"), ["file", "callee"], "left").withColumn("external", F.col("def_file").isNull())


def brace_depth(lines: DataFrame) -> DataFrame:
    """The most braces open after any line of a file, and its number of lines."""
    delta = F.regexp_count("text", F.lit("\\{")) - F.regexp_count("text", F.lit("\\}"))
    running = F.sum(delta).over(Window.partitionBy("file").orderBy("line"))
    return lines.withColumn("depth", running).groupBy("file").agg(F.max("depth").alias("max_depth"), F.count(F.lit(1)).alias("n_lines"))


#: Comment markers of the languages that need a header, by extension.
HEADER_MARKS = {
    ".ts": "//", ".tsx": "//", ".js": "//", ".jsx": "//",
    ".rs": "//", ".go": "//", ".c": "//", ".cpp": "//",
    ".java": "//", ".cs": "//", ".swift": "//", ".kt": "//",
    ".py": "#", ".rb": "#", ".lua": "--", ".zig": "//",
}
HASH_COMMENTS = (".py", ".rb")


def comment_violations(lines: DataFrame) -> DataFrame:
    """Comment lines from the third line on, by the marker of the file's extension, of files that are code."""
    bare = T.trimmed(F.col("text"))
    hashed = T.suffix(F.col("file")).isin(*HASH_COMMENTS)
    comment = F.when(hashed, bare.startswith("#") & ~bare.startswith("#!") & ~bare.startswith("#include")).otherwise(bare.startswith("//"))
    return lines.filter((F.col("line") > 2) & T.is_supported(F.col("file")) & comment).select("file", "line", F.substring(bare, 1, 80).alias("comment"))


def header_violations(lines: DataFrame) -> DataFrame:
    """(file, rule): fewer than two comment lines among the first five, or no feature tag in the second
    of them; languages without a marker of their own have no such rule."""
    pairs = [F.lit(x) for pair in HEADER_MARKS.items() for x in pair]
    marked = lines.filter("line <= 5").withColumn("mark", F.element_at(F.create_map(*pairs), T.suffix(F.col("file")))).filter("mark is not null")
    heads = F.sort_array(F.collect_list(F.when(F.expr("startswith(text, mark)"), F.struct("line", "text"))))
    found = marked.groupBy("file").agg(heads.alias("heads"))
    rule = F.when(F.size("heads") < 2, "header").when(~F.contains(F.upper(F.get("heads", F.lit(1))["text"]), F.lit("FEATURE:")), "feature-tag")
    return found.select("file", rule.alias("rule")).filter("rule is not null")


def violations(lines: DataFrame, most_comments: int = 5, most_depth: int = 6, most_lines: int = 1000) -> DataFrame:
    """Broken rules by file with counts; only too many comments reject."""
    comments = comment_violations(lines).groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.lit("no-comments").alias("rule"), "n")
    shape = brace_depth(lines)
    deep = shape.filter(F.col("max_depth") > most_depth).select("file", F.lit("nesting").alias("rule"), F.lit(1).cast("long").alias("n"))
    long = shape.filter(F.col("n_lines") > most_lines).select("file", F.lit("file-length").alias("rule"), F.lit(1).cast("long").alias("n"))
    header = header_violations(lines).withColumn("n", F.lit(1).cast("long"))
    return comments.unionByName(deep).unionByName(long).unionByName(header).withColumn("rejects", (F.col("rule") == "no-comments") & (F.col("n") > most_comments))


def indent_parents(lines: DataFrame) -> DataFrame:
    """The last line before that is indented less, or null; blank lines are left out.  A file's lines
    are walked in order with a stack, in the task that holds the file."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, int]] = []
        out = []
        for file, line, indent in pdf.sort_values("line")[["file", "line", "indent"]].itertuples(index=False):
            while stack and stack[-1][0] >= indent:
                stack.pop()
            out.append((file, line, indent, stack[-1][1] if stack else None))
            stack.append((indent, line))
        return pd.DataFrame(out, columns=["file", "line", "indent", "parent_line"]).astype({"parent_line": "Int64"})

    held = lines.filter(T.trimmed(F.col("text")) != "").select("file", F.col("line").cast("long"), F.length(F.regexp_extract("text", "^( *)", 1)).alias("indent"))
    return held.groupBy("file").applyInPandas(walk, "file string, line long, indent int, parent_line long")
