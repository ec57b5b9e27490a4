"""Call chains: who calls what, from the bodies of symbols, and the tree of calls below a symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.code import best_definition, folder_of
from codeloom.sources.scratch import written

#: What the rendering of a chain says.
NOT_FOUND = 'Symbol "{name}" not found. Use get_context_tree to discover function names.'
SEVERAL = '"{name}" found in {n} files. Narrow with file_path:'
TITLE = 'Call chain for "{name}" (max depth: {depth})'
COUNTS = "{total} node(s) | {internal} internal hop(s) | {leaves} leaf(ves) | {db_hits} db hit(s) | {cycles} cycle(s)"


def bodies(symbols: DataFrame, files: DataFrame, marks: list[str] | None = None) -> DataFrame:
    """Symbols (file, name, kind, line, end_line, signature) with key (file:line), callees (names called in the body,
    each once, in order), is_db_hit (by its name or a line of its body) and is_marked (a line matches one
    of ``marks``).

    Lines are looked at once for each file, whose (relative_path, content) is one row; symbols join by
    file and slice what was found.  A symbol of a file that isn't there has no callees.
    """
    lines = T.lines_of(F.col("content"))
    marked = lambda x: F.exists(F.array(*map(F.lit, marks)), lambda p: F.rlike(x, p)) if marks else F.lit(False)
    facts = files.select(
        F.col("relative_path").alias("file"), F.transform(lines, T.calls_of).alias("called"), F.transform(lines, T.is_db_line).alias("db"), F.transform(lines, marked).alias("marks")
    )

    def of_body(name: str) -> Column:
        return F.slice(F.coalesce(name, F.array()), F.col("line").cast("int"), (F.col("end_line") - F.col("line") + 1).cast("int"))

    any_of = lambda name: F.exists(of_body(name), lambda x: x)
    held = symbols.join(facts, "file", "left")
    return held.select(
        *symbols.columns,
        F.concat_ws(":", "file", F.col("line").cast("string")).alias("key"),
        F.array_distinct(F.flatten(of_body("called"))).alias("callees"),
        (T.is_db_name(F.col("name")) | any_of("db")).alias("is_db_hit"),
        any_of("marks").alias("is_marked"),
    )


def call_edges(held: DataFrame) -> DataFrame:
    """(src, file, caller, ordinal, callee, dst, external): calls of each of the ``bodies``, in order, with the
    key of the best definition of their name; calls of the caller's own name are left out.

    Names are resolved once for each file that calls them.
    """
    called = held.select(F.col("key").alias("src"), "file", F.col("name").alias("caller"), F.posexplode("callees").alias("ordinal", "callee")).filter("callee <> caller")
    defined = held.select(F.col("name").alias("callee"), F.col("key").alias("dst"), F.col("file").alias("def_file"), F.col("line").alias("def_line"))
    found = called.select("file", "callee").distinct().join(defined, "callee")
    best = best_definition(found, ["file", "callee"], F.col("def_file"), folder_of(F.col("file")), "def_file", "def_line")
    return called.join(best.select("file", "callee", "dst"), ["file", "callee"], "left").select("src", "file", "caller", "ordinal", "callee", "dst", F.col("dst").isNull().alias("external"))


def call_chains(held: DataFrame, roots: DataFrame, max_depth: int = 6) -> DataFrame:
    """The tree of calls below each of the roots (key): one row for each occurrence with root, path,
    depth, name, key, file, line, end_line, signature, is_db_hit, is_marked, is_external, is_cycle and is_leaf.

    ``path`` holds the places of calls on the way; its order is that of a walk from call to call.  A
    name without a definition is external, one that is on its own path a cycle; neither is expanded, nor
    is what stands at ``max_depth``, but a root's own calls are there at any rate.  The tree grows with
    the calls in a body to the depth.  Edges, with what is known of their end, and each level are
    written once and read again, so no level is computed twice and none has a limit of rows.
    """
    held = written(held, "bodies")
    edges = call_edges(held)
    calling = edges.select(F.col("src").alias("key")).distinct().withColumn("calls", F.lit(True))
    facts = held.select("key", "file", "line", "end_line", "signature", F.col("is_db_hit").alias("db"), F.col("is_marked").alias("mark")).join(calling, "key", "left")
    known = facts.columns[1:]
    hops = edges.select("src", "ordinal", "callee", "dst")
    inner = hops.filter("dst is not null").join(facts.withColumnRenamed("key", "dst"), "dst")
    outer = hops.filter("dst is null").withColumns({c: F.lit(None).cast(facts.schema[c].dataType) for c in known})
    hops = written(inner.unionByName(outer), "call-edges")
    start = held.select("key", "name").join(roots.select("key").distinct(), "key").join(facts, "key")
    level = start.select(
        F.col("key").alias("root"), F.array().cast("array<int>").alias("path"), F.array("key").alias("keys"), F.lit(0).alias("depth"), "name", "key",
        F.lit(False).alias("is_external"), F.lit(False).alias("is_cycle"), *known,
    )
    levels = [written(level, "chain")]
    for depth in range(1, max(1, int(max_depth)) + 1):
        going = levels[-1].filter("not is_cycle and not is_external").select("root", F.col("path").alias("way"), F.col("keys").alias("on"), F.col("key").alias("src"))
        level = going.join(hops, "src").select(
            "root", F.concat("way", F.array("ordinal")).alias("path"), F.concat("on", F.array("dst")).alias("keys"), F.lit(depth).alias("depth"), F.col("callee").alias("name"), F.col("dst").alias("key"),
            F.col("dst").isNull().alias("is_external"), F.coalesce(F.array_contains("on", F.col("dst")), F.lit(False)).alias("is_cycle"), *known,
        )
        levels.append(written(level, "chain"))
    cut = (F.col("depth") >= max_depth) & (F.col("depth") > 0)
    return reduce(DataFrame.unionByName, levels).select(
        "root", "path", "depth", "name", "key", "file", "line", "end_line", "signature",
        F.when(F.col("is_external"), T.is_db_name(F.col("name"))).otherwise(F.col("db") & ~F.col("is_cycle")).alias("is_db_hit"),
        F.when(F.col("is_external") | F.col("is_cycle"), False).otherwise(F.col("mark")).alias("is_marked"),
        "is_external", "is_cycle",
        (F.col("is_external") | F.col("is_cycle") | cut | F.col("calls").isNull()).alias("is_leaf"),
    )


def chain_stats(chain: DataFrame) -> DataFrame:
    """By root: all occurrences, internal ones (neither external, cycle nor leaf), leaves, database hits and cycles."""
    inner = ~(F.col("is_external") | F.col("is_cycle") | F.col("is_leaf"))
    return chain.groupBy("root").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(inner).alias("internal"), F.count_if("is_leaf").alias("leaves"), F.count_if("is_db_hit").alias("db_hits"), F.count_if("is_cycle").alias("cycles")
    )


def flatten_chain(chain: DataFrame) -> DataFrame:
    """(root, node, first_path, depth, times): each node of a tree once, where a walk from call to call
    meets it first, with how often it occurs.  External nodes go by their name.

    The least path of a node is found with a combine in each task, so no task holds the whole tree.
    """
    node = F.coalesce("key", F.concat(F.lit("ext:"), "name"))
    first = chain.select("root", node.alias("node"), "path", "depth").groupBy("root", "node").agg(F.min(F.struct("path", "depth")).alias("first"), F.count(F.lit(1)).alias("times"))
    return first.select("root", "node", F.col("first.path").alias("first_path"), "first.depth", "times")


def starts(symbols: DataFrame, name: str, path: str | None = None) -> list[Row]:
    """Where a chain of a name may start, in order: more than one if it is ambiguous, none if unknown.

    With ``path``, the first definition whose file is or ends with it, else the best one.  Without,
    those outside tests; if all are in tests, the first.  The definitions of one name come to the driver.
    """
    found = symbols.filter(F.col("name") == name).orderBy("file", "line").collect()
    if not found or path is None:
        outside = [s for s in found if "test" not in s.file and "spec" not in s.file]
        return outside if outside else found[:1]
    wanted = path.replace("\\", "/")
    exact = [s for s in found if s.file.endswith(wanted)]
    plain = [s for s in found if not any(x in s.file for x in ("test", "spec", ".demo."))]
    return (exact or plain or found)[:1]


def render_chain(rows: list[Row]) -> str:
    """The rows of one root in order of their path, as a tree."""
    last = {tuple(r.path[:-1]): r.path[-1] for r in rows if r.path}
    ends = lambda path: last[path[:-1]] == path[-1]
    out = []
    for r in rows:
        path = tuple(r.path)
        label = r.name if r.is_external else f"{r.name}  {r.file}  {span(r)}"
        notes = [("  [leaf]", r.is_external or (r.is_leaf and not r.is_cycle)), ("  ★ db", r.is_db_hit), ("  ★ marked", r.is_marked), ("  ↩ cycle", r.is_cycle)]
        above = "".join("   " if ends(path[:i]) else "│  " for i in range(1, len(path)))
        branch = ("└─ " if ends(path) else "├─ ") if path else ""
        out.append(above + branch + label + "".join(note for note, holds in notes if holds))
    return "\n".join(out) + "\n"


def span(row: Row) -> str:
    return f"L{row.line}" + (f"-L{row.end_line}" if row.end_line > row.line else "")
