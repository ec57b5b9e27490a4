"""The context tree as rows: parents, order, and the richest level of detail that fits a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.scratch import written

#: What stands before a tree that had to be cut, by level.
CUT = {1: "[Level 1: Headers only, symbols pruned to fit {tokens} tokens]", 0: "[Level 0: File names only, project too large for {tokens} tokens]"}


def units(text: Column) -> Column:
    """A text's length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def placed(entries: DataFrame) -> DataFrame:
    """entries (path, depth, is_directory) with ``chain``, its directories from the top down to itself as
    (depth, path), and ``parent``, null at the top.

    An entry hangs under its folder if that is an entry, too, else at the top; siblings go by depth and
    then by path as the Unicode collation orders it, so sorting by ``chain`` is the tree in order.
    Each entry meets its own folders alone, one row for each step down.
    """
    parts = F.split("path", "/")
    steps = entries.select("path", "depth", "is_directory", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("step", "above"))
    folders = entries.filter("is_directory").select(F.col("path").alias("above"), F.col("depth").alias("above_depth"))
    met = steps.join(folders, "above", "left")
    there = F.col("above_depth").isNotNull() | (F.col("above") == F.col("path"))
    held = met.select("path", "depth", "is_directory", "step", F.when(there, F.struct(F.coalesce("above_depth", "depth").alias("depth"), F.collate("above", "UNICODE").alias("path"))).alias("node"))
    whole = held.groupBy("path", "depth", "is_directory").agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("all"))
    nodes = F.transform("all", lambda s: s["node"])
    # what stands below the last folder that is missing
    gaps = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.element_at(nodes, i).isNull())
    chain = F.slice(nodes, F.coalesce(F.array_max(gaps), F.lit(0)) + 1, F.size("all"))
    return whole.withColumn("chain", chain).select("path", "depth", "is_directory", "chain", F.get("chain", F.size("chain") - 2)["path"].cast("string").alias("parent"))


def symbol_lines(symbols: DataFrame) -> DataFrame:
    """(path, lines) of symbols (file, ordinal, name, kind, line, end_line, signature, parent_name) in order:
    functions and methods by signature, what has a parent a step further in."""
    span = F.concat(F.lit(" (L"), F.col("line").cast("string"), F.when(F.col("end_line") > F.col("line"), F.concat(F.lit("-L"), F.col("end_line").cast("string"))).otherwise(""), F.lit(")"))
    shown = F.when(F.col("kind").isin("function", "method"), F.col("signature")).otherwise(F.col("name"))
    text = F.concat(F.when(F.col("parent_name").isNotNull(), "  ").otherwise(""), "kind", F.lit(": "), shown, span)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("text")))), lambda s: s["text"])
    return symbols.groupBy(F.col("file").alias("path")).agg(listed.alias("lines"))


def context_tree(entries: DataFrame, headers: DataFrame, lines: DataFrame, max_tokens: int = 20000, name: str = ".") -> DataFrame:
    """(chain, path, parent, indent, level, text): the tree's rows, ``text`` as they are shown.

    ``headers`` (path, header) and ``lines`` (path, lines) are of files.  Level 2 shows both, level 1
    headers, level 0 names; the richest one whose whole text takes at most ``max_tokens`` (four units
    of text each) is taken, level 0 at any rate.  Lengths are summed over all rows and the one row of
    sums is joined back, so nothing is collected; sort by ``chain`` to read the tree.  The row of the
    top itself has an empty chain.
    """
    held = placed(entries).join(headers, "path", "left").join(lines, "path", "left")
    indent = F.size("chain")
    pad = F.repeat(F.lit("  "), indent)
    bare = F.concat(pad, F.element_at(F.split("path", "/"), -1), F.when(F.col("is_directory"), "/").otherwise(""))
    headed = F.concat(bare, F.when(~F.col("is_directory") & (F.coalesce("header", F.lit("")) != ""), F.concat(F.lit(" | "), "header")).otherwise(""))
    inner = F.when(~F.col("is_directory"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n"), pad, F.lit("  "), x)), ""))
    rows = held.select("chain", "path", "parent", indent.alias("indent"), bare.alias("t0"), headed.alias("t1"), F.concat(headed, F.coalesce(inner, F.lit(""))).alias("t2"))
    top = entries.sparkSession.range(1).select(F.lit(name + "/").alias("t"))
    sums = rows.agg(*[F.coalesce(F.sum(units(F.col(f"t{i}")) + 1), F.lit(0)).alias(f"n{i}") for i in (1, 2)]).withColumns({f"n{i}": F.col(f"n{i}") + len(name) + 2 for i in (1, 2)})
    fits = lambda n: F.ceil(F.col(n) / F.lit(4.0)) <= max_tokens
    level = sums.select(F.when(fits("n2"), 2).when(fits("n1"), 1).otherwise(0).alias("level"))
    shown = rows.crossJoin(F.broadcast(level))  # one row
    text = F.when(F.col("level") == 2, F.col("t2")).when(F.col("level") == 1, F.col("t1")).otherwise(F.col("t0"))
    out = shown.select("chain", "path", "parent", "indent", "level", text.alias("text"))
    first = top.crossJoin(F.broadcast(level)).select(F.expr("array()").cast(out.schema["chain"].dataType).alias("chain"), F.lit(name).alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("indent"), "level", F.col("t").alias("text"))
    return first.unionByName(out)


def places(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows without the first column of ``order``, with ``place`` from 1 by ``order`` within ``by``.

    Rows are dealt by range and sorted in their tasks; numbers of rows of the parts before are added, so
    no task holds all of a group.
    """
    marks = {"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}
    held = written(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumns(marks).drop(order[0]), "places")
    parts = held.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    start = parts.select(by, "__part", (before + 1 - F.col("first")).alias("start"))
    return held.join(F.broadcast(start), [by, "__part"]).withColumn("place", F.col("__at") + F.col("start")).drop("__part", "__at", "start")


def rendered(tree: DataFrame, max_tokens: int) -> str:
    """The text of a context_tree, with a word about what was cut."""
    rows = tree.orderBy("chain", "path").select("level", "text").collect()
    cut = CUT.get(rows[0].level)
    return (cut.format(tokens=max_tokens) + "\n\n" if cut else "") + "".join(r.text + "\n" for r in rows)
