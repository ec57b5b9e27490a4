"""Graph operators over edges (src, dst): expansion, reachability, degrees, flattening."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How deep each kind of question looks, and along which kinds of edges.
EXPANSION = {
    "service_overview": (4, ("contains", "calls")),
    "call_chain": (8, ("calls",)),
    "failure_path": (6, ("calls", "contains")),
    "data_lineage": (6, ("produces", "consumes", "transforms")),
    "dependency_impact": (5, ("calls", "imports")),
}
#: What makes a node matter to each kind of question.
WEIGHTS = {
    "service_overview": {"fan_in": 0.30, "fan_out": 0.15, "errors": 0.25, "cloud": 0.15, "entry_point": 0.15},
    "call_chain": {"depth": 0.40, "errors": 0.30, "cloud": 0.20},
    "failure_path": {"error_status": 0.50, "caller_of_failing": 0.30, "dependency_of_failing": 0.20},
    "data_lineage": {"data_flow_type": 0.40, "transformer": 0.25, "errors": 0.20, "cloud": 0.15},
    "dependency_impact": {"blast_fan_in": 0.40, "service_level": 0.30, "already_failing": 0.30},
}


def call_paths(edges: DataFrame, root: int, max_depth: int = 6) -> DataFrame:
    """The tree of paths from root: (path, depth, node, is_cycle, is_leaf).

    A node that stands on its own path already is a cycle and is not expanded, nor is one at max_depth.
    One join for each level, in one plan; the tree grows with the out-degree to the depth.
    """
    level = edges.sparkSession.range(1).select(F.array(F.lit(root).cast("long")).alias("path"), F.lit(0).alias("depth"), F.lit(root).cast("long").alias("node"), F.lit(False).alias("is_cycle"))
    levels = [level]
    for depth in range(1, max_depth + 1):
        going = level.filter("not is_cycle").select(F.col("path").alias("p"), F.col("node").alias("n"))
        level = going.join(edges, (going.n == edges.src) & (edges.src != edges.dst)).select(
            F.concat("p", F.array("dst")).alias("path"), F.lit(depth).alias("depth"), F.col("dst").alias("node"), F.array_contains("p", F.col("dst")).alias("is_cycle")
        )
        levels.append(level)
    paths = reduce(DataFrame.unionByName, levels)
    sources = edges.filter("src <> dst").select(F.col("src").alias("node")).distinct().withColumn("has_calls", F.lit(True))
    leaf = F.col("is_cycle") | (F.col("depth") == max_depth) | F.col("has_calls").isNull()
    return paths.join(sources, "node", "left").select("path", "depth", "node", "is_cycle", leaf.alias("is_leaf"))


def path_stats(paths: DataFrame) -> DataFrame:
    """Counts over occurrences in the tree, and its depth."""
    return paths.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_leaf")).alias("internal"), F.count_if("is_leaf").alias("leaves"), F.count_if("is_cycle").alias("cycles"), F.max("depth").alias("max_depth")
    )


def flatten_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the depth of their first occurrence in order, and edges of occurrences whose parent
    is a first visit.  Exact where no first occurrence is cut short; see flatten_truncated."""
    order = Window.partitionBy("node").orderBy("path")
    ranked = paths.withColumn("visit", F.row_number().over(order))
    nodes = ranked.filter("visit = 1").select("node", "depth")
    firsts = ranked.filter("visit = 1").select(F.col("path").alias("parent_path"))
    inner = paths.filter("depth > 0").withColumn("parent_path", F.expr("slice(path, 1, size(path) - 1)"))
    edges = inner.join(firsts, "parent_path", "left_semi").select(F.element_at("path", -2).alias("src"), F.col("node").alias("dst")).distinct()
    return nodes, edges


def flatten_truncated(paths: DataFrame) -> DataFrame:
    """The general, sequential flattening: a pre-order walk in which the first visit fixes a node and the
    subtree of a later visit is skipped.  One task; the tree is bounded by the depth limit."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[int, tuple] = {}
        skipped: list[tuple] = []
        rows = sorted((tuple(p), d, n, leaf, cycle) for p, d, n, leaf, cycle in zip(pdf.path, pdf.depth, pdf.node, pdf.is_leaf, pdf.is_cycle, strict=True))
        for path, depth, node, leaf, cycle in rows:
            if any(path[: len(s)] == s for s in skipped[-1:]):
                continue
            if node in seen:
                skipped.append(path)
            else:
                seen[node] = (depth, leaf, cycle)
        return pd.DataFrame([(n, *v) for n, v in seen.items()], columns=["node", "depth", "is_leaf", "is_cycle"])

    return paths.groupBy(F.lit(1).alias("all")).applyInPandas(walk, "node long, depth int, is_leaf boolean, is_cycle boolean")


def reach(edges: DataFrame, root: int, max_depth: int) -> DataFrame:
    """(node, depth): the least number of steps from root, up to max_depth."""
    return reach_from(edges, edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("node")), max_depth)


def reach_from(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): the least number of steps from any of the roots (node), up to max_depth."""
    front = roots.select("node").distinct()
    levels = [front.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        at = front.withColumnRenamed("node", "at")
        front = at.join(edges, F.col("at") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        levels.append(front.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.min("depth").alias("depth"))


def descendants(tree: DataFrame, most_levels: int = 1000) -> DataFrame:
    """(root, node, steps) of a forest (node, parent), to any depth; roots have no parent and 0 steps.

    A recursive query, so that levels end where the tree does.  The input is no graph with cycles;
    ``most_levels`` only stops those."""
    query = """WITH RECURSIVE below(root, node, steps) MAX RECURSION LEVEL {most} AS (
        SELECT node, node, 0 FROM {tree} WHERE parent IS NULL
        UNION ALL SELECT b.root, t.node, b.steps + 1 FROM below b JOIN {tree} t ON t.parent = b.node)
        SELECT root, node, steps FROM below"""
    return tree.sparkSession.sql(query.replace("{most}", str(int(most_levels))), tree=tree)


def expand(edges: DataFrame, roots: DataFrame, question: str) -> tuple[DataFrame, DataFrame]:
    """The subgraph of a kind of question: (node, depth) reached from the roots (node) along the kinds of
    edges (src, dst, kind) that it follows, and those edges between them."""
    depth, kinds = EXPANSION[question]
    followed = edges.filter(F.col("kind").isin(*kinds))
    nodes = reach_from(followed, roots, depth)
    ends = nodes.select("node")
    inner = followed.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, inner.select(*edges.columns)


def score_nodes(nodes: DataFrame, question: str) -> DataFrame:
    """(node, score, reasons) by the weights of a kind of question: factors are columns from 0 to 1, and
    one that isn't there or is null counts 0.  Reasons name the factors that count, with their share."""
    parts = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(w) for f, w in WEIGHTS[question].items() if f in nodes.columns}
    reasons = F.array_compact(F.array(*[F.when(x > 0, F.format_string(f"{f} (%.2f)", x)) for f, x in parts.items()]))
    total: Column = sum(parts.values(), F.lit(0.0))
    return nodes.select("node", total.alias("score"), reasons.cast("array<string>").alias("reasons"))


def scaled_degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, entry_point) as factors: degrees as shares of the greatest."""
    d = degrees(edges)
    top = d.agg(F.max("fan_in"), F.max("fan_out")).first()
    share = lambda name, most: F.col(name) / F.lit(float(most or 1))
    return d.select("node", share("fan_in", top[0]).alias("fan_in"), share("fan_out", top[1]).alias("fan_out"), (F.col("fan_in") == 0).cast("double").alias("entry_point"))


def between(edges: DataFrame) -> DataFrame:
    """(node, callee, caller): what a node calls with what calls it, the two-step paths through each."""
    callers = edges.select(F.col("src").alias("caller"), F.col("dst").alias("node"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("callee")).join(callers, "node").select("node", "callee", "caller")


def degrees(edges: DataFrame) -> DataFrame:
    """Fan-out and fan-in of every node, in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing points to."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node; a self-loop is left out."""
    ends = nodes.select("node", F.lit(True).alias("there"))
    held = edges.filter("src <> dst").join(ends.withColumnsRenamed({"node": "src", "there": "src_there"}), "src", "left").join(ends.withColumnsRenamed({"node": "dst", "there": "dst_there"}), "dst", "left")
    return held.filter("src_there is null or dst_there is null").select(*edges.columns)
