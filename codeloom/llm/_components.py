"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs, rows (node, root) with the least node reachable.

    Each round joins every node to the least of its neighbours, with aggregation before the shuffle
    and a join that Spark may split, so that a hub is no single task's work; links never outgrow the
    number of nodes and links given.  Each round's links are written to the shared folder, and the
    round before is removed.  Rounds grow with the logarithm of the longest path.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    state = _state(edges)
    while state[0] and state != before:
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(least, both.a == least.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "links-large")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(low, large.a == low.u)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        after = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links-small")
        state = _state(after)
        discard(edges)
        discard(large)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
