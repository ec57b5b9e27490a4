"""Diagram tables: ids, groups, layout, and checks of what a model wrote."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.scratch import written

#: Characters of new ids that a task of ``rewired`` writes out, about.
WRITTEN_OUT = 1 << 30
#: Ids that the layout keeps for itself.
RESERVED = ("__boundary__", "root")


def without_fence(text: Column) -> Column:
    """A JSON text without the code fence around it."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", "")


def json_array_in(text: Column) -> Column:
    """From the first [ to the last ], null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def integrity(nodes: DataFrame, edges: DataFrame, groups: DataFrame, node_range: tuple[int, int] = (12, 30), group_range: tuple[int, int] = (3, 6)) -> DataFrame:
    """(rule, n) of what is broken: edges with an end that is no node, nodes without an edge, nodes of
    no known group, and numbers of nodes and groups out of range."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    ids = nodes.select("node").distinct()
    dangling = ends.join(ids, "node", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dangling").alias("rule"), "n")
    isolated = nodes.join(ends.distinct(), "node", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("isolated").alias("rule"), "n")
    ungrouped = nodes.join(groups.select(F.col("id").alias("group")), "group", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("ungrouped").alias("rule"), "n")

    def sized(df: DataFrame, name: str, bounds: tuple[int, int]) -> DataFrame:
        return df.agg(F.when(F.count(F.lit(1)).between(*bounds), 0).otherwise(1).cast("long").alias("n")).select(F.lit(name).alias("rule"), "n")

    out = dangling.union(isolated).union(ungrouped).union(sized(nodes, "node-count", node_range)).union(sized(groups, "group-count", group_range))
    return out.filter("n > 0")


def latest_status(events: DataFrame) -> DataFrame:
    """Each node's last status by time."""
    return events.groupBy("node").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"))


def _named(rows: DataFrame, taken: DataFrame, prefix: str) -> DataFrame:
    """rows (id, ...) with ``named``: ids that are reserved or among ``taken`` (id) get the prefix."""
    held = taken.select("id", F.lit(True).alias("taken")).distinct()
    clash = F.col("id").isin(*RESERVED) | F.col("taken").isNotNull()
    return rows.join(held, "id", "left").withColumn("named", F.when(clash, F.concat(F.lit(prefix), "id")).otherwise(F.col("id"))).drop("taken")


def numbered_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(n, id, base, dups) of nodes (n, id), n being their order: ids that are reserved or a group's get a
    prefix, and one that is in use ``_dup`` until it is free; base with ``_dup`` so many times.

    Only ids that differ by such endings can meet, so each base is a group of its own; within one the
    next free ending is remembered, and the walk is linear.  Endings are numbers here, since written
    out they grow with the square of the nodes of an id.
    """

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[int, int] = {}
        out = []
        pdf = pdf.sort_values("n")
        for k in pdf["k"].tolist():
            free, way = k, []
            while free in after:
                way.append(free)
                free = after[free]
            after |= dict.fromkeys([*way, free], free + 1)
            out.append(free)
        return pdf[["n", "id", "base"]].assign(dups=np.array(out, np.int32))

    bare = F.regexp_extract("named", r"(?s)^(.*?)((?:_dup)*)\z", 1)
    held = _named(nodes.select("n", "id"), groups, "nd_").withColumn("base", bare).withColumn("k", ((F.length("named") - F.length("base")) / 4).cast("int"))
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return held.groupBy("base").applyInPandas(spread, f"n {types['n']}, id string, base string, dups int")


def unique_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(n, id, new_id) of numbered_nodes, written out."""
    return numbered_nodes(nodes, groups).select("n", "id", F.concat("base", F.repeat(F.lit("_dup"), F.col("dups"))).alias("new_id"))


def unique_groups(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, new_id) of groups: those reserved or named like a node get a prefix."""
    return _named(groups.select("id").distinct(), nodes, "grp_").withColumnRenamed("named", "new_id")


def rewired(edges: DataFrame, renamed: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) by the new ids of ``unique_nodes`` or ``numbered_nodes``; of nodes that shared an id
    the last has the edges, and an end that is no node stays.  Of the latter ids are written out at the end,
    in the row of their edge: edges are dealt to tasks by how much that is, and equal ends follow each
    other, which files hold once."""
    named = renamed if "dups" in renamed.columns else renamed.select("n", "id", F.col("new_id").alias("base"), F.lit(0).alias("dups"))
    last = named.groupBy("id").agg(F.max_by(F.struct("base", "dups"), "n").alias("to"))
    out = edges
    for end in ("src", "dst"):
        out = out.join(last.withColumnsRenamed({"id": end, "to": f"__{end}"}), end, "left")
    held = written(out, "rewired")
    size = sum((F.coalesce(F.length(f"__{end}.base") + 4 * F.col(f"__{end}.dups").cast("long"), F.length(end), F.lit(0)) for end in ("src", "dst")), F.lit(0))
    total = held.agg(F.sum(size)).first()[0] or 0
    if total > WRITTEN_OUT:
        held = held.repartitionByRange(-(-total // WRITTEN_OUT), "src", "dst", F.rand(0)).sortWithinPartitions("src", "dst")
    new = lambda end: F.coalesce(F.concat(F.col(f"__{end}.base"), F.repeat(F.lit("_dup"), F.col(f"__{end}.dups"))), end)
    return held.select(*[new(c).alias(c) if c in ("src", "dst") else c for c in edges.columns])


def in_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes with ``group`` as the new id of their group, null where there is no such group."""
    known = unique_groups(groups, nodes).withColumnsRenamed({"id": "group", "new_id": "to"})
    return nodes.join(known, "group", "left").withColumn("group", F.col("to")).drop("to").select(*nodes.columns)


def layered(nodes: DataFrame, across: int = 280, down: int = 90) -> DataFrame:
    """(node, x, y) of nodes (node, depth): a column for each depth, in order of node."""
    row = F.row_number().over(Window.partitionBy("depth").orderBy("node")) - 1
    return nodes.select("node", (F.col("depth") * across).alias("x"), (row * down).cast("long").alias("y"))


def bounding_boxes(boxes: DataFrame) -> DataFrame:
    """(group, x, right, y, bottom) around boxes (group, x, y, width, height)."""
    return boxes.groupBy("group").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"), F.min("y").alias("y"), F.max(F.col("y") + F.col("height")).alias("bottom"))


def bundled(edges: DataFrame) -> DataFrame:
    """Parallel edges (src, dst, weight) as one with their number and weight."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


def sequence_rules(actors: DataFrame, messages: DataFrame, actor_range: tuple[int, int] = (4, 8), message_range: tuple[int, int] = (10, 25)) -> DataFrame:
    """(rule, n) of what a sequence diagram breaks: numbers of actors and messages out of range, orders of
    messages that repeat or leave gaps, and ends that are no actor."""
    n = F.count(F.lit(1))
    sized = actors.agg((~n.between(*actor_range)).cast("long").alias("n")).select(F.lit("actor-count").alias("rule"), "n")
    many = messages.agg((~n.between(*message_range)).cast("long").alias("n")).select(F.lit("message-count").alias("rule"), "n")
    gaps = F.coalesce(F.max("order") - F.min("order") + 1 - F.countDistinct("order"), F.lit(0)) + n - F.countDistinct("order")
    order = messages.agg(gaps.cast("long").alias("n")).select(F.lit("order").alias("rule"), "n")
    ends = messages.select(F.explode(F.array("src", "dst")).alias("id")).join(actors.select("id"), "id", "left_anti").agg(n.alias("n")).select(F.lit("unknown-actor").alias("rule"), "n")
    return sized.union(many).union(order).union(ends).filter("n > 0")


def entity_rules(entities: DataFrame, attributes: DataFrame, relations: DataFrame, least_attributes: int = 3) -> DataFrame:
    """(entity, rule) of entities (entity, weak) without a relation, with fewer attributes (entity, name,
    is_key) than asked for, or without a key unless they are weak."""
    related = relations.select(F.explode(F.array("src", "dst")).alias("entity")).distinct().withColumn("related", F.lit(True))
    held = attributes.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("is_key").alias("keyed"))
    all_of = entities.join(related, "entity", "left").join(held, "entity", "left")
    broken = F.array_compact(
        F.array(
            F.when(F.col("related").isNull(), "no-relationship"),
            F.when(F.coalesce("n", F.lit(0)) < least_attributes, "few-attributes"),
            F.when(~F.coalesce("keyed", F.lit(False)) & ~F.coalesce("weak", F.lit(False)), "no-key"),
        )
    )
    return all_of.select("entity", F.explode(broken).alias("rule"))
