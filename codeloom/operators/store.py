"""Nodes and edges as tables by type, what is asked of them, and the view that a screen shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of nodes, from the outermost to the innermost, then those beside them; types of edges.
NODE_TYPES = "repository service package file function struct interface cloud_service runtime_instance data_flow".split()
EDGE_TYPES = "contains calls imports implements embeds produces consumes connects_to queue_publish queue_subscribe http_call data_transform".split()
#: Below which zoom which types alone are shown; at the last one and above all are.
ZOOM = ((0.4, ("service",)), (0.7, ("service", "package")), (1.0, ("service", "package", "file")))
NODE = "id string, name string, parent_id string, file_path string, line_start int, line_end int, metadata variant, type string"
EDGE = "id string, source_id string, target_id string, importance double, metadata variant, type string"


def _variant(rows: DataFrame) -> DataFrame:
    """Metadata as VARIANT, from JSON text if it is not one yet."""
    return rows if rows.schema["metadata"].dataType.simpleString() == "variant" else rows.withColumn("metadata", F.try_parse_json("metadata"))


class GraphStore:
    """Two tables with a folder for each type.

    Rows of a type are ordered by id, nodes that are asked for by parent or file lie in few row groups
    of the types that have such; filters on types prune folders, filters on the other columns go to the scan.
    What a node or an edge has beyond the common columns is in ``metadata``, a VARIANT, read by path.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Writes both tables anew.  Of rows with one id the first by type and name, or by type and ends,
        stays; null ids and types that are unknown are left out.  An edge's importance is 1 where none is given."""
        known = nodes.filter(F.col("type").isin(*NODE_TYPES) & F.col("id").isNotNull())
        self._write(_variant(self._first(known, "type", "name")), "nodes", NODE, ["type", "id"])
        marked = edges.filter(F.col("type").isin(*EDGE_TYPES) & F.col("id").isNotNull()).withColumn("importance", F.coalesce("importance", F.lit(1.0)))
        self._write(_variant(self._first(marked, "type", "source_id", "target_id")), "edges", EDGE, ["type", "source_id"])

    @staticmethod
    def _first(rows: DataFrame, *order: str) -> DataFrame:
        return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct(*order)).alias("row")).select("id", "row.*")

    def _write(self, rows: DataFrame, table: str, schema: str, order: list[str]) -> None:
        names = [c.split()[0] for c in schema.split(", ")]
        rows.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("type").parquet(f"{self.path}/{table}")

    def nodes(self, *types: str) -> DataFrame:
        """All nodes, or those of some types, whose folders alone are read."""
        held = self.spark.read.schema(NODE).parquet(f"{self.path}/nodes")
        return held.filter(F.col("type").isin(*types)) if types else held

    def edges(self, *types: str) -> DataFrame:
        held = self.spark.read.schema(EDGE).parquet(f"{self.path}/edges")
        return held.filter(F.col("type").isin(*types)) if types else held

    def node(self, node: str) -> DataFrame:
        return self.nodes().filter(F.col("id") == node)

    def children(self, parent: str) -> DataFrame:
        return self.nodes().filter(F.col("parent_id") == parent)

    def by_file(self, path: str) -> DataFrame:
        return self.nodes().filter(F.col("file_path") == path)

    def out_edges(self, node: str, *types: str) -> DataFrame:
        return self.edges(*types).filter(F.col("source_id") == node)

    def in_edges(self, node: str, *types: str) -> DataFrame:
        return self.edges(*types).filter(F.col("target_id") == node)

    def degrees(self, *types: str) -> DataFrame:
        """(id, fan_in, fan_out) of nodes that have an edge."""
        ends = self.edges(*types).select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("into")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("into")))).alias("e"))
        return ends.groupBy("e.id").agg(F.sum("e.into").alias("fan_in"), F.sum(1 - F.col("e.into")).alias("fan_out"))

    def within(self, focus: str, edges: DataFrame, depth: int = 2) -> DataFrame:
        """(id) of nodes that are at most ``depth`` edges away from one, in either direction: each step
        joins what it has just reached, so a node is followed once for each step at most."""
        ways = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("w")).select("w.*").distinct()
        near = self.spark.range(1).select(F.lit(focus).alias("id"))
        for _ in range(depth):
            near = near.unionByName(ways.join(near.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"))).distinct()
        return near

    def view(
        self, zoom: float = 1.0, node_types: list[str] | None = None, edge_types: list[str] | None = None, least_importance: float = 0.0, stdlib: bool = True, tests: bool = True, focus: str | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """The nodes, and the bundled edges (source_id, target_id, weight, types), that are shown.

        A zoom shows types from the outside in; node and edge types can be switched off; imports of the
        standard library and test nodes are told by ``is_stdlib`` and ``is_test`` in the metadata; edges
        below the least importance go.  With ``focus`` only what is within two steps of it over the
        edges that are left stays.  Edges need both of their ends shown, and parallel ones are one row.
        """
        zoomed = next((types for least, types in ZOOM if zoom < least), None)
        shown = [t for t in (zoomed or NODE_TYPES) if node_types is None or t in node_types]
        nodes = self.nodes(*shown) if shown else self.nodes().limit(0)
        nodes = nodes if tests else nodes.filter(~self._flag("is_test"))
        edges = self.edges(*(EDGE_TYPES if edge_types is None else edge_types or [""])).filter(F.col("importance") >= least_importance)
        edges = edges if stdlib else edges.filter(~((F.col("type") == "imports") & self._flag("is_stdlib")))
        ids = nodes.select("id")
        held = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        if focus is not None:
            near = self.within(focus, held)
            nodes = nodes.join(near, "id", "left_semi")
            held = held.join(near.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(near.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        bundles = held.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("weight"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))
        return nodes, bundles

    @staticmethod
    def _flag(name: str) -> Column:
        return F.coalesce(F.try_variant_get("metadata", f"$.{name}", "boolean"), F.lit(False))
