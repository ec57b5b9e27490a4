import json

import pytest
from codeloom.operators.store import EDGE_TYPES, NODE_TYPES, GraphStore
from pyspark.sql import functions as F

NODES = [
    ("s1", "service", "api", None, None, {}), ("s2", "service", "jobs", None, None, {}), ("p1", "package", "core", "s1", None, {}), ("f1", "file", "a.go", "p1", "core/a.go", {"checksum": "x", "size_bytes": 12}),
    ("f2", "file", "a_test.go", "p1", "core/a_test.go", {"is_test": True}), ("fn1", "function", "Run", "f1", "core/a.go", {"parameters": ["ctx"]}), ("fn2", "function", "Stop", "f1", "core/a.go", {}), ("fn3", "function", "Lone", "f2", "core/a_test.go", {}),
]
EDGES = [
    ("e1", "contains", "s1", "p1", None, {}), ("e2", "contains", "p1", "f1", 0.9, {}), ("e3", "contains", "f1", "fn1", 0.5, {}), ("e4", "calls", "fn1", "fn2", 0.2, {}), ("e5", "calls", "fn1", "fn2", 0.3, {}),
    ("e6", "imports", "f1", "p1", 0.8, {"is_stdlib": True}), ("e7", "contains", "p1", "f2", 0.4, {}), ("e8", "embeds", "fn1", "fn2", 0.7, {}), ("e9", "calls", "fn1", "gone", 1.0, {}), ("e10", "contains", "f2", "fn3", 1.0, {}),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    nodes = spark.createDataFrame([(i, n, p, f, 1, 9, json.dumps(m), t) for i, t, n, p, f, m in NODES] + [(None, "x", None, None, 1, 1, "{}", "file"), ("odd", "x", None, None, 1, 1, "no json", "planet")], "id string, name string, parent_id string, file_path string, line_start int, line_end int, metadata string, type string")
    edges = spark.createDataFrame([(i, s, d, w, json.dumps(m), t) for i, t, s, d, w, m in EDGES], "id string, source_id string, target_id string, importance double, metadata string, type string")
    made = GraphStore(spark, str(tmp_path_factory.mktemp("store")))
    made.write(nodes, edges)
    return made


def ids(rows):
    return sorted(r.id for r in rows.collect())


def scan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_getters(store):
    assert ids(store.nodes()) == sorted(n[0] for n in NODES)
    assert ids(store.node("f1")) == ["f1"] and ids(store.node("none")) == []
    assert ids(store.children("f1")) == ["fn1", "fn2"]
    assert ids(store.nodes("service", "package")) == ["p1", "s1", "s2"]
    assert ids(store.by_file("core/a.go")) == ["f1", "fn1", "fn2"]
    assert ids(store.out_edges("fn1", "calls")) == ["e4", "e5", "e9"] and ids(store.in_edges("p1")) == ["e1", "e6"]
    assert {r.id: (r.fan_in, r.fan_out) for r in store.degrees("calls").collect()} == {"fn1": (0, 3), "fn2": (2, 0), "gone": (1, 0)}


def test_metadata_is_read_by_path(store):
    row = store.node("f1").select(F.variant_get("metadata", "$.size_bytes", "int").alias("size"), F.variant_get("metadata", "$.checksum", "string").alias("sum")).first()
    assert (row["size"], row["sum"]) == (12, "x")
    assert store.node("fn1").select(F.variant_get("metadata", "$.parameters[0]", "string")).first()[0] == "ctx"


def test_filters_reach_the_scan(store):
    plan = scan(store.nodes("file").filter("file_path = 'core/a.go'"))
    assert "PartitionFilters: [isnotnull(type" in plan and "EqualTo(file_path,core/a.go)" in plan
    assert "EqualTo(id,f1)" in scan(store.node("f1"))
    assert "GreaterThanOrEqual(importance,0.5)" in scan(store.view(least_importance=0.5)[1])
    assert "EqualTo(source_id,fn1)" in scan(store.out_edges("fn1"))


@pytest.mark.parametrize("zoom, shown", [(0.1, ["s1", "s2"]), (0.4, ["p1", "s1", "s2"]), (0.99, ["f1", "f2", "p1", "s1", "s2"]), (1.0, sorted(n[0] for n in NODES))])
def test_zoom(store, zoom, shown):
    assert ids(store.view(zoom)[0]) == shown


def test_switches_and_bundles(store):
    nodes, edges = store.view()
    bundles = {(r.source_id, r.target_id): (r.weight, r.types) for r in edges.collect()}
    assert bundles["fn1", "fn2"] == (3, "calls,embeds") and ("fn1", "gone") not in bundles
    nodes, edges = store.view(tests=False, stdlib=False, least_importance=0.5, edge_types=["contains", "imports", "embeds"])
    assert ids(nodes) == ["f1", "fn1", "fn2", "fn3", "p1", "s1", "s2"]
    assert {(r.source_id, r.target_id) for r in edges.collect()} == {("s1", "p1"), ("p1", "f1"), ("f1", "fn1"), ("fn1", "fn2")}
    assert ids(store.view(node_types=["function"])[0]) == ["fn1", "fn2", "fn3"]
    assert ids(store.view(0.1, node_types=["function"])[0]) == [] and store.view(edge_types=[])[1].count() == 0


def test_focus_keeps_two_steps(store):
    nodes, edges = store.view(focus="s1")
    assert ids(nodes) == ["f1", "f2", "p1", "s1"]
    assert {(r.source_id, r.target_id) for r in edges.collect()} == {("s1", "p1"), ("p1", "f1"), ("f1", "p1"), ("p1", "f2")}
    assert ids(store.view(focus="s2")[0]) == ["s2"] and ids(store.view(focus="never")[0]) == []


def test_fixed_types():
    assert len(NODE_TYPES) == 10 and len(EDGE_TYPES) == 12
