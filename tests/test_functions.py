import random

import pytest
from codeloom.functions import text as T
from codeloom.functions import vectors as V
from codeloom.operators import code, graph
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,files,identifiers",
    [
        ("parseHTTPRequest_fooBar", ["parse", "http", "request", "foo", "bar"], ["parse", "http", "request_foo", "bar"]),
        ("src/auth.ts", ["src/auth.ts"], ["src", "auth", "ts"]),
        ("f(x) Éfoo", ["f(x)", "éfoo"], ["foo"]),
        ("", [], []),
    ],
)
def test_tokenisers(spark, text, files, identifiers):
    assert one(spark, T.file_terms(F.col("c0")), text) == files
    assert one(spark, T.identifier_terms(F.col("c0")), text) == identifiers


def test_links(spark):
    assert [x.target for x in one(spark, T.wiki_links(F.col("c0")), "see [[lib/pump.rs]], [[ tank.go | Holds it ]] @linked-to [[valves]]")] == ["lib/pump.rs", "tank.go"]
    assert [x.description for x in one(spark, T.wiki_links(F.col("c0")), "[[pump.rs]] [[tank.go|Holds it]]")] == [None, "Holds it"]
    assert one(spark, T.cross_links(F.col("c0")), "@linked-to [[valves]]\n@linked-to [[meters]] [[tank.go]]") == ["valves", "meters"]


def test_calls_start_at_a_word_boundary(spark):
    assert one(spark, T.calls_of(F.col("c0")), "a$b(1) $pump(2) $(3) é$fill(4) 1$x(5)") == ["a$b", "pump", "fill", "$x"]


@pytest.mark.parametrize("text,want", [("// Reads meters\n// FEATURE: Water Metering", "Water Metering"), ("# Fills\n# FEATURE: Tank Levels", "Tank Levels"), ("none", None)])
def test_feature_tags(spark, text, want):
    assert one(spark, T.feature_tag(F.col("c0")), text) == want


def test_headers(spark):
    assert one(spark, T.code_header(F.col("c0")), "// Header line 1\n// Header line 2\n\nfunction f() {}") == "Header line 1 | Header line 2"
    assert one(spark, T.code_header(F.col("c0")), "#!/bin/sh\nimport x\nuse y\nz = 1") == "z = 1"
    assert one(spark, T.plain_header(F.col("c0")), "\n  a \n\nb\nc") == "a | b"
    assert one(spark, T.navigator_header(F.col("c0")), "// a\n\n# b\ncode\n// c") == "a b"


def test_boundaries_are_ascii(spark):
    assert one(spark, F.col("c0").rlike(T.whole_word("foo")), "éfoo bar")
    assert not one(spark, F.col("c0").rlike(T.whole_word("foo")), "xfoo bar")


def test_calls_of_a_line(spark):
    assert one(spark, T.calls_of(F.col("c0")), "if (a(b (c))) return <Foo x={d()}/> new Map()") == ["a", "b", "d", "Foo"]


@pytest.mark.parametrize("name,want", [("db", True), ("Prisma", True), ("findOne", True), ("finder", False)])
def test_db_names(spark, name, want):
    assert one(spark, T.is_db_name(F.col("c0")), name) is want


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.x, 6) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.96, 0.0]


def paths_of(edges, root, most):
    out = []

    def go(path, cycle):
        out.append((tuple(path), len(path) - 1, cycle))
        if not cycle and len(path) - 1 < most:
            for d in sorted(edges.get(path[-1], ())):
                if d != path[-1]:
                    go([*path, d], d in path)

    go([root], False)
    return sorted(out)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_call_paths_against_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = {n: {rng.randrange(8) for _ in range(rng.randrange(3))} for n in range(8)}
    df = spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs] or [(50, 51)], "src long, dst long")
    found = graph.call_paths(df, 0, 4)
    assert sorted((tuple(r.path), r.depth, r.is_cycle) for r in found.collect()) == paths_of(edges, 0, 4)
    seen = {}
    for path, depth, _ in paths_of(edges, 0, 4):
        if all(path[:k] == seen.get(path[k - 1], (None,))[0] for k in range(1, len(path))):
            seen.setdefault(path[-1], (path, depth))
    assert {r.node: r.depth for r in graph.flatten_truncated(found).collect()} == {n: d for n, (_, d) in seen.items()}


def test_reach_and_dangling(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 9), (3, 3)], "src long, dst long")
    assert {r.node: r.depth for r in graph.reach(edges, 0, 2).collect()} == {0: 0, 1: 1, 2: 1, 9: 2}
    nodes = spark.createDataFrame([(0,), (1,), (2,), (3,)], "node long")
    assert [(r.src, r.dst) for r in graph.dangling(edges, nodes).collect()] == [(2, 9)]
    assert {r.node for r in graph.entry_points(nodes, edges).collect()} == {0}


def test_indent_parents(spark):
    rows = [("f", i, x) for i, x in enumerate(["a", "  b", "    c", "  d", "e", "            f", "    g"], 1)]
    got = {r.line: r.parent_line for r in code.indent_parents(spark.createDataFrame(rows, "file string, line long, text string")).collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 1, 5: None, 6: 5, 7: 5}
