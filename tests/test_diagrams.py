import pytest
from codeloom.operators import clustering, diagrams, graph, messages, workspace
from pyspark.sql import functions as F

CALLS = "array<struct<id:string,name:string,arguments:string>>"


def plain_ids(nodes, groups):
    """Ids one after the other, as the rule says."""
    used, out = set(), []
    for _, id_ in sorted(nodes):
        new = f"nd_{id_}" if id_ in diagrams.RESERVED or id_ in groups else id_
        while new in used:
            new += "_dup"
        used.add(new)
        out.append(new)
    return out


@pytest.mark.parametrize(
    "ids",
    [
        ["a", "a_dup", "a", "a", "a_dup", "b"],
        ["a_dup_dup", "a", "a_dup", "a", "a", "a"],
        ["root", "nd_root", "root", "g", "nd_g", "g", "x\n", "x\n", "", ""],
        ["_dup", "", "_dup", "a_dup_", "a_dup_", "é", "é_dup", "é"],
    ],
)
def test_ids_are_unique_as_in_a_walk(spark, ids):
    nodes = spark.createDataFrame(list(enumerate(ids)), "n long, id string")
    groups = spark.createDataFrame([("g",), ("root",), ("g",)], "id string")
    renamed = diagrams.unique_nodes(nodes, groups)
    got = [r.new_id for r in renamed.orderBy("n").collect()]
    assert got == plain_ids(list(enumerate(ids)), {"g", "root"}) and len(set(got)) == len(ids)
    edges = spark.createDataFrame([(1, ids[0], "nowhere"), (2, ids[-1], ids[-1])], "e long, src string, dst string")
    last = dict(zip(ids, got))
    wired = {r.e: (r.src, r.dst) for r in diagrams.rewired(edges, renamed).collect()}
    assert wired == {1: (last[ids[0]], "nowhere"), 2: (last[ids[-1]],) * 2}


def test_groups(spark):
    nodes = spark.createDataFrame([("a", "g"), ("b", "a"), ("c", None), ("d", "gone"), ("e", "root")], "id string, group string")
    groups = spark.createDataFrame([("g",), ("a",), ("root",)], "id string")
    assert {r.id: r.group for r in diagrams.in_groups(nodes, groups).collect()} == {"a": "g", "b": "grp_a", "c": None, "d": None, "e": "grp_root"}


def test_sequence_rules(spark):
    actors = spark.createDataFrame([(f"a{i}",) for i in range(5)], "id string")
    sent = lambda orders, to="a1": spark.createDataFrame([(i, "a0", to) for i in orders], "order long, src string, dst string")
    rules = lambda a, m: {r.rule: r.n for r in diagrams.sequence_rules(a, m).collect()}
    assert rules(actors, sent(range(1, 13))) == {}
    assert rules(actors, sent([1, 1, *range(3, 13)])) == {"order": 2}
    assert rules(actors.filter("id < 'a2'"), sent(range(3), "x")) == {"actor-count": 1, "message-count": 1, "unknown-actor": 3}
    assert rules(actors.filter("false"), sent([])) == {"actor-count": 1, "message-count": 1}


def test_entity_rules(spark):
    entities = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "entity string, weak boolean")
    attributes = spark.createDataFrame([("a", n, n == "id") for n in ("id", "x", "y")] + [("b", n, False) for n in "xyz"] + [("c", "x", None)], "entity string, name string, is_key boolean")
    relations = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert {(r.entity, r.rule) for r in diagrams.entity_rules(entities, attributes, relations).collect()} == {("c", "no-relationship"), ("c", "few-attributes"), ("c", "no-key")}


def test_node_scores_and_reasons(spark):
    nodes = spark.createDataFrame([(1, 1.0, 0.5, None), (2, 0.0, 0.0, 1.0)], "node long, error_status double, caller_of_failing double, other double")
    got = {r.node: (round(r.score, 9), r.reasons) for r in graph.score_nodes(nodes, "failure_path").collect()}
    assert got == {1: (0.65, ["error_status (0.50)", "caller_of_failing (0.15)"]), 2: (0.0, [])}


def test_path_patterns(spark):
    cases = {
        "one": ["src/a.ts"],
        "folder": ["src/a/x.ts", "src/b/y.ts"],
        "both": ["src/a/x.ts", "src/a/x.ts"],
        "name": ["a/index.ts", "b/index.ts"],
        "name at the top": ["index.ts", "b/index.ts"],
        "none": ["a/x.ts", "b/y.ts"],
        "deep": ["a/b/c/x", "a/b/d", "a/b/c/y"],
        "absolute": ["/a/x", "/b/y"],
    }
    want = {"one": None, "folder": "src/*", "both": "src/a/x.ts", "name": "*/index.ts", "name at the top": "*/index.ts", "none": None, "deep": "a/b/*", "absolute": "/*"}
    files = spark.createDataFrame([(k, p) for k, v in cases.items() for p in v], "label string, path string")
    assert {r.label: r.pattern for r in clustering.path_patterns(files).collect()} == want
    assert {k: clustering.path_pattern(v) for k, v in cases.items()} == want


def test_cluster_labels():
    pair = [([("src/a.ts", "Reads")], "src/*"), ([("b.ts", "")], None)]
    asked = []
    assert clustering.label_siblings(pair, lambda prompt: asked.append(prompt) or 'Sure: [{"label": "File Reading"}, {"label": ""}]') == ["File Reading (src/*)", "Cluster 2"]
    assert "src/a.ts: Reads" in asked[0] and "b.ts: no description" in asked[0]
    assert clustering.label_siblings(pair, lambda prompt: "no list") == ["Cluster 1", "Cluster 2"]
    assert clustering.label_siblings(pair, lambda prompt: "[broken") == ["Cluster 1", "Cluster 2"]
    assert clustering.label_siblings(pair, lambda prompt: "[broken]") == ["src/*", "Cluster 2"]
    assert clustering.label_siblings(pair[1:], None) == ["b.ts"]


@pytest.fixture
def talk(spark):
    rows = [
        ("c", 1, "system", "be brief", None, None, None),
        ("c", 2, "user", "where?", None, None, None),
        ("c", 3, "assistant", None, [("t1", "find", "{}"), ("t2", "read", '{"x":1}')], None, None),
        ("c", 4, "tool", "here", None, "t1", "find"),
        ("c", 5, "tool", None, None, "t2", None),
        ("c", 6, "assistant", "", None, None, None),
        ("c", 7, "tool", "late", None, "t3", None),
        ("c", 8, "assistant", "there", None, None, None),
        ("c", 9, "odd", "x", None, None, None),
    ]
    return spark.createDataFrame(rows, f"conv_id string, turn long, role string, content string, tool_calls {CALLS}, tool_call_id string, name string")


def test_turns_with_tools(talk):
    got = [(r.role, r.first_turn, [(b.kind, b.id, b.body) for b in r.blocks]) for r in messages.provider_turns(talk).orderBy("first_turn").collect()]
    assert got == [
        ("system", 1, [("text", None, "be brief")]),
        ("user", 2, [("text", None, "where?")]),
        ("assistant", 3, [("tool_use", "t1", "{}"), ("tool_use", "t2", '{"x":1}')]),
        ("user", 4, [("tool_result", "t1", "here"), ("tool_result", "t2", "")]),
        ("user", 7, [("tool_result", "t3", "late")]),
        ("assistant", 8, [("text", None, "there")]),
    ]


def test_turns_without_tools(talk):
    got = [(r.role, r.n, r.text) for r in messages.plain_turns(talk, 3).orderBy("island").collect()]
    assert got == [
        ("user", 1, "where?"),
        ("assistant", 1, '[Called tool find({})]\n[Called tool read({"x":1})]'),
        ("user", 3, "[Tool find result]: her\n[Tool t2 result]: \n[Tool t3 result]: lat"),
        ("assistant", 1, "there"),
    ]


def test_workspace(spark):
    repos = spark.createDataFrame([("r1", False, None, None), ("r2", False, None, None)], "id string, ready boolean, symbol_count long, scanned_at timestamp")
    kept = spark.createDataFrame([("d1", "r1", "x", None), ("d2", "r2", "y", None), ("d3", None, "z", None)], "id string, repo_id string, name string, edited_at timestamp")
    now = F.timestamp_seconds(F.lit(1))
    ready = {r.id: r for r in workspace.marked_ready(repos, "r2", now, 7).collect()}
    assert (ready["r2"].ready, ready["r2"].symbol_count, ready["r1"].ready) == (True, 7, False) and ready["r2"].scanned_at
    named = {r.id: r for r in workspace.renamed(kept, "d2", "new", now).collect()}
    assert named["d2"].name == "new" and named["d2"].edited_at and named["d1"].edited_at is None
    assert {r.id for r in workspace.touched(kept, "none", now).filter("edited_at is not null").collect()} == set()
    left, drawn = workspace.without_repos(repos, kept, repos.filter("id = 'r1'"))
    assert {r.id for r in left.collect()} == {"r2"} and {r.id for r in drawn.collect()} == {"d2", "d3"}


def test_edges_of_many_equal_ids_carry_numbers_until_the_end(spark):
    """The endings of 20,000 equal ids, written out one by one, are 800 MB."""
    nodes = spark.range(20_000).select(F.col("id").alias("n"), F.lit("a").alias("id"))
    none = spark.createDataFrame([], "id string")
    renamed = diagrams.numbered_nodes(nodes, none)
    assert "new_id" not in renamed.columns and renamed.agg(F.sum("dups")).first()[0] == 19_999 * 10_000
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    got = {(r.src[:5], len(r.src), r.dst[:5], len(r.dst)) for r in diagrams.rewired(edges, renamed).collect()}
    assert got == {("a_dup", 79_997, "b", 1), ("b", 1, "a_dup", 79_997)}


def test_long_ids_are_written_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(diagrams, "WRITTEN_OUT", 1 << 20, raising=False)
    nodes = spark.range(4000).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("id"))
    renamed = diagrams.numbered_nodes(nodes, spark.createDataFrame([], "id string"))
    edges = spark.range(2000).select(F.col("id").alias("e"), F.when(F.col("id") % 5 < 3, "a").otherwise("b").alias("src"), F.when(F.col("id") % 7 > 0, "c").alias("dst"))
    out = diagrams.rewired(edges, renamed).withColumn("p", F.spark_partition_id())
    got = out.select("e", F.substring("src", 1, 5).alias("src"), F.length("src").alias("n"), "dst", "p").collect()
    assert sorted((r.e, r.src, r.n, r.dst) for r in got) == [(e, "a_dup" if e % 5 < 3 else "b_dup", 7997, "c" if e % 7 else None) for e in range(2000)]
    tasks = {}
    for r in got:
        tasks.setdefault(r.p, []).append(r.src)
    assert max(len(held) * 7997 for held in tasks.values()) < 2 << 20
    assert sum(len(set(held)) for held in tasks.values()) <= len(tasks) + 1
