import time

import numpy as np
import pytest
from codeloom.engine import Engine
from codeloom.operators import clustering, code, diagrams, graph, hubs, messages, search
from codeloom.operators.providers import Agent, TooLong, embed
from codeloom.operators.symbols import Blocks, symbols_of
from codeloom.sources import config
from codeloom.sources.repo import IgnoreRules, walk
from codeloom.streaming import tracker


@pytest.fixture
def tree(tmp_path):
    files = {
        "src/util.ts": "// Util helpers\n// FEATURE: Util\nexport function helper(x) {\n  return inner(x);\n}\nfunction inner(y) {\n  return y;\n}\n",
        "src/main.ts": "// Entry\n// FEATURE: Main\nimport { helper } from './util';\nfunction start() {\n  helper(1);\n}\n",
        "src/dog.py": "# Dogs\n# FEATURE: Dogs\n\nclass Dog:\n    def bark(self):\n        pass\n    def fetch(self):\n        pass\n",
        "docs/auth.md": "# Authentication\n[[src/util.ts|Helps]] [[src/missing.ts]] [[src/util.ts]] @linked-to [[payments]]\n",
        "node_modules/pkg/index.js": "x",
        "out/skip.log": "x",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (tmp_path / ".gitignore").write_text("*.log\n")
    return tmp_path


def test_walk(tree):
    found = {r: (d, depth) for _, r, d, depth in walk(str(tree))}
    assert "src/util.ts" in found and found["src"] == (True, 0)
    assert not any("node_modules" in r or r.endswith(".log") for r in found)
    assert {r for _, r, _, _ in walk(str(tree), "src")} == {"src/util.ts", "src/main.ts", "src/dog.py"}
    assert list(walk(str(tree), "nonexistent")) == []
    assert all(depth <= 0 for _, _, _, depth in walk(str(tree), "", 0) if depth < 1)


@pytest.mark.parametrize("rule,path,out", [("docs/", "docs/a.md", True), ("docs/", "docs", False), ("*.log", "a/b.log", True), ("/a.txt", "b/a.txt", False), ("a/**/b", "a/x/y/b", True), ("*.c\n!keep.c", "keep.c", False)])
def test_ignore_rules(rule, path, out):
    assert IgnoreRules(rule).ignores(path) is out


def found_in(path, text):
    return [(n, k, a, b, p) for _, n, k, a, b, _, p in symbols_of(path, text)]


def test_symbols():
    ledger = "export class Ledger {\n  post(entry: Entry): void {\n    this.rows.push(entry)\n  }\n  if (x) {\n  }\n}\nexport const LIMIT = 5\ntype Row = {\n  a: number\n}\n"
    assert found_in("a.ts", ledger) == [("Ledger", "class", 1, 7, None), ("post", "method", 2, 4, "Ledger"), ("LIMIT", "const", 8, 8, None), ("Row", "type", 9, 9, None)]
    assert found_in("a.ts", "async function drain<T>(queue: T[]) {\n}\n") == [("drain", "function", 1, 2, None)]
    tank = "class Tank:\n    def fill(self):\n        x = 1\n\n    def empty(self):\n        pass\nasync def pump(a):\n    return a\n"
    assert found_in("a.py", tank) == [("Tank", "class", 1, 6, None), ("fill", "method", 2, 4, "Tank"), ("empty", "method", 5, 6, "Tank"), ("pump", "function", 7, 9, None)]
    rust = "pub(crate) fn mix(a: u8) -> u8 {\n a\n}\nimpl<T> Bowl {\n}\npub trait Pour {\n}"
    assert [x[:2] for x in found_in("a.rs", rust)] == [("mix", "function"), ("Bowl", "class"), ("Pour", "trait")]
    assert [x[:2] for x in found_in("a.go", "func (b *Bowl) Pour(n int) error {\n}\ntype Bowl struct {\n}\ntype Pourer interface {\n}")] == [("Pour", "function"), ("Bowl", "struct"), ("Pourer", "interface")]
    assert symbols_of("a.ts", "") == []


def test_word_characters_are_ascii_but_space_is_any():
    assert found_in("a.py", "def naïve(x):\n    pass\n") == []
    assert found_in("a.py", "def\u00a0plain(x):\n    pass\n")[0][0] == "plain"


def test_where_methods_come_first_a_class_with_arguments_is_none():
    kotlin = "class P(val x: Int) {\n}\nclass Q {\n  fun area(): Int {\n  }\n  return later(1)\n}\n"
    assert found_in("a.kt", kotlin) == [("Q", "class", 3, 7, None), ("area", "method", 4, 5, "Q"), ("later", "method", 6, 6, "Q")]


def test_other_languages_know_three_kinds():
    text = "struct P {\n}\npublic static func f() {\n}\npub fn g() {\n}\ntrait T {\n}\n"
    assert [x[:2] for x in found_in("a.zig", text)] == [("P", "class"), ("g", "function"), ("T", "enum")]


@pytest.mark.parametrize(
    "rule,path,out",
    [("log[0-9].txt", "log5.txt", True), ("log[0-9].txt", "logx.txt", False), ("log[!0-9].txt", "logx.txt", True), ("a[/]b", "a/b", False), (r"\!keep", "!keep", True), (r"\#x", "#x", True), ("!!a", "!a", False), (r"a\*b", "a*b", True), (r"a\*b", "axb", False)],
)
def test_ignore_classes_and_escapes(rule, path, out):
    assert IgnoreRules(rule).ignores(path) is out


def rules_of(spark, **files):
    rows = [(name.replace("_", "."), i, x) for name, text in files.items() for i, x in enumerate(text.split("\n"), 1)]
    return {(r.file, r.rule, r.n) for r in code.violations(spark.createDataFrame(rows, "file string, line long, text string")).collect()}


def test_rules_go_by_the_language(spark):
    good, comments = "# reads meters\n# FEATURE: metering\nimport os\n", "# a\n# feature: b\n#!x\n  #include y\n  # left\nz\n# right"
    assert rules_of(spark, m_py=good, n_ts=good.replace("#", "//"), o_lua=good.replace("#", "--"), p_txt="free text") == set()
    assert rules_of(spark, m_py=comments) == {("m.py", "no-comments", 2)}
    assert rules_of(spark, m_py="# one\nx = 1") == {("m.py", "header", 1)}
    assert rules_of(spark, m_rb="# one\n# two\nx") == {("m.rb", "feature-tag", 1)}
    assert rules_of(spark, m_ts="# one\n# two\nx") == {("m.ts", "header", 1)}


def test_search_options():
    assert config.search_options()["k"] == 5 and config.search_options(0.2)["k"] == 1 and config.search_options(7.9)["k"] == 7
    got = config.search_options(float("nan"), semantic_weight=-1, keyword_weight=0.5, least=30, least_keyword=2)
    assert (got["k"], got["semantic_weight"], got["keyword_weight"], got["least"], got["least_keyword"]) == (5, 0.72, 0.5, 0.3, 0.02)


def test_scores_rank_before_they_are_rounded(spark):
    rows = [(1, "", "", [1.0, 0.0203]), (2, "", "", [1.0, 0.0201]), (3, "pump", "", [0.0, 1.0]), (4, "", "", [-1.0, 0.0])]
    docs = spark.createDataFrame(rows, "id long, text string, symbols string, v array<double>")
    query = search.query_vector([1.0, 0.0])
    assert [r.id for r in search.hybrid_search(docs, "pump", query, 2).collect()] == [2, 1]
    assert {r.id for r in search.hybrid_search(docs, "pump", query, 9, least=0.0).collect()} == {1, 2, 3, 4}
    assert {r.id for r in search.hybrid_search(docs, "pump", query, 9, least=0.0, require_keyword=True).collect()} == {3}
    assert {r.id for r in search.hybrid_search(docs, "pump", query, 9, least=0.0, require_semantic=True).collect()} == {1, 2}


def test_call_sites_in_their_second_phase(spark):
    rows = [("f", "a.ts", 1, 1.0, None), ("f", "a.ts", 2, 0.0, [1.0, 0.0]), ("f", "b.ts", 3, 0.5, [0.0, 1.0]), ("g", "b.ts", 4, 0.0, [-1.0, 0.0])]
    sites = spark.createDataFrame(rows, "name string, file string, line long, key double, v array<double>")
    got = [(r.name, r["rank"], r.line, r.score) for r in search.rank_call_sites(sites, search.query_vector([1.0, 0.0]), 2).orderBy("name", "rank").collect()]
    assert got == [("f", 1, 2, 82.0), ("f", 2, 1, 18.0), ("g", 1, 4, 0.0)]


def test_descendants_and_reach(spark):
    tree = spark.createDataFrame([(i, None if i % 7 == 0 else i - 1) for i in range(30)], "node long, parent long")
    got = {(r.root, r.node, r.steps) for r in graph.descendants(tree).collect()}
    assert got == {(i - i % 7, i, i % 7) for i in range(30)}
    edges = spark.createDataFrame([(i, (i * 3 + 1) % 20) for i in range(20)] + [(i, (i + 5) % 20) for i in range(20)], "src long, dst long")
    want, front = {0: 0}, [0]
    for depth in range(1, 5):
        front = [d for n in front for d in ((n * 3 + 1) % 20, (n + 5) % 20)]
        for n in front:
            want.setdefault(n, depth)
    assert {r.node: r.depth for r in graph.reach(edges, 0, 4).collect()} == want


def test_roles_merge_over_nulls(spark):
    rows = [(1, 1, None, "a"), (1, 2, None, "b"), (1, 3, "user", "c"), (1, 4, None, "d"), (2, 1, "user", "e")]
    got = messages.merge_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.conv_id, r.island, r.role or "", r.n, r.text) for r in got.collect()) == [(1, 1, "", 2, "a\nb"), (1, 2, "user", 1, "c"), (1, 3, "", 1, "d"), (2, 1, "user", 1, "e")]


def test_engine(spark, tree):
    engine = Engine(spark, str(tree))
    used = {(r.file, r.line) for r in engine.blast_radius("helper").collect()}
    assert used == {("src/util.ts", 3), ("src/main.ts", 3), ("src/main.ts", 5)}
    assert ("src/util.ts", 3) not in {(r.file, r.line) for r in engine.blast_radius("helper", "src/util.ts").collect()}
    assert [(r.name, r.depth) for r in engine.call_chain("start").collect()] == [("start", 0), ("helper", 1), ("inner", 2)]
    text = engine.context_tree_text()
    assert text.startswith("./\n") and "function: export function helper(x)" in text
    assert engine.context_tree_text(max_tokens=5).startswith("[Level 0: File names only, project too large for 5 tokens]\n\n./\n  docs/\n")
    assert "[method] L5-L6 def bark(self);" in engine.file_skeleton_text("src/dog.py")
    assert engine.file_skeleton_text("docs/auth.md").startswith("[Unsupported language, showing first 20 lines]")
    assert engine.semantic_code_search("util helper", 2).first().id == "src/util.ts"
    shown = engine.semantic_code_search_text("util helper", 1)
    assert shown.startswith('Top 1 hybrid matches for: "util helper"\n\n1. src/util.ts (') and "Matched symbols: helper" in shown and "Definition lines: helper@L" in shown
    assert engine.semantic_code_search_text("zzz", 1, least=1.0) == "No matching files found for the given query."
    assert engine.semantic_identifier_search("bark", 1).first().name == "bark"
    assert engine.semantic_navigate().count() == 4
    assert [r.relative_path for r in engine.orphans().collect()] == ["src/dog.py", "src/main.ts"]
    links = hubs.resolved(hubs.hub_links(engine.feature_hubs()), engine.files).collect()
    assert sorted((r.target, r.found, r.description) for r in links) == [("src/missing.ts", False, None), ("src/util.ts", True, "Helps")]
    assert hubs.cross_links(engine.feature_hubs()).first().hub_name == "payments"
    assert hubs.find_hub(engine.feature_hubs(), "auth").first().title == "Authentication"
    assert engine.static_analysis("src/dog.py")[0] == 0


def test_commit_and_restore(spark, tree):
    engine = Engine(spark, str(tree))
    before = (tree / "src/main.ts").read_text()
    bad = engine.propose_commit("src/main.ts", "// a\n// FEATURE: b\n" + "// more\n" * 10)
    assert bad.filter("rejects").count() == 1 and (tree / "src/main.ts").read_text() == before
    engine.propose_commit("src/main.ts", "// a\n// FEATURE: b\nlet x = 1;\n")
    point = engine.list_restore_points().first().id
    assert point.startswith("rp-") and engine.undo_change(point) == ["src/main.ts"]
    assert (tree / "src/main.ts").read_text() == before
    with pytest.raises(KeyError):
        engine.undo_change("rp-0-none")
    with pytest.raises(ValueError):
        engine.propose_commit("../outside.ts", "x")


@pytest.mark.parametrize("n,most", [(1, 20), (3, 20), (50, 5), (30, 10)])
def test_clusters_partition_the_rows(n, most):
    data = np.array([[np.cos(i / 2), np.sin(i / 2), i / n] for i in range(n)])
    labels = clustering.spectral_labels(data, most)
    assert len(labels) == n and 1 <= len(set(labels)) <= max(most, 1)


def test_embedding_in_batches_that_shrink():
    def provider(texts):
        if len(texts) > 1 or len(texts[0]) > 400:
            raise TooLong
        return [[float(len(texts[0]))]]

    assert embed(["oak", "elder", "yew"], provider) == [[3.0], [5.0], [3.0]]
    assert embed(["pine " * 500], provider)[0][0] <= 400


def test_agent():
    replies = iter([{"tool_calls": [{"id": "1", "name": "echo", "arguments": {"x": "hi"}}, {"id": "2", "name": "none"}]}, {"content": "done"}])
    agent = Agent(lambda messages, tools: next(replies), {"echo": lambda x: x * 10000})
    assert agent.ask("?") == "done"
    assert [len(m["content"]) for m in agent.messages if m["role"] == "tool"] == [12000, 18]
    forced = Agent(lambda messages, tools: {"tool_calls": [{"id": "1", "name": "t"}]} if tools else {"content": "end"}, {"t": lambda: "x"})
    assert forced.ask("?") == "end"


def test_tracker_follows_edits_in_place(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("vectors")
    check = tmp_path_factory.mktemp("check")

    def run():
        tracker.track(spark, str(tree), str(out), str(check), trigger={"availableNow": True}).awaitTermination(60)
        last = max(int(p.name[2:]) for p in out.iterdir() if p.name.startswith("v="))
        return {r.key: r.hash for r in tracker.read_vectors(spark, str(out), last).collect()}

    first = run()
    assert set(first) == {"src/util.ts", "src/main.ts", "src/dog.py", "docs/auth.md"}
    (tree / "src/util.ts").write_text("changed")
    (tree / "src/dog.py").unlink()
    second = run()
    assert set(second) == set(first) - {"src/dog.py"} and second["src/util.ts"] != first["src/util.ts"]


def test_progress_and_status(spark):
    events = spark.createDataFrame([(1, "tool_start", "a"), (2, "tool_start", "a"), (3, "tool_done", "a"), (4, "tool_start", "a"), (5, "tool_error", "b")], "seq long, event string, tool string")
    assert [(r.seq, r.status) for r in tracker.progress(events).orderBy("seq").collect()] == [(1, "done"), (2, "done"), (4, "running")]


def test_diagram_rules(spark):
    nodes = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "x")], "node string, group string")
    edges = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    groups = spark.createDataFrame([("g",)], "id string")
    assert {r.rule: r.n for r in diagrams.integrity(nodes, edges, groups).collect()} == {"dangling": 1, "isolated": 1, "ungrouped": 1, "node-count": 1, "group-count": 1}
    raw = spark.createDataFrame([(' ```json\n{"a": [1, [2]]}\n``` ',)], "t string")
    r = raw.select(diagrams.without_fence(raw.t).alias("x"), diagrams.json_array_in(raw.t).alias("y")).first()
    assert r.x == '{"a": [1, [2]]}' and r.y == "[1, [2]]"


def test_vectors_see_all_of_a_long_code_file(spark, tmp_path):
    (tmp_path / "long.py").write_text("# header\n" + "x = 1\n" * 1000 + "def zebra_crossing(stripes):\n    return stripes\n")
    (tmp_path / "notes.md").write_text("word " * 1000 + "zebra_crossing")

    def provider(texts):
        (tmp_path / "seen.txt").open("a").write("".join(t.replace("\n", " ") + "\n" for t in texts))
        return [[1.0, 0.0] for _ in texts]

    engine = Engine(spark, str(tmp_path), provider)
    engine._vectors.count()
    lines = {x.split()[0]: x for x in (tmp_path / "seen.txt").read_text().splitlines()}
    # what is embedded starts with the header, and has no path
    assert "zebra_crossing(stripes)" in lines["header"] and lines["header"].count("x = 1") < 3
    assert "zebra_crossing" not in lines["word"]


def test_views(spark, tree):
    engine = Engine(spark, str(tree))
    names = engine.register_views("tree_")
    assert len(names) == 7
    for name in names:
        spark.sql(f"SELECT count(*) FROM {name}").collect()
    assert spark.sql("SELECT count(*) AS n FROM tree_lines WHERE text LIKE '%helper%'").first().n >= 3


def test_identifier_search_with_call_sites(spark, tree):
    engine = Engine(spark, str(tree))
    found = engine.semantic_identifier_search("helper", 2).collect()
    assert found[0].name == "helper" and found[0].file == "src/util.ts" and found[0].line == 3 and [r.rank for r in found] == [1, 2]
    sites = [(r.file, r.line, r.context, r.total) for r in engine.identifier_calls("helper", 1).collect()]
    assert sites == [("src/main.ts", 5, "helper(1);", 1)]
    text = engine.identifier_search_text("helper", 1)
    assert "1. function helper - src/util.ts (L3-L5)" in text and "Calls (1/1):" in text and "src/main.ts:L5" in text
    assert engine.identifier_search_text("helper", 1, ["none"]) == "No identifiers matched."
    assert "Calls: none found" in engine.identifier_search_text("bark", 1)


def test_call_sites_by_kind_and_place(spark):
    texts = ["run (1)", "x.run", "function run() {", "const runner = 1", "rerun(2) + run2(3)", "Box<T>", "new Box()", "class Box {", "$go(1)", "a$go(1)"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts, 1)], "file string, line long, text string")
    symbols = spark.createDataFrame([("r", "run", "function", "f", 3), ("b", "Box", "class", "f", 8), ("here", "run", "method", "f", 1), ("g", "$go", "function", "f", 99), ("s", "$", "function", "f", 99)], "id string, name string, kind string, file string, line long")
    found = search.identifier_calls(lines, symbols, "run", search.query_vector([1.0]), 5, lambda texts: [[1.0]] * len(texts)).collect()
    assert {(r.id, r.line) for r in found} == {("r", 1), ("b", 6), ("b", 7), ("g", 10)}
    assert {r.score for r in found if r.id == "r"} == {100.0} and {r.score for r in found if r.id == "b"} == {82.0}
    many = spark.createDataFrame([("f", i, "run(1)") for i in range(200)], "file string, line long, text string")
    one = search.identifier_calls(many, symbols.filter("id = 'r'"), "run", search.query_vector([1.0]), 3, lambda texts: [[1.0]] * len(texts)).collect()
    assert sorted((r.rank, r.line) for r in one) == [(1, 0), (2, 1), (3, 2)] and {r.total for r in one} == {199}


def test_call_sites_of_one_name_are_found_once_for_all_its_symbols(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(search, "written", lambda df, name: kept.append(df) or df)
    places = [(f"f{i % 3}", i) for i in range(90)]
    lines = spark.createDataFrame([(f, i, "run(1)" if i % 2 else "function run() {") for f, i in places], "file string, line long, text string")
    symbols = spark.createDataFrame([(f"{f}:{i}", "run", "function", f, i) for f, i in places], "id string, name string, kind string, file string, line long")
    found = search.identifier_calls(lines, symbols, "x", search.query_vector([1.0]), 2, lambda texts: [[0.0]] * len(texts)).collect()
    assert kept[0].count() == 45  # and not 45 for each symbol
    sites = sorted(p for p in places if p[1] % 2)
    want = {(f"{f}:{i}", n + 1, *p, 45 - i % 2) for f, i in places for n, p in enumerate([s for s in sites if s != (f, i)][:2])}
    assert {(r.id, r.rank, r.file, r.line, r.total) for r in found} == want and len(found) == 180


def test_blocks_of_many_open_braces_take_one_pass():
    blocks = Blocks(["function f() {"] * 100_000 + ["}"] * 3)
    start = time.monotonic()
    assert [blocks.braces(i) for i in range(100_000)][-4:] == [99_997, 100_003, 100_002, 100_001]
    assert time.monotonic() - start < 20  # pass by pass it is 5e9 lines


def test_hub_text(spark, tree):
    engine = Engine(spark, str(tree))
    assert "docs/auth.md | Authentication | 2 links" in engine.feature_hub_text()
    shown = engine.feature_hub_text(name="auth")
    assert "Hub: Authentication" in shown and "## src/util.ts - Helps" in shown and "[function] L3-L5" in shown
    assert shown.endswith("Missing Links (1):\n  src/missing.ts") and "Cross-links: payments" in shown
    assert engine.feature_hub_text("docs/auth.md") == shown
    assert engine.feature_hub_text("none.md") == "Hub file not found: none.md"
    assert "docs/auth.md" in engine.feature_hub_text(name="nothing")
    assert "src/dog.py" in engine.feature_hub_text(orphans=True)


def test_navigation_with_labels(spark, tree):
    text = Engine(spark, str(tree)).navigate_text(lambda prompt: "none", leaf=1)
    assert all(text.count(f"{f}") == 1 for f in ("src/util.ts", "src/main.ts", "src/dog.py", "docs/auth.md")) and "[" in text


def test_tracker_writes_changes_and_whole_tables(spark, tree, tmp_path_factory):
    out, check = tmp_path_factory.mktemp("vectors"), tmp_path_factory.mktemp("check")
    (tree / "build").mkdir()
    (tree / "build/x.ts").write_text("built")

    def run():
        tracker.track(spark, str(tree), str(out), str(check), trigger={"availableNow": True}, whole_every=2).awaitTermination(60)
        last = max(int(p.name[2:]) for p in out.iterdir() if p.name.startswith("v="))
        return last, {r.key for r in tracker.read_vectors(spark, str(out), last, 2).collect()}

    seen = [run()]
    for step in range(5):
        (tree / f"src/new{step}.ts").write_text(f"new {step}")
        if step == 2:
            (tree / "src/new0.ts").unlink()
        seen.append(run())
    assert len({n for n, _ in seen}) == 6
    assert not any("build/" in k for _, keys in seen for k in keys)
    assert "src/new0.ts" in seen[1][1] and "src/new0.ts" not in seen[-1][1] and {f"src/new{i}.ts" for i in (1, 2, 3, 4)} <= seen[-1][1]
    last = seen[-1][0]
    kept = {int(p.name[2:]) for p in out.iterdir() if p.name.startswith("v=")}
    whole = last - last % 2
    assert min(kept) >= whole - 2 and {whole, last} <= kept
    odd = last if last % 2 else last - 1
    assert spark.read.parquet(f"{out}/v={odd}").count() <= 2


def test_identifier_vectors_are_replaced_by_file(spark):
    cache = spark.createDataFrame([("a:x", "a", "h", [1.0]), ("a:gone", "a", "h", [1.0]), ("b:y", "b", "h", [2.0])], "key string, file string, hash string, v array<float>")
    symbols = spark.createDataFrame([("a:x", "a", "x new"), ("b:y", "b", "y")], "key string, file string, text string")
    got = {r.key: r.v for r in tracker.refresh_identifiers(cache, symbols, spark.createDataFrame([("a",)], "file string"), lambda texts: [[9.0]] * len(texts)).collect()}
    assert got == {"a:x": [9.0], "b:y": [2.0]}
