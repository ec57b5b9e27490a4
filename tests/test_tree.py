import random

from codeloom.functions import text as T
from codeloom.operators import code, search, tree
from pyspark.sql import functions as F

ENTRY = "path string, depth int, is_directory boolean"


def plain_order(entries):
    """The tree walked by hand: parents by folder, siblings by depth and path (plain letters only)."""
    folders = {p for p, _, d in entries if d}
    parent = {p: p.rpartition("/")[0] if p.rpartition("/")[0] in folders else None for p, _, _ in entries}
    depth = {p: d for p, d, _ in entries}
    out = []

    def walk(of, indent):
        for p in sorted((p for p in parent if parent[p] == of), key=lambda p: (depth[p], p)):
            out.append((p, of, indent))
            walk(p, indent + 1)

    walk(None, 1)
    return out


def test_order_and_parents_against_a_walk(spark):
    rng, entries = random.Random(1), {}
    for _ in range(60):
        path = "/".join(rng.choice("abc") + rng.choice("xyz") for _ in range(rng.randrange(1, 5)))
        entries[path] = (path, path.count("/"), rng.random() < 0.6)
    rows = list(entries.values())
    got = tree.placed(spark.createDataFrame(rows, ENTRY)).orderBy("chain").collect()
    assert [(r.path, r.parent, len(r.chain)) for r in got] == plain_order(rows)


def test_siblings_go_by_the_unicode_collation(spark):
    names = ["b", "B", "a", "É", "e", "f", "_x", "Z"]
    got = tree.placed(spark.createDataFrame([(n, 0, False) for n in names], ENTRY)).orderBy("chain").collect()
    assert [r.path for r in got] == ["_x", "a", "b", "B", "e", "É", "f", "Z"]


def test_levels_by_budget(spark):
    entries = spark.createDataFrame([("src", 0, True), ("src/a.ts", 1, False), ("b.md", 0, False)], ENTRY)
    headers = spark.createDataFrame([("src/a.ts", "What \U0001f600 it is"), ("b.md", "")], "path string, header string")
    lines = spark.createDataFrame([("src/a.ts", ["class: A (L1-L3)", "  method: f(x) (L2)"])], "path string, lines array<string>")
    full = "./\n  b.md\n  src/\n    a.ts | What \U0001f600 it is\n      class: A (L1-L3)\n        method: f(x) (L2)\n"
    headed = "./\n  b.md\n  src/\n    a.ts | What \U0001f600 it is\n"
    size = lambda text: -(-len(text.encode("utf-16-le")) // 2 // 4)
    show = lambda budget: tree.rendered(tree.context_tree(entries, headers, lines, budget), budget)
    assert show(size(full)) == full
    assert show(size(full) - 1) == tree.CUT[1].format(tokens=size(full) - 1) + "\n\n" + headed
    assert show(size(headed)) == tree.CUT[1].format(tokens=size(headed)) + "\n\n" + headed
    assert show(size(headed) - 1) == tree.CUT[0].format(tokens=size(headed) - 1) + "\n\n./\n  b.md\n  src/\n    a.ts\n"
    assert show(0).endswith("./\n  b.md\n  src/\n    a.ts\n")


def test_empty_tree(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    got = tree.context_tree(none(ENTRY), none("path string, header string"), none("path string, lines array<string>"))
    assert tree.rendered(got, 20000) == "./\n"


def test_nothing_is_collected_on_the_way(spark):
    entries = spark.createDataFrame([("a", 0, False)], ENTRY)
    got = tree.context_tree(entries, entries.select("path", F.lit("h").alias("header")), entries.select("path", F.array(F.lit("x")).alias("lines")))
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []
    assert got.columns == ["chain", "path", "parent", "indent", "level", "text"]


def test_search_documents_and_matched_symbols(spark):
    files = spark.createDataFrame([("a.ts", "// Reads files\nfunction readFile() {}"), ("n.md", "\n Title \ntext " + "x" * 5000), ("p.png", "binary"), ("c.vue", "<script>"), ("e.JSON", "{}"), (".env", "A=1")], "relative_path string, content string")
    symbols = spark.createDataFrame([("a.ts", 0, "readFile", 2, 2, "function readFile()"), ("a.ts", 1, "other", 3, 9, "function other()")], "file string, ordinal int, name string, line int, end_line int, signature string")
    got = {r.id: r for r in search.search_documents(files, symbols).collect()}
    assert set(got) == {"a.ts", "n.md", "c.vue", "e.JSON"}
    assert got["a.ts"].content == "function readFile() function other()" and got["a.ts"].embedded == "Reads files | function readFile() {} readFile other function readFile() function other()"
    assert got["n.md"].header.startswith("Title | text x") and len(got["n.md"].content) == 4000
    matched = search.search_documents(files, symbols).select("id", search.matched_symbols("FILE thing", F.col("entries")).alias("m")).filter("id = 'a.ts'").first().m
    assert [(m.name, m.line) for m in matched] == [("readFile", 2)]


def test_which_files_are_code(spark):
    paths = ["a.ts", "A.PY", "x/b.vue", "c.toml", "d.txt", ".env", "e", "f.tar.gz", "g.h/readme", "h.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", T.is_supported(F.col("path")).alias("code"), T.is_text(F.col("path")).alias("text")).collect()
    assert {r.path for r in rows if r.code} == {"a.ts", "A.PY", "x/b.vue", "c.toml"}
    assert {r.path for r in rows if r.text} == {"d.txt", "h.md"}


def test_rules_hold_for_code_alone(spark):
    rows = [(f, n, f"// remark {n}") for f in ("a.txt", "b.ts", "c.PY", "d.py", "e.vue", "Makefile") for n in range(1, 9)]
    got = code.violations(spark.createDataFrame(rows, "file string, line int, text string"))
    found = {(r.file, r.rule): r.n for r in got.collect()}
    assert found == {("b.ts", "no-comments"): 6, ("b.ts", "feature-tag"): 1, ("c.PY", "no-comments"): 6, ("d.py", "header"): 1, ("e.vue", "no-comments"): 6}


def test_keyword_patterns_equal_the_split_text(spark):
    rng = random.Random(3)
    pieces = ["get", "Get", "GET", "User", "user", "ID", "id2", "_", "-", " ", "\t", "x", "HTTPServer", "K", "é", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(600)] + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    for query in ("get user", "getUser id2", "http server", "kid"):
        fast, slow = T.file_coverage(query, F.col("t")), T.coverage(T.file_terms(F.lit(query)), T.file_terms(F.col("t")))
        assert docs.filter(~fast.eqNullSafe(F.coalesce(slow, fast))).select("t", fast, slow).collect() == []
        assert [r[0] for r in spark.range(1).select(T.file_terms(F.lit(query))).collect()] == [T.query_terms(query)]


def test_places_are_counted_over_parts(spark):
    rows = spark.range(1000).selectExpr("id % 2 AS level", "array(id * 7 % 1000) AS chain", "cast(id as string) AS path").repartition(7)
    got = tree.places(rows, "level", "chain", "path")
    assert "Window" not in got.select("path")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    want = {(n, p): i for n in (0, 1) for i, (_, p) in enumerate(sorted((k * 7 % 1000, str(k)) for k in range(n, 1000, 2)), 1)}
    assert {(r.level, r.path): r.place for r in got.collect()} == want
