import pytest
from codeloom.engine import Engine
from codeloom.operators import chains

FILES = {
    "shop/cart.ts": "function checkout(c) {\n  total(c);\n  store(c); total(c);\n  notify(c);\n}\nfunction total(c) {\n  return discount(c);\n}\nfunction discount(c) {\n  // hot path\n  return total(c);\n}\n",
    "shop/store.ts": "function store(c) {\n  db.insert(c);\n}\nfunction size() {\n}\n",
    "lib/store.ts": "function size() {\n  store();\n}\n",
    "spec/cart.ts": "function checkout() {\n}\nfunction fake() {\n}\n",
    "top.ts": "function boot() {\n  size();\n}\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for name, content in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(content)
    return Engine(spark, str(root))


def test_chain_goes_by_calls_in_order(engine):
    rows = engine.call_chain("checkout", marks=["hot p.th"]).collect()
    seen = [(r.depth, r.name, r.file, r.is_leaf) for r in rows]
    assert seen == [
        (0, "checkout", "shop/cart.ts", False),
        (1, "total", "shop/cart.ts", False),
        (2, "discount", "shop/cart.ts", False),
        (3, "total", "shop/cart.ts", True),
        (1, "store", "shop/store.ts", False),
        (2, "insert", None, True),
        (1, "notify", None, True),
    ]
    assert [r.name for r in rows if r.is_cycle] == ["total"] and [r.name for r in rows if r.is_marked] == ["discount"]
    assert [r.name for r in rows if r.is_external] == ["insert", "notify"] and [r.name for r in rows if r.is_db_hit] == ["store", "insert"]


def test_depth_cuts_but_not_the_roots_own_calls(engine):
    assert [(r.name, r.is_leaf) for r in engine.call_chain("checkout", max_depth=1).collect()] == [("checkout", False), ("total", True), ("store", True), ("notify", True)]
    assert [r.name for r in engine.call_chain("checkout", max_depth=0).collect()] == ["checkout", "total", "store", "notify"]


def test_which_definition_is_meant(engine):
    assert "not found" in engine.call_chain_text("missing")
    told = engine.call_chain_text("size").split("\n")
    assert "found in 2 files" in told[0] and told[1:] == ["  lib/store.ts  L1  (function)", "  shop/store.ts  L4  (function)"]
    with pytest.raises(LookupError):
        engine.call_chain("size")
    assert engine.call_chain("size", "shop\\store.ts").first().file == "shop/store.ts"
    assert engine.call_chain("size", "elsewhere.ts").first().file == "lib/store.ts"
    assert engine.call_chain("fake").first().file == "spec/cart.ts"
    assert engine.call_chain("checkout", "spec/cart.ts").first().file == "spec/cart.ts"
    assert [r.file for r in engine.call_chain("boot").collect()][:2] == ["top.ts", "lib/store.ts"]


def test_text_of_a_chain(engine):
    assert engine.call_chain_text("checkout", "shop/cart.ts", marks=["hot"]) == (
        'Call chain for "checkout" (max depth: 6)\nshop/cart.ts  L1-L5\nSignature: function checkout(c)\n\n'
        "checkout  shop/cart.ts  L1-L5\n"
        "├─ total  shop/cart.ts  L6-L8\n"
        "│  └─ discount  shop/cart.ts  L9-L12  ★ marked\n"
        "│     └─ total  shop/cart.ts  L6-L8  ↩ cycle\n"
        "├─ store  shop/store.ts  L1-L3  ★ db\n"
        "│  └─ insert  [leaf]  ★ db\n"
        "└─ notify  [leaf]\n\n"
        "7 node(s) | 4 internal hop(s) | 3 leaf(ves) | 2 db hit(s) | 1 cycle(s)"
    )


def test_flattening_keeps_the_first_visit(engine):
    flat = {r.node: (list(r.first_path), r.times) for r in chains.flatten_chain(engine.call_chain("checkout")).collect()}
    assert flat["shop/cart.ts:6"] == ([1], 2) and flat["ext:notify"][1] == 1 and len(flat) == 6


def test_no_symbols(spark):
    symbols = spark.createDataFrame([], "file string, name string, kind string, line int, end_line int, signature string")
    files = spark.createDataFrame([("a.ts", None)], "relative_path string, content string")
    held = chains.bodies(symbols, files)
    assert chains.call_chains(held, held).count() == 0
    lone = spark.createDataFrame([("gone.ts", "f", "function", 1, 3, "f")], symbols.schema)
    held = chains.bodies(lone, files)
    assert [(r.name, r.is_leaf, r.is_db_hit) for r in chains.call_chains(held, held).collect()] == [("f", True, False)]


def test_chains_beyond_the_row_limit_of_recursive_queries(spark):
    """Six calls in a body to the depth of three are 223 rows for each root."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        held = spark.createDataFrame(
            [("a.ts", f"f{i}", "function", i, i, "", f"a.ts:{i}", [f"f{j}" for j in range(7)], False, False) for i in range(7)],
            "file string, name string, kind string, line int, end_line int, signature string, key string, callees array<string>, is_db_hit boolean, is_marked boolean",
        )
        found = chains.chain_stats(chains.call_chains(held, held, 3)).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    # 1 + 6 + 36 + 30 * 6: six of each second level are cycles
    assert [(r.total, r.cycles) for r in found] == [(223, 66)] * 7
