import hashlib

from codeloom.llm.exact_dedup import drop_copies, find_copies

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "a", "A", "É", "é", "a ", "x " * 3000, "X " * 3000]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    return sorted((i, max(g), len(g), hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest()) for i, t in rows for g in [groups[(t or "").translate(UPPER)]])


def test_against_brute_force(table):
    rows = [(i, ODD[i % 10] if i % 3 else f"text {i}") for i in range(400)]
    got = find_copies(table(rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)
    assert {r.doc_id for r in got if r.kept} == {k for _, k, _, _ in brute(rows)}
    assert sorted(r.doc_id for r in drop_copies(table(rows)).collect()) == sorted({k for _, k, _, _ in brute(rows)})


def test_dropping_keeps_the_same_rows_and_all_columns(table):
    rows = [(i, ODD[i % 10], "en", "s", 1, "own", 5, "x", "y", "z") for i in range(50)]
    docs = table(rows, ", keep_id string, __n int, __maybe string, `a.b` string, __block string")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert {(r.keep_id, r["__maybe"], r["a.b"], r["__block"]) for r in kept.collect()} == {("own", "x", "y", "z")}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in find_copies(docs).filter("kept").collect()}


def test_repeated_rows_and_null_ids(table):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "b"), (None, "c"), (None, "c")]
    got = find_copies(table(rows)).collect()
    assert len(got) == 6
    assert sorted((r.text_sha256, r.kept) for r in got).count(True) == 0
    kept = [(r.doc_id, r.group_size) for r in got if r.kept]
    assert sorted(kept, key=str) == [(1, 2), (1, 2), (None, 2)]
    assert drop_copies(table(rows)).count() == 3


def test_empty_table(table):
    assert find_copies(table([])).count() == 0
    assert drop_copies(table([])).count() == 0


def test_no_python_in_the_plan(table):
    plan = find_copies(table([(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
