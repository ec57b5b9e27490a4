import bisect
import hashlib
import itertools
import random
from collections import Counter

import pytest
from codeloom.llm.fingerprints import _bounds, fingerprint_documents, merged_terms, signatures, with_next
from llm_cases import ODD_TEXTS, words
from pyspark.sql import functions as F


def likeness(a, b):
    """Generalised Jaccard similarity of words weighted by count and squared length."""
    x, y = (Counter(w for w in t.replace("\n", " ").split(" ") if w) for t in (a, b))
    weight = lambda w: len(w) ** 2
    top = sum(min(x[w], y[w]) * weight(w) for w in x | y)
    return top / max(1e-9, sum(max(x[w], y[w]) * weight(w) for w in x | y))


def test_contract_columns_against_brute_force(table):
    rng = random.Random(1)
    rows = [(i * 7, words(rng, rng.choice((1, 30, 300)))) for i in range(1300)] + [(100000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = {r.doc_id: r for r in fingerprint_documents(table(rows)).collect()}
    texts = [(i, t or "") for i, t in sorted(rows)]
    assert len(got) == len(rows)
    for (i, text), (j, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (got[i].fingerprint, got[i].edited_fingerprint, got[j].fingerprint)
        parts = lambda s: [s[k : k + 8] for k in range(0, 256, 8)]
        assert got[i].near_edited == sum(x == y for x, y in zip(parts(a), parts(b), strict=True)) / 32
        assert got[i].near_next == sum(x == y for x, y in zip(parts(a), parts(c), strict=True)) / 32
    by_text = {}
    for i, text in texts:
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint


@pytest.mark.parametrize("ids", ["outlier", "prefixes", "one id", "nulls", "some nulls"])
def test_next_rows_however_ids_lie(spark, ids):
    make = {
        "outlier": lambda i: i if i else 10**18,
        "prefixes": lambda i: (i % 3) * 10**15 + i,
        "one id": lambda i: 7 if i % 2 else i,
        "nulls": lambda i: None,
        "some nulls": lambda i: None if i % 3 else i,
    }[ids]
    rows = [(make(i), f"text {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    got = {r.rk: (r["__next_rk"], r["__next_text"]) for r in with_next(docs, per_block=20).collect()}
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.rk))
    assert got == {a.rk: (b.rk, b.text) for a, b in zip(order, order[1:] + order[:1], strict=True)}
    cuts = _bounds(docs, 20, 64)
    if ids != "nulls":
        keys = [(r.doc_id, r.rk) for r in order if r.doc_id is not None]
        sizes = [b - a for a, b in itertools.pairwise([0, *(bisect.bisect_left(keys, c) for c in cuts), len(keys)])]
        assert max(sizes) < 100


def test_agreement_equals_generalised_jaccard(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        a = words(rng, 200, 60).replace("w", f"{i}w")
        cut = rng.randrange(len(a))
        rows.append((i, a, a[:cut] + " " + words(rng, 100, 60).replace("w", f"{i}w")))
    got = signatures(spark.createDataFrame(rows, "k long, a string, b string"), "k", "a", "b", 512).collect()
    errors = [sum(x == y for x, y in zip(r.s0, r.s1, strict=True)) / 512 - likeness(rows[r.k][1], rows[r.k][2]) for r in got]
    assert max(map(abs, errors)) < 0.1
    assert abs(sum(errors) / len(errors)) < 0.01


def test_terms_count_both_texts(spark):
    df = spark.createDataFrame([("b a  a\tc", "a\x85 b b d")], "x string, y string")
    for step in merged_terms("x", "y"):
        df = df.withColumns(step)
    counts = sorted((t.n0, t.n1) for t in df.first()["__terms"])
    assert counts == [(0, 1), (0, 1), (1, 0), (1, 2), (2, 0)]


def test_nulls_repeats_single_and_empty(table):
    got = fingerprint_documents(table([(None, "a b c d"), (1, "e f g h"), (1, "e f g h"), (2, None)])).collect()
    assert len(got) == 4
    assert {r.near_edited for r in got if r.n_chars == 0} == {1.0}
    one = fingerprint_documents(table([(5, "abcdefgh ij")])).first()
    assert one.near_next == 1.0
    assert fingerprint_documents(table([])).count() == 0


def test_no_python_in_the_plan(table):
    plan = fingerprint_documents(table([(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_texts_are_shuffled_once(table, spark):
    rows = table([(i, f"text {i}") for i in range(100)]).select(F.xxhash64("doc_id").alias("rk"), "doc_id", "text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = with_next(rows, per_block=10)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # a limit below the shuffle leaves a row for each block and task
    whole = [line for line, below in zip(lines, lines[1:], strict=False) if " Exchange hashpartitioning(__block" in line and "ReusedExchange" not in line and "WindowGroupLimit" not in below]
    assert len(whole) == 1
