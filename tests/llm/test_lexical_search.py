import math
import random
import re
from collections import Counter

from codeloom.llm.lexical_search import item_terms, lexical_search, postings, search
from llm_cases import ODD_TEXTS

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for at, (i, c) in enumerate(held):
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, at, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows, extra="", more=()):
    return spark.createDataFrame([(*r, *more) for r in rows], "item_id long, text string" + extra)


def found(docs, items, **options):
    return sorted((tuple(r) for r in lexical_search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(n, rng):
    return [(i, " ".join(rng.choice(["The", "of", "red", "x1", "É", "é", "blue", f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(40)))) for i in range(n)]


def test_against_brute_force(spark, table):
    rng = random.Random(2)
    docs = corpus(200, rng) + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(2000 + i, "red red blue") for i in range(40)]
    items = [(1, "The red thing"), (2, "blue blue x1"), (3, None), (4, ""), (5, "never"), (6, "É é"), (7, "w1 w2 w3 w4"), (None, "of")]
    want = brute(docs, items)
    assert found(table(docs), items_of(spark, items)) == want
    assert found(table(docs), items_of(spark, items), most=3) == want  # in blocks of items, terms joined by a shuffle


def test_more_results_than_documents_and_ties(spark, table):
    docs = [(i, "same words") for i in (9, 3, 5)] + [(1, "others")]
    assert found(table(docs), items_of(spark, [(1, "words same")]), k=50) == brute(docs, [(1, "words same")], 50)


def test_repeated_and_null_ids_are_documents_of_their_own(spark, table):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "c c"), (3, "d"), (4, "e e e"), (None, None)]
    assert found(table(docs), items_of(spark, [(1, "A B")])) == brute(docs, [(1, "A B")])


def test_rows_of_one_item_are_one_item(spark, table):
    docs = [(1, "a b"), (2, "b c"), (3, "d")]
    assert found(table(docs), items_of(spark, [(1, "a"), (1, "b b")])) == brute(docs, [(1, "a b b")])


def test_very_long_text(spark, table):
    docs = [(1, "alpha beta " * 60_000), (2, "alpha"), (3, "gamma"), (4, "é" * 400_000)]
    assert found(table(docs), items_of(spark, [(1, "alpha beta"), (2, "gamma")])) == brute(docs, [(1, "alpha beta"), (2, "gamma")])


def test_clashing_columns_and_empty_tables(spark, table):
    docs, items = [(1, "a b"), (2, "a"), (3, "c")], [(1, "a c")]
    odd = table([(*r, "en", "s", 0, 1, "t", 2, "w") for r in docs], ", rid int, term string, n int, `a.b` string")
    assert found(odd, items_of(spark, items, ", term string, times int", ("x", 3))) == brute(docs, items)
    assert found(table([]), items_of(spark, items)) == []
    assert found(table([(1, None)]), items_of(spark, items)) == []
    assert found(odd, items_of(spark, [])) == []


def test_postings_are_in_buckets_of_terms_and_only_wanted_ones_are_read(spark, table):
    posts = postings(table(corpus(80, random.Random(5))), buckets=8)
    held = posts.filter("term is not null").groupBy("term").agg({"bucket": "min", "*": "count"}).count()
    assert held == posts.filter("term is not null").select("term", "bucket").distinct().count()
    wanted = item_terms(items_of(spark, [(1, "red")]))
    plan = search(posts, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "CartesianProduct" not in plan and "Python" not in plan
