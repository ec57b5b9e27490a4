import math
from collections import Counter

from codeloom.llm.source_mixing import mix_sources, source_rates


def rows(n):
    return [(i, "x" * (10 + i % 7), "en", f"s{i % 3}" if i % 10 else None, 0) for i in range(n)]


def test_sizes_meet_the_weights(table):
    docs = table(rows(6000))
    out = mix_sources(docs, {"s0": 4.0, "s1": 2.0, None: 1.0}, default_weight=1.0).collect()
    size = Counter()
    for r in out:
        size[r.source] += len(r.text) + 1
    total = sum(size.values())
    assert abs(total / sum(len(t) + 1 for _, t, *_ in rows(6000)) - 1) < 0.05
    for source, share in (("s0", 0.5), ("s1", 0.25), ("s2", 0.125), (None, 0.125)):
        assert abs(size[source] / total - share) < 0.03


def test_counts_follow_poisson(table):
    docs = table([(i, "abc", "en", "a", 0) for i in range(8000)])
    times = Counter(Counter(r.doc_id for r in mix_sources(docs, {}, total=8000 * 4 * 1.7).collect()).values())
    for k in range(1, 6):
        assert abs(times[k] / 8000 - math.exp(-1.7) * 1.7**k / math.factorial(k)) < 0.02


def test_large_means_are_drawn_in_parts(table):
    docs = table([(1, "abc", "en", "a", 0), (2, "x" * 1000, "en", "b", 0)])
    rates = {r["__source"]: r for r in source_rates(docs, {"a": 9.0, "b": 1.0}, total=1000.0).collect()}
    assert abs(rates["a"]["__rate"] - 225) < 1e-9 and rates["a"]["__parts"] == 4
    n = mix_sources(docs, {"a": 9.0, "b": 1.0}, total=1000.0).filter("doc_id = 1").count()
    assert 160 < n < 290


def test_same_result_again_and_rows_are_shuffled(table):
    docs = table(rows(500))
    a, b = ([(r.doc_id, r.copy) for r in mix_sources(docs, {}).collect()] for _ in range(2))
    assert a == b and a != sorted(a)


def test_nulls_clashing_names_zero_weight_and_empty(table):
    docs = table([(None, None, None, None, None, "mine", 5), (1, "a", None, "s", 1, "mine", 5)], ", copy string, __n int")
    out = mix_sources(docs, {}, total=100.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__n", "copy", "shuffle_key"]
    assert {r.doc_id for r in out.collect()} == {None, 1}
    assert mix_sources(table(rows(50)), {}, default_weight=0.0).count() == 0
    assert mix_sources(table([]), {}).count() == 0


def test_no_python_in_the_plan(table):
    plan = mix_sources(table(rows(50)), {"s0": 2.0})._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExternalRDD", "ScalaUDF"))


def test_rates_by_hand(table):
    docs = table(rows(400))
    rates = {r["__source"]: r["__rate"] for r in source_rates(docs, {"s0": 3.0, "s1": 1.0}, default_weight=0.5).collect()}
    size = Counter()
    for _, t, _, s, _ in rows(400):
        size[s] += len(t) + 1
    weights = {"s0": 3.0, "s1": 1.0, "s2": 0.5, None: 0.5}
    whole = sum(size.values())
    for s, n in size.items():
        assert abs(rates[s] - weights[s] / sum(weights.values()) * whole / n) < 1e-9
