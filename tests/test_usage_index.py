import random
import re

import pytest
from codeloom.operators import code, usage_index
from codeloom.operators.usage_index import UsageIndex
from codeloom.sources.scratch import folders
from pyspark.sql import functions as F

NAMES = ["alpha", "beta_2", "$scope", "a.b", "obj->f", "++", "Beta", "x"]


def make(rng, files=12):
    pieces = ["alpha", "alphabet", "beta_2", "$scope", "a.b", "xa.b", "obj->f(", "++", "Beta", "x", "é", "_x", "x9"]
    return [(f"f{i}", n, " ".join(rng.choice(pieces) for _ in range(rng.randrange(6)))) for i in range(files) for n in range(1, rng.randrange(2, 20))]


def plain(rows, names):
    """Lines where a name stands between signs that are no ASCII letters, digits or _."""
    return sorted((name, f, n) for name in names for f, n, text in rows if re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", text, re.ASCII))


def lines_of(spark, rows):
    return spark.createDataFrame(rows, "file string, line int, text string")


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


@pytest.fixture
def index(spark, tmp_path):
    return UsageIndex(spark, str(tmp_path / "index"), buckets=8, most=3)


def found(index, spark, names, rows=None):
    return sorted(tuple(r) for r in index.usages(names_of(spark, names), rows and lines_of(spark, rows)).collect())


def test_usages_of_every_kind_of_name(spark, index):
    rows = make(random.Random(1))
    index.update(lines_of(spark, rows))
    assert found(index, spark, NAMES, rows) == plain(rows, NAMES)
    assert found(index, spark, ["alpha", "x"]) == plain(rows, ["alpha", "x"])


def test_summary_equals_the_scan_for_every_word(spark, index):
    lines = lines_of(spark, make(random.Random(2)))
    index.update(lines)
    words = ["alpha", "alphabet", "beta_2", "Beta", "x", "xa", "b", "_x", "x9", "never"]
    want = sorted(tuple(r) for r in code.blast_summary(lines, words).collect())
    assert sorted(tuple(r) for r in index.summary(names_of(spark, words)).collect()) == want


def test_only_the_buckets_of_the_names_are_read(spark, index):
    index.update(lines_of(spark, make(random.Random(3))))
    plan = index.usages(names_of(spark, ["alpha"]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan)


def test_updates_removals_and_compaction(spark, index):
    rng, held = random.Random(4), {}
    for step in range(9):
        new = make(rng, 5)
        gone = [f"f{rng.randrange(12)}" for _ in range(2)]
        named = {f for f, _, _ in new}
        index.update(lines_of(spark, new), spark.createDataFrame([(g,) for g in gone], "file string"))
        held = {f: r for f, r in held.items() if f not in named and f not in gone} | {f: [x for x in new if x[0] == f] for f in named}
        assert len(index._generations()) <= 3
    rows = [r for rs in held.values() for r in rs]
    assert found(index, spark, NAMES, rows) == plain(rows, NAMES)


def test_a_generation_that_was_not_finished_is_not_read(spark, index):
    rows = make(random.Random(5))
    index.update(lines_of(spark, rows))
    torn = spark.createDataFrame([("alpha", "f0", 99)], "word string, file string, line long").withColumn("bucket", F.lit(1))
    torn.write.partitionBy("bucket").parquet(f"{index.path}/postings/generation=2")
    assert folders(spark, f"{index.path}/files") == ["generation=1"]
    assert found(index, spark, ["alpha"]) == plain(rows, ["alpha"])


def test_empty_index_and_empty_lines(spark, index):
    assert found(index, spark, ["alpha"]) == []
    index.update(lines_of(spark, []))
    assert found(index, spark, ["alpha"]) == []
    index.update(lines_of(spark, [("f", 1, ""), ("g", 1, None)]))
    assert found(index, spark, ["alpha"]) == []


def test_lines_with_equals_exploded_lines(spark):
    files = spark.createDataFrame([("a", "x alpha\n\nalphabet\nalpha"), ("b", "none"), ("c", None), ("d", "$beta beta_2\nbeta")], "path string, content string")
    for words in (["alpha"], ["beta", "$beta"], ["never"]):
        pattern = "|".join(rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])" for w in words)
        want = sorted(tuple(r) for r in code.explode_lines(files, "path", "content").filter(F.col("text").rlike(pattern)).collect())
        assert sorted(tuple(r) for r in code.lines_with(files, "path", "content", words).collect()) == want


def test_postings_and_lines_are_not_sent_whole_to_a_task(spark, index):
    rows = make(random.Random(6))
    lines = lines_of(spark, rows)
    index.update(lines)
    used = index.usages(names_of(spark, NAMES), lines)
    assert sorted(tuple(r) for r in used.collect()) == plain(rows, NAMES)
    plan = used._jdf.queryExecution().executedPlan().toString()
    sent = [re.search(r"Scan parquet\s*\[(\w+)#", x) for x in plan.split("BroadcastExchange")[1:]]
    assert {x[1] for x in sent if x} == {"name"}


def test_more_names_than_are_sent_meet_in_a_shuffle(spark, index, monkeypatch):
    rows = make(random.Random(7))
    index.update(lines_of(spark, rows))
    monkeypatch.setattr(usage_index, "SENT", 2)
    assert found(index, spark, NAMES, rows) == plain(rows, NAMES)
    monkeypatch.undo()
    for names in (["++"], ["a.b"], ["alpha"], ["$scope", "++"]):
        assert found(index, spark, names, rows) == plain(rows, names)
