import pytest
from codeloom.llm._common import RepeatFilter, sample_by_hash, scratch_path
from pyspark.sql import functions as F


def test_samples_are_bounded_and_differ(spark):
    rows = spark.range(20000).select(F.xxhash64(F.col("id") % 9000).alias("h"), F.col("id"))
    for most in (1000, 5000, 15000, 29000, 30000):
        got = sample_by_hash(rows, most).collect()
        assert len({r.h for r in got}) == len(got) <= most
        assert len(got) >= min(9000, most) * 0.6
    few = spark.range(100_000).select(F.xxhash64(F.col("id") % 20).alias("h"), F.col("id"))
    assert sample_by_hash(few, 6000).count() == 20
    assert all(r.id < 9000 for r in sample_by_hash(rows, 1000).collect())
    assert sample_by_hash(rows.limit(0), 10).count() == 0


def test_filter_misses_no_repeat(spark):
    rows = spark.range(3000).select((F.col("id") % 2900).alias("x"))
    for hashes, bits in ((1, 16), (2, 16), (2, 1)):
        marked = RepeatFilter(rows, "x", hashes, bits).mark(rows, "x", "maybe").collect()
        assert all(r.maybe for r in marked if r.x < 100) and len(marked) == 3000
        joined = RepeatFilter(rows, "x", hashes, bits, max_bits=1).mark(rows, "x", "maybe").collect()
        assert len(joined) == 3000 and {r.x for r in joined if r.maybe} == set(range(100))
    loose = RepeatFilter(rows, "x").mark(rows, "x", "maybe").filter("maybe").count()
    assert 200 <= loose < 300


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Known:
        def isDefined(self):
            return False

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(lambda: Known())})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session, "x")
