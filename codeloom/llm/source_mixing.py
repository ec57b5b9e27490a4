"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import materialize, quoted, whole_row

#: A Poisson mean above this is drawn as the sum of several smaller ones, so that exp(-mean) and the
#: table of its distribution stay in range.
LARGEST_MEAN = 64.0


def _uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) of 52 bits, fixed by seed and key."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict, default_weight: float = 1.0, total: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per source: __source, __rate (mean repetitions), __parts and __cdf of one part.

    A source's size is the characters of its texts plus one for each row.  The rate is
    weight / all weights * total / size, and total is the size of all sources unless given.
    """
    size = docs.groupBy(F.col(quoted(source_col)).alias("__source")).agg(F.sum(F.coalesce(F.length(quoted(text_col)), F.lit(0)) + F.lit(1)).cast("double").alias("__size"))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = materialize(size.withColumn("__weight", weight), "mix-sizes")
    sums = sizes.agg(F.sum("__size"), F.sum("__weight")).first()
    if not sums[1]:
        return sizes.select("__source", F.lit(0.0).alias("__rate"), F.lit(1).alias("__parts"), F.array(F.lit(1.0)).alias("__cdf"))
    rate = F.col("__weight") / F.lit(sums[1]) * F.lit(float(total) if total is not None else sums[0]) / F.col("__size")
    parts = sizes.select("__source", rate.alias("__rate")).withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("__rate") / LARGEST_MEAN)).cast("int"))
    mean = parts.withColumn("__mean", F.col("__rate") / F.col("__parts")).withColumn("__last", F.ceil(F.col("__mean") + 12 * F.sqrt("__mean") + 24).cast("int"))
    steps = F.expr(
        "aggregate(sequence(1, __last), named_struct('p', exp(-__mean), 'c', exp(-__mean), 'all', array(exp(-__mean))),"
        " (a, k) -> named_struct('p', a.p * __mean / k, 'c', a.c + a.p * __mean / k, 'all', concat(a.all, array(a.c + a.p * __mean / k))), a -> a.all)"
    )
    return mean.select("__source", "__rate", "__parts", steps.alias("__cdf"))


def mix_sources(
    docs: DataFrame, weights: dict, default_weight: float = 1.0, total: float | None = None, seed: int = 20, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy", key_col: str = "shuffle_key"
) -> DataFrame:
    """docs with each row repeated a Poisson number of times, in a global random order.

    The repetitions of a document are the inverse of its source's Poisson distribution at a number
    that seed and id fix, so a run can be repeated and a lost task recomputed.  ``copy`` counts a
    document's repetitions from 0; ``shuffle_key`` is the hash that deals rows to partitions and
    orders each, so the order over partitions is a random permutation with no sampling pass.
    The table of sources is joined as Spark sees fit, a hot source being split by its skew join.

    Null is a source of its own; a null text counts one character; a source whose weight is 0 goes.
    Rows that repeat an id are repeated alike.  An empty table stays empty.  ``copy`` and
    ``shuffle_key`` replace input columns of those names.
    """
    rates = source_rates(docs, weights, default_weight, total, source_col, text_col)
    key = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null"))
    rows = docs.select(key.alias("key"), F.col(quoted(source_col)).alias("of"), whole_row(docs).alias("row"))
    held = rows.join(rates, F.col("of").eqNullSafe(F.col("__source")), "left")
    numbers = F.transform(F.sequence(F.lit(0), F.col("__parts") - 1), lambda part: _uniform(seed, F.concat_ws(":", F.col("key"), part.cast("string"))))
    times = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c < u)))
    copies = held.withColumn("times", times).withColumn("nth", F.explode(F.when(F.col("times") > 0, F.sequence(F.lit(0), F.col("times") - 1))))
    hashed = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col("key"), F.col("nth").cast("string")))
    own = (copy_col, key_col)
    columns = [F.col(f"row.{quoted(c)}") for c in docs.columns if c not in own]
    return copies.select(*columns, F.col("nth").alias(copy_col), hashed.alias(key_col)).repartition(F.col(quoted(key_col))).sortWithinPartitions(F.col(quoted(key_col)))
