"""Vectors that follow a source tree, and the state of running tools."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.providers import embed_rows, hashed_vectors
from codeloom.operators.search import apply_changes
from codeloom.sources.config import UNTRACKED
from codeloom.sources.repo import RepoSource

VECTORS = "key string, hash string, v array<float>"


def refresh(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """The cache (key, hash, v) after changed files (relative_path, content): a null content deletes its
    key, an unchanged hash keeps its vector, the rest is embedded."""
    found = changes(cache, changed)
    return apply_changes(cache, found.filter("hash is not null"), found.filter("hash is null"))


def changes(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """(key, hash, v) of changed files that the cache lacks, and deleted keys with a null hash."""
    rows = changed.select(F.col("relative_path").alias("key"), F.md5("content").alias("hash"), F.col("content").alias("text"))
    new = rows.filter("hash is not null").join(cache.select("key", "hash"), ["key", "hash"], "left_anti")
    fresh = new.select("key", "hash").join(embed_rows(new), "key").select("key", "hash", "v")
    return fresh.unionByName(rows.filter("hash is null").select("key", "hash", F.lit(None).cast("array<float>").alias("v")))


def refresh_identifiers(cache: DataFrame, symbols: DataFrame, changed: DataFrame, provider: Callable = hashed_vectors) -> DataFrame:
    """The cache (key, file, hash, v) of identifiers after changed files (file): what it has of those
    goes, and their symbols (key, file, text) are embedded anew."""
    new = symbols.join(changed.select("file").distinct(), "file", "left_semi").select("key", "file", F.md5("text").alias("hash"), "text")
    fresh = new.select("key", "file", "hash").join(embed_rows(new, provider=provider), "key")
    return cache.join(changed.select("file").distinct(), "file", "left_anti").select("key", "file", "hash", "v").unionByName(fresh)


def tracked(path: Column) -> Column:
    """config.should_track on a column."""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")
    return (path != "") & reduce(lambda a, b: a & b, (~plain.startswith(x) for x in UNTRACKED))


def track(spark: SparkSession, root: str, vectors: str, checkpoint: str, files_per_tick: int = 8, trigger: dict | None = None, whole_every: int = 16) -> StreamingQuery:
    """Keeps a table of vectors in step with a tree.

    Batch n writes ``v=n``: what it changed, a deleted key with a null hash, or at each multiple of
    ``whole_every`` the whole table, after which older versions than the last whole one go.  So a tick
    writes as much as it changed, and a reader reads ``whole_every`` versions at most.  A batch that is
    done again overwrites its version.
    """
    spark.dataSource.register(RepoSource)
    stream = spark.readStream.format("repo").option("path", root).option("files_per_tick", files_per_tick).load().filter(tracked(F.col("relative_path")))

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = read_vectors(session, vectors, number - 1, whole_every) if number else session.createDataFrame([], VECTORS)
        if number % whole_every:
            out = changes(old, batch)
        else:
            out = refresh(old, batch)
        out.write.mode("overwrite").parquet(f"{vectors}/v={number}")
        if number and not number % whole_every:
            path = session._jvm.org.apache.hadoop.fs.Path(vectors)
            files = path.getFileSystem(session._jsc.hadoopConfiguration())
            for gone in range(max(0, number - 2 * whole_every), number - whole_every):
                files.delete(session._jvm.org.apache.hadoop.fs.Path(f"{vectors}/v={gone}"), True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "700 milliseconds"})).start()


def read_vectors(spark: SparkSession, vectors: str, version: int, whole_every: int = 16) -> DataFrame:
    """(key, hash, v) as of a version: the last whole table with the changes since, the latest of each key."""
    first = version - version % whole_every
    parts = [spark.read.schema(VECTORS).parquet(f"{vectors}/v={n}").withColumn("n", F.lit(n)) for n in range(first, version + 1)]
    latest = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max_by(F.struct("hash", "v"), "n").alias("last"))
    return latest.select("key", "last.hash", "last.v").filter("hash is not null")


def progress(events: DataFrame) -> DataFrame:
    """Events (seq, event, tool) to each start's state: a tool's next end flips all its open starts."""
    after = Window.partitionBy("tool").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(F.col("event").isin("tool_done", "tool_error"), F.col("event")), ignorenulls=True).over(after)
    held = events.withColumn("end", end).filter("event = 'tool_start'")
    return held.select("seq", "tool", F.when(F.col("end") == "tool_done", "done").when(F.col("end") == "tool_error", "error").otherwise("running").alias("status"))
