"""Tables whose versions are published one after another, so that writers at once lose nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.scratch import folders, remove


class Conflict(RuntimeError):
    """Others published each time first."""


class VersionedTable:
    """A folder with a folder for each version.

    A version is written aside and then renamed to the number after the one that it was made from.  The
    rename fails if that number is taken, so of two writers one has to start again from what the other
    published, and a version is seen whole or not at all.  That holds where renaming is atomic, as on
    HDFS and local disks.  The last ``kept`` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], kept: int = 10):
        self.spark, self.path, self.schema, self.key, self.kept = spark, path.rstrip("/"), schema, key, kept

    def versions(self) -> list[int]:
        return sorted(int(name.removeprefix("v-")) for name in folders(self.spark, self.path) if name.startswith("v-"))

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the last one by default; empty before the first."""
        version = max(self.versions(), default=0) if version is None else version
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v-{version}") if version else self.spark.createDataFrame([], self.schema)

    def publish(self, rows: DataFrame, after: int) -> bool:
        """Makes rows the version that follows ``after``; False, and no change, if there is one already."""
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        rows.select(*names).write.parquet(aside)
        fs = self.spark._jvm.org.apache.hadoop.fs
        source, target = fs.Path(aside), fs.Path(f"{self.path}/v-{after + 1}")
        context = fs.FileContext.getFileContext(source.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(source, target, options)
        except Py4JJavaError:
            remove(self.spark, aside)
            if after + 1 in self.versions():
                return False
            raise
        for old in self.versions()[: -self.kept]:
            remove(self.spark, f"{self.path}/v-{old}")
        return True

    def change(self, make: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Publishes what ``make`` makes of the last version, anew if another writer was first."""
        for _ in range(tries):
            version = max(self.versions(), default=0)
            if self.publish(make(self.read(version)), version):
                return version + 1
        raise Conflict(f"{self.path}: {tries} tries")

    def merge(self, rows: DataFrame) -> int:
        """Rows take the place of those with their key, others are added; null keys equal each other."""
        return self.change(lambda held: self._apart(held, rows).unionByName(rows.select(*held.columns)))

    def delete(self, keys: DataFrame) -> int:
        return self.change(lambda held: self._apart(held, keys))

    def _apart(self, held: DataFrame, rows: DataFrame) -> DataFrame:
        gone = rows.select(*[F.col(k).alias(f"gone_{k}") for k in self.key]).distinct()
        same = F.lit(True)
        for k in self.key:
            same = same & F.col(k).eqNullSafe(F.col(f"gone_{k}"))
        return held.join(gone, same, "left_anti")
