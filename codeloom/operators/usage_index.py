"""An index of words over source lines, kept in step file by file, that answers for many symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.sources.scratch import folders, remove, written

#: Runs of these are words; a symbol stands as a whole word only where its runs are such runs.
WORD = "[A-Za-z0-9_]+"
#: Names that are sent to every task that reads postings; more of them meet the postings by a shuffle.
SENT = 100_000
POSTINGS = "word string, file string, line long, generation long, bucket int"
FILES = "file string, there boolean, generation long"


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def longest_word(name: Column) -> Column:
    """The longest word of a name, the first among equals; null without any."""
    return F.get(F.array_sort(words_of(name), lambda a, b: F.length(b) - F.length(a)), F.lit(0))


class UsageIndex:
    """Postings (word, file, line) in a folder for each generation and bucket of words.

    A generation holds the postings of the files that one update names, and a list of those files.
    The list is written last and only a list that is complete counts, so half-written generations are
    never read; of a file the postings of its last generation hold.  An update costs what its files
    hold; after ``most`` generations the valid postings are written anew as one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most: int = 16):
        self.spark, self.path, self.buckets, self.most = spark, path.rstrip("/"), buckets, most

    def _bucket(self, word: str = "word") -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def _generations(self) -> list[int]:
        return sorted(int(x.partition("=")[2]) for x in folders(self.spark, f"{self.path}/files"))

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/generation={g}" for g in self._generations()]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, postings: DataFrame, files: DataFrame) -> None:
        generation = max(self._generations(), default=0) + 1
        held = postings.select("word", "file", F.col("line").cast("long").alias("line"), self._bucket().alias("bucket"))
        held.write.partitionBy("bucket").parquet(f"{self.path}/postings/generation={generation}")
        files.select("file", "there").write.parquet(f"{self.path}/files/generation={generation}")

    def update(self, lines: DataFrame, gone: DataFrame | None = None) -> None:
        """Takes the files of ``lines`` (file, line, text) as they are now, and removes those of ``gone`` (file)."""
        postings = lines.select("file", "line", F.explode(words_of(F.col("text"))).alias("word"))
        files = lines.select("file").distinct().withColumn("there", F.lit(True))
        if gone is not None:
            files = files.unionByName(gone.select("file").distinct().join(files, "file", "left_anti").withColumn("there", F.lit(False)))
        self._write(postings, files)
        if len(self._generations()) > self.most:
            self.compact()

    def compact(self) -> None:
        """Writes the valid postings as one generation, then removes the ones before."""
        before = self._generations()
        held = self.postings()
        files = self._read("files", FILES).groupBy("file").agg(F.max_by("there", "generation").alias("there"))
        self._write(held, files.filter("there"))
        for g in before:
            remove(self.spark, f"{self.path}/files/generation={g}")
            remove(self.spark, f"{self.path}/postings/generation={g}")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(word, file, line, bucket) of the files as they are now; of some buckets, if they are given."""
        held = self._read("postings", POSTINGS)
        held = held if buckets is None else held.filter(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
        if len(self._generations()) > 1:
            last = self._read("files", FILES).groupBy("file").agg(F.max("generation").alias("generation"), F.max_by("there", "generation").alias("there"))
            held = held.join(last.filter("there").drop("there"), ["file", "generation"], "left_semi")
        return held.select("word", "file", "line", "bucket")

    def usages(self, names: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """(name, file, line) of the lines that have a name of ``names`` (name) as a whole word.

        All names are joined at once, and only their buckets are read.  A name of several words, or of
        words and signs, is looked up by its longest word and then held against the text of ``lines``
        (file, line, text) as they are now; one without any word is looked for in all of them.  Names are
        written once; postings and lines stay where they are read or meet in a shuffle, and are never
        sent whole to a task.
        """
        plain = F.col("name").rlike(f"^{WORD}$")
        keyed = written(names.select("name").distinct().withColumn("word", longest_word(F.col("name"))).withColumn("bucket", self._bucket()), "names")
        kinds = {(r.signs, r.plain): r for r in keyed.groupBy(F.col("word").isNull().alias("signs"), plain.alias("plain")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("bucket").alias("buckets")).collect()}
        wanted = sorted({b for (signs, _), r in kinds.items() if not signs for b in r.buckets})  # at most all buckets
        few = sum(r.n for r in kinds.values()) <= SENT
        sent = lambda held: F.broadcast(held) if few else held.hint("merge")
        postings = self.postings(wanted if len(wanted) < self.buckets else None)
        found = postings.join(sent(keyed.filter("word is not null")), ["bucket", "word"]).select("name", "file", "line")
        out = found.filter(plain)
        if lines is None:
            return out
        pattern = F.concat(F.lit(T.WORD_BEFORE + "\\Q"), "name", F.lit("\\E" + T.WORD_AFTER))
        text = lines.select("file", F.col("line").cast("long").alias("line"), "text")
        if (False, False) in kinds:
            mixed = found.filter(~plain).join(text.hint("merge"), ["file", "line"]).filter(F.rlike("text", pattern))
            out = out.unionByName(mixed.select("name", "file", "line"))
        if any(signs for signs, _ in kinds):
            bare = keyed.filter("word is null").select("name")
            held = text.join(F.broadcast(bare) if few else bare, F.contains("text", F.col("name"))).filter(F.rlike("text", pattern))
            out = out.unionByName(held.select("name", "file", "line"))
        return out

    def summary(self, names: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """(word, usages, files, low_usage) of each name that is used, as code.blast_summary has it."""
        found = self.usages(names, lines).groupBy(F.col("name").alias("word"))
        return found.agg(F.count(F.lit(1)).alias("usages"), F.countDistinct("file").alias("files")).withColumn("low_usage", F.col("usages") <= 1)
